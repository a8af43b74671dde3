"""Spark jobs for reconciling spending records, and operators for training-data corpora."""
