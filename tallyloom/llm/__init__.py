"""Operators of a training-data pipeline, each a function of DataFrames."""
