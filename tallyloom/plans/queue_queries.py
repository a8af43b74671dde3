"""Queries of work queues and triage with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queues as q
from ..operators import review as rv
from . import leftover_queries  # noqa: F401  it adds the views of requests and reviews
from .fixtures import VIEWS, view, with_clause

VIEWS |= {
    "fx_asked": """
        SELECT request_id, user_id, receipt_month, created_at, CASE request_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status FROM fx_requests""",
    "fx_items": """
        SELECT line_key, CASE WHEN line_key % 9 = 0 THEN 1.0 ELSE 0.5 END AS confidence, CASE WHEN line_key % 2 = 0 THEN '管理者 ok' ELSE 'auto' END AS memo,
               line_key % 7 <> 0 AS receipt_required, line_key % 11 % 2 AS gate_errors, CASE WHEN line_key % 5 <> 0 THEN line_date END AS line_date,
               line_key % 13 <> 0 AS has_amount FROM fx_lines""",
    "fx_statements": """
        SELECT statement_id, CAST(date_trunc('month', min(line_date) + 1) AS DATE) AS period_month,
               CASE statement_id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' ELSE 'completed' END AS status FROM fx_lines GROUP BY statement_id""",
}


def exception_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred: a top-k report."""
    return q.exception_queue(view(spark, sf_dir, "fx_asked"), 100).select("request_id", "status", "created_at")


def resubmission_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.resubmission_counts(view(spark, sf_dir, "fx_asked"))


def item_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.item_triage(view(spark, sf_dir, "fx_items")).select("line_key", "triage")


def pending_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = view(spark, sf_dir, "fx_receipts").where("is_extra").select(F.col("receipt_month").alias("period_month"))
    return q.pending_statements(view(spark, sf_dir, "fx_statements"), changed).select("statement_id", "status")


def declaration_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.declaration_conflicts(view(spark, sf_dir, "fx_receipts"), view(spark, sf_dir, "fx_declarations")).select("user_id", "service_id", "receipt_month")


def reminder_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.reminders_of_days(view(spark, sf_dir, "fx_base").select("d").distinct(), spark.range(1).selectExpr("5 AS reminder_day", "10 AS warning_day"))


def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five hundred receipts to process: a batch by order."""
    stamped = view(spark, sf_dir, "fx_review").withColumn("updated_at", F.col("issued_on").cast("timestamp"))
    return rv.claim_batch(stamped, "1995-06-01", 500).select("receipt_id", "state")


def missing_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without a profile row: here, those that registered no service of the metered kind themselves."""
    own = view(spark, sf_dir, "fx_services").where("registration_source = 'user' AND billing_type = 'metered' AND NOT is_active")
    return q.missing_profiles(view(spark, sf_dir, "fx_users"), own.select("user_id"))


def service_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.service_changes(view(spark, sf_dir, "fx_services")).select("service_id", "registration_source", "deactivation_source")


QUERIES = {
    f.__name__: f
    for f in (exception_queue, resubmission_list, item_triage, pending_statements, declaration_conflicts, reminder_kind, claim_batch, missing_profiles, service_changes)
}

ORACLE_SQL = {
    "exception_queue": with_clause("fx_asked") + """
        SELECT request_id, status, created_at FROM fx_asked ORDER BY CASE WHEN status = 'pending' THEN 0 ELSE 1 END, created_at DESC, request_id DESC LIMIT 100""",
    "resubmission_list": with_clause("fx_asked") + """
        SELECT receipt_month, count(*) AS requests, count(CASE WHEN status = 'pending' THEN 1 END) AS open FROM fx_asked GROUP BY receipt_month""",
    "item_triage": with_clause("fx_items") + """
        SELECT line_key, CASE WHEN confidence >= 1 AND memo LIKE '管理者%' THEN 'manual' WHEN NOT receipt_required THEN 'ignored' WHEN gate_errors > 0 THEN 'statement_error'
               WHEN line_date IS NULL OR NOT has_amount THEN 'missing_fields' ELSE 'auto' END AS triage FROM fx_items""",
    "pending_statements": with_clause("fx_statements", "fx_receipts") + """
        SELECT statement_id, status FROM fx_statements WHERE status NOT IN ('processing', 'failed')
               AND period_month IN (SELECT receipt_month FROM fx_receipts WHERE is_extra)""",
    "declaration_conflicts": with_clause("fx_receipts", "fx_declarations") + """
        SELECT user_id, service_id, receipt_month FROM fx_declarations AS d
        WHERE EXISTS (SELECT 1 FROM fx_receipts AS r WHERE r.service_id = d.service_id AND r.receipt_month = d.receipt_month)""",
    "reminder_kind": with_clause("fx_base") + """
        SELECT DISTINCT d, CASE WHEN day(d) = 5 THEN 'initial' ELSE 'urgent' END AS kind FROM fx_base WHERE day(d) IN (5, 10)""",
    "claim_batch": with_clause("fx_review") + """
        SELECT receipt_id, state FROM fx_review WHERE available AND (state = 'queued' OR (state = 'processing' AND issued_on < DATE '1995-06-01'))
        ORDER BY issued_on, receipt_id LIMIT 500""",
    "missing_profiles": with_clause("fx_users", "fx_services") + """
        SELECT user_id, 'active' AS account_status FROM fx_users
        WHERE user_id NOT IN (SELECT user_id FROM fx_services WHERE registration_source = 'user' AND billing_type = 'metered' AND NOT is_active)""",
    "service_changes": with_clause("fx_services") + """
        SELECT service_id, registration_source, deactivation_source FROM fx_services WHERE registration_source = 'user' OR deactivation_source = 'user'""",
}
