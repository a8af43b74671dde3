"""Queries of months, scopes and compliance with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import compliance as c
from .fixtures import view, with_clause

AS_OF = "1998-03-15"


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, f"fx_{n}") for n in names]


def _flags(df: DataFrame) -> DataFrame:
    """Booleans as 0 and 1."""
    return df.withColumns({n: F.col(n).cast("int") for n, kind in df.dtypes if kind == "boolean"})


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.user_scopes(*_views(spark, sf_dir, "services", "receipts", "declarations"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.scope_summary(_scopes(spark, sf_dir), view(spark, sf_dir, "fx_months"))


def month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = view(spark, sf_dir, "fx_base").select("d").distinct()
    d = F.col("d")
    return days.select(
        "d", cal.month_of(d).alias("month"), cal.shift_months(d, 1).alias("next_day"), cal.shift_months(d, -13).alias("back_day"),
        cal.receipt_month_of_submission(d).alias("receipt_month"), cal.submission_month_of_receipt(d).alias("submission_month"),
        cal.receipt_month_of_statement(d).alias("statement_receipt_month"), F.date_format(d, "yyMMdd").alias("label"),
    )


def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose time is over at the start of AS_OF, first to expire first in line."""
    kept = view(spark, sf_dir, "fx_receipts").where(c.available(F.col("file"), F.col("file_deleted")))
    uploaded = F.col("issued_on").cast("timestamp") + F.expr("make_dt_interval(0, 9, 30, 0)")
    due = kept.withColumn("expires_at", cal.expiry_of(uploaded, 3)).where(F.col("expires_at") <= F.lit(AS_OF).cast("timestamp"))
    return due.select("receipt_id", "file", F.date_format("expires_at", "yyyy-MM-dd HH:mm").alias("expires_at"))


def services_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    services, months = _views(spark, sf_dir, "services", "months")
    return c.services_in_scope(services, months).select("service_id", "receipt_month", F.col("uses_p_card").cast("int").alias("uploadable"))


def service_month_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.service_month_status(*_views(spark, sf_dir, "services", "months", "receipts", "declarations"))
    return out.select("service_id", "receipt_month", "status", "receipts")


def user_month_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(_summary(spark, sf_dir))


def submit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.scope_submit_check(*_views(spark, sf_dir, "services", "months", "receipts", "declarations"))


def user_service_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.user_service_counts(*_views(spark, sf_dir, "users", "services"))


def catalog_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.catalog_usage(*_views(spark, sf_dir, "catalog", "services"))


def account_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.account_status(*_views(spark, sf_dir, "users", "services"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.scope_history(_scopes(spark, sf_dir), *_views(spark, sf_dir, "months", "submissions", "receipts"))


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(_history(spark, sf_dir).select("user_id", "receipt_month", "display", "receipts", "available", "extra", "purged", "attention"))


def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.history_totals(_history(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return c.reminder_candidates(view(spark, sf_dir, "fx_users"), _summary(spark, sf_dir), kind)


def reminder_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_candidates(spark, sf_dir, k).select("user_id", "receipt_month", F.lit(k).alias("kind"), "missing", "api_pending") for k in ("initial", "urgent")]
    return parts[0].unionByName(parts[1])


def reminder_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = _candidates(spark, sf_dir, "urgent")
    key = F.concat_ws(":", F.lit("reminder:urgent"), F.date_format("receipt_month", "yyyy-MM"), "user_id")
    log = due.where("user_id % 3 <> 0").select(key.alias("idempotency_key"), F.expr("IF(user_id % 3 = 1, 'sent', 'failed')").alias("status"))
    return c.reminder_outbox(due, log, "urgent").select("idempotency_key", "action")


def statement_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.statement_receipts(*_views(spark, sf_dir, "receipts", "users")).select("receipt_id", "receipt_month", "receipt_order")


def historical_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.historical_receipts(*_views(spark, sf_dir, "receipts", "users", "months")).select("statement_month", "receipt_id")


def selectable_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.selectable_catalogs(*_views(spark, sf_dir, "catalog", "users", "services"))


SCOPE = """
, scope AS (
    SELECT s.*, m.receipt_month FROM fx_services AS s, fx_months AS m WHERE s.is_active OR s.final_receipt_month >= m.receipt_month
)"""
STATUS = SCOPE + """
, has AS (
    SELECT service_id, receipt_month, max(CASE WHEN file <> '' AND NOT file_deleted THEN 1 ELSE 0 END) AS has_receipt, count(*) AS receipts
    FROM fx_receipts WHERE service_id IS NOT NULL GROUP BY service_id, receipt_month
), said AS (SELECT DISTINCT service_id, receipt_month FROM fx_declarations
), status AS (
    SELECT s.*, CASE WHEN h.has_receipt = 1 THEN 'uploaded' WHEN s.billing_type = 'metered' AND d.service_id IS NOT NULL THEN 'no_usage'
                WHEN s.billing_type = 'metered' THEN 'api_pending' ELSE 'missing' END AS status, coalesce(h.receipts, 0) AS receipts
    FROM scope AS s LEFT JOIN has AS h ON h.service_id = s.service_id AND h.receipt_month = s.receipt_month
    LEFT JOIN said AS d ON d.service_id = s.service_id AND d.receipt_month = s.receipt_month
    WHERE s.uses_p_card
)"""
SUMMARY = STATUS + """
, sums AS (
    SELECT user_id, receipt_month, count(*) AS total, count(CASE WHEN status = 'uploaded' THEN 1 END) AS uploaded,
           count(CASE WHEN status = 'no_usage' THEN 1 END) AS no_usage, count(CASE WHEN billing_type <> 'metered' THEN 1 END) AS required,
           count(CASE WHEN billing_type = 'metered' THEN 1 END) AS usage_based, count(CASE WHEN status = 'missing' THEN 1 END) AS missing,
           count(CASE WHEN status = 'api_pending' THEN 1 END) AS api_pending
    FROM status GROUP BY user_id, receipt_month
), summary AS (
    SELECT o.user_id, o.receipt_month, coalesce(total, 0) AS total, coalesce(uploaded, 0) AS uploaded, coalesce(no_usage, 0) AS no_usage,
           coalesce(required, 0) AS required, coalesce(usage_based, 0) AS usage_based, coalesce(missing, 0) AS missing,
           coalesce(api_pending, 0) AS api_pending, non_p_card
    FROM (SELECT user_id, receipt_month, count(CASE WHEN NOT uses_p_card THEN 1 END) AS non_p_card FROM scope GROUP BY user_id, receipt_month) AS o
    LEFT JOIN sums AS s ON s.user_id = o.user_id AND s.receipt_month = o.receipt_month
)"""
HISTORY = SUMMARY + """
, counts AS (
    SELECT user_id, receipt_month, count(*) AS receipts, count(CASE WHEN file <> '' AND NOT file_deleted THEN 1 END) AS available,
           count(CASE WHEN is_extra THEN 1 END) AS extra, count(CASE WHEN file_deleted THEN 1 END) AS purged
    FROM fx_receipts GROUP BY user_id, receipt_month
), held AS (
    SELECT user_id, CAST(period_month - INTERVAL 1 MONTH AS DATE) AS receipt_month, status FROM fx_submissions
), history AS (
    SELECT s.*, CASE WHEN h.status = 'submitted' THEN 'submitted' WHEN s.total = 0 THEN 'not_required'
                WHEN h.status IS NOT NULL OR coalesce(c.receipts, 0) > 0 THEN 'draft' ELSE 'not_started' END AS display,
           coalesce(c.receipts, 0) AS receipts, coalesce(c.available, 0) AS available, coalesce(c.extra, 0) AS extra, coalesce(c.purged, 0) AS purged,
           CASE WHEN s.missing > 0 OR s.api_pending > 0 THEN 1 ELSE 0 END AS attention
    FROM summary AS s LEFT JOIN held AS h ON h.user_id = s.user_id AND h.receipt_month = s.receipt_month
    LEFT JOIN counts AS c ON c.user_id = s.user_id AND c.receipt_month = s.receipt_month
)"""
BASE = with_clause("fx_services", "fx_months", "fx_receipts", "fx_declarations").rstrip()
ALL = with_clause("fx_services", "fx_months", "fx_receipts", "fx_declarations", "fx_submissions", "fx_users", "fx_catalog").rstrip()
REACHED = " JOIN fx_users AS u ON u.user_id = s.user_id WHERE u.is_active AND NOT u.is_staff AND u.account_status = 'active' AND "

QUERIES = {
    f.__name__: f
    for f in (
        month_keys, retention_due, services_in_scope, service_month_status, user_month_summary, submit_check, user_service_counts, catalog_usage,
        account_status, history_rows, history_totals, reminder_candidates, reminder_outbox, statement_receipts, historical_receipts, selectable_catalogs,
    )
}

ORACLE_SQL = {
    "month_keys": with_clause("fx_base") + """
        SELECT DISTINCT d, CAST(date_trunc('month', d) AS DATE) AS month, CAST(d + INTERVAL 1 MONTH AS DATE) AS next_day,
               CAST(d - INTERVAL 13 MONTH AS DATE) AS back_day, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS receipt_month,
               CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS submission_month,
               CAST(date_trunc('month', d) AS DATE) AS statement_receipt_month, strftime(d, '%y%m%d') AS label
        FROM fx_base""",
    "retention_due": with_clause("fx_receipts") + f"""
        SELECT receipt_id, file, concat(CAST(CAST(issued_on + INTERVAL 3 MONTH AS DATE) AS VARCHAR), ' 09:30') AS expires_at
        FROM fx_receipts WHERE file <> '' AND NOT file_deleted AND CAST(issued_on + INTERVAL 3 MONTH AS DATE) < DATE '{AS_OF}'""",
    "services_in_scope": BASE + SCOPE + "SELECT service_id, receipt_month, CASE WHEN uses_p_card THEN 1 ELSE 0 END AS uploadable FROM scope",
    "service_month_status": BASE + STATUS + "SELECT service_id, receipt_month, status, receipts FROM status",
    "user_month_summary": BASE + SUMMARY + """
        SELECT *, uploaded + no_usage AS resolved, CASE WHEN missing = 0 AND api_pending = 0 THEN 1 ELSE 0 END AS complete,
               concat(uploaded + no_usage, '/', total) AS progress,
               CASE WHEN total > 0 AND missing = 0 AND api_pending = 0 AND no_usage = total THEN 1 ELSE 0 END AS no_receipt_needed
        FROM summary""",
    "submit_check": BASE + STATUS + """
        , ranked AS (
            SELECT *, row_number() OVER (PARTITION BY user_id, receipt_month, status IN ('missing', 'api_pending') ORDER BY name, billing_type) AS n FROM status
        )
        SELECT user_id, receipt_month, CASE WHEN count(CASE WHEN status IN ('missing', 'api_pending') THEN 1 END) = 0 THEN 1 ELSE 0 END AS can_submit,
               count(CASE WHEN status IN ('missing', 'api_pending') THEN 1 END) AS blocking,
               coalesce(string_agg(CASE WHEN status IN ('missing', 'api_pending') AND n <= 5 THEN name END, ', ' ORDER BY name, billing_type), '') AS preview,
               greatest(count(CASE WHEN status IN ('missing', 'api_pending') THEN 1 END) - 5, 0) AS more
        FROM ranked GROUP BY user_id, receipt_month""",
    "user_service_counts": with_clause("fx_users", "fx_services") + """
        SELECT u.user_id, count(s.service_id) AS total, count(CASE WHEN s.is_active THEN 1 END) AS active,
               count(CASE WHEN s.is_active AND s.uses_p_card THEN 1 END) AS active_p_card,
               count(CASE WHEN s.is_active AND NOT s.uses_p_card THEN 1 END) AS active_non_p_card,
               count(CASE WHEN s.registration_source = 'user' THEN 1 END) AS user_registered,
               count(CASE WHEN NOT s.is_active AND s.deactivation_source = 'user' THEN 1 END) AS user_stopped
        FROM fx_users AS u LEFT JOIN fx_services AS s ON s.user_id = u.user_id WHERE u.is_active AND NOT u.is_staff GROUP BY u.user_id""",
    "catalog_usage": with_clause("fx_catalog", "fx_services") + """
        SELECT c.catalog_id, c.name, count(s.service_id) AS assigned, count(DISTINCT CASE WHEN s.is_active THEN s.user_id END) AS active_users,
               count(CASE WHEN s.is_active THEN 1 END) AS active_services
        FROM fx_catalog AS c LEFT JOIN fx_services AS s ON s.catalog_id = c.catalog_id GROUP BY c.catalog_id, c.name""",
    "account_status": with_clause("fx_users", "fx_services") + """
        SELECT user_id, CASE WHEN is_staff THEN account_status
               WHEN user_id IN (SELECT user_id FROM fx_services WHERE is_active) THEN 'active' ELSE 'stopped' END AS account_status
        FROM fx_users""",
    "history_rows": ALL + HISTORY + "SELECT user_id, receipt_month, display, receipts, available, extra, purged, attention FROM history",
    "history_totals": ALL + HISTORY + """
        SELECT receipt_month, count(*) AS users, count(CASE WHEN display = 'submitted' THEN 1 END) AS submitted,
               count(CASE WHEN display = 'not_required' THEN 1 END) AS not_required, count(CASE WHEN display = 'draft' THEN 1 END) AS draft,
               count(CASE WHEN display = 'not_started' THEN 1 END) AS not_started, sum(total) AS total, sum(uploaded) AS uploaded,
               sum(no_usage) AS no_usage, sum(missing) AS missing, sum(api_pending) AS api_pending, sum(receipts) AS receipts,
               sum(available) AS available, sum(extra) AS extra, sum(purged) AS purged,
               count(CASE WHEN missing = 0 AND api_pending = 0 THEN 1 END) AS complete, count(CASE WHEN attention = 1 THEN 1 END) AS attention
        FROM history GROUP BY receipt_month""",
    "reminder_candidates": ALL + SUMMARY + f"""
        SELECT s.user_id, s.receipt_month, 'initial' AS kind, s.missing, s.api_pending FROM summary AS s {REACHED} s.missing > 0
        UNION ALL
        SELECT s.user_id, s.receipt_month, 'urgent', s.missing, s.api_pending FROM summary AS s {REACHED} (s.missing > 0 OR s.api_pending > 0)""",
    "reminder_outbox": ALL + SUMMARY + f"""
        SELECT concat('reminder:urgent:', strftime(s.receipt_month, '%Y-%m'), ':', s.user_id) AS idempotency_key,
               CASE WHEN s.user_id % 3 = 0 THEN 'insert' ELSE 'retry' END AS action
        FROM summary AS s {REACHED} (s.missing > 0 OR s.api_pending > 0) AND s.user_id % 3 <> 1""",
    "statement_receipts": with_clause("fx_receipts", "fx_users") + """
        SELECT receipt_id, receipt_month, row_number() OVER (PARTITION BY receipt_month ORDER BY issued_on, receipt_id) AS receipt_order
        FROM fx_receipts WHERE file <> '' AND NOT file_deleted AND (is_extra OR p_card_snapshot)
             AND user_id IN (SELECT user_id FROM fx_users WHERE NOT is_staff)""",
    "historical_receipts": with_clause("fx_receipts", "fx_users", "fx_months") + """
        SELECT m.receipt_month AS statement_month, r.receipt_id
        FROM fx_receipts AS r JOIN fx_months AS m ON r.receipt_month < m.receipt_month AND r.receipt_month >= CAST(m.receipt_month - INTERVAL 3 MONTH AS DATE)
        WHERE (r.is_extra OR r.p_card_snapshot) AND r.user_id IN (SELECT user_id FROM fx_users WHERE NOT is_staff)""",
    "selectable_catalogs": with_clause("fx_catalog", "fx_users", "fx_services") + """
        SELECT c.catalog_id, (SELECT count(*) FROM fx_users WHERE is_active AND NOT is_staff)
               - (SELECT count(DISTINCT s.user_id) FROM fx_services AS s JOIN fx_users AS u ON u.user_id = s.user_id
                  WHERE s.catalog_id = c.catalog_id AND u.is_active AND NOT u.is_staff) AS open_users
        FROM fx_catalog AS c WHERE c.is_active""",
}
