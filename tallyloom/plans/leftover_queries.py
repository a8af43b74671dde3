"""Queries of leftovers, plan changes, review and quality with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leftovers as lo
from ..operators import matching as m
from ..operators import plan_change as p
from ..operators import review as rv
from ..sources.stages import staged
from .fixtures import VIEWS, view, with_clause
from .matching_queries import BOTH, DEDUP, EDGES, OPTIONS

VIEWS |= {
    "fx_changes": """
        SELECT rk AS change_id, o_custkey AS user_id, l_suppkey AS merchant_key,
               CASE WHEN l_partkey % 6 <> 0 THEN '' WHEN o_custkey % 3 = 0 THEN 'Pro plan' WHEN o_custkey % 3 = 1 THEN 'Team' ELSE '' END AS previous_plan,
               CASE WHEN l_partkey % 4 <> 0 THEN d + CAST(-(l_partkey % 3) AS INTEGER) END AS change_date, d AS previous_plan_end,
               (700 + l_partkey % 30 * 10) / 1000 AS confidence
        FROM fx_base JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_history": """
        SELECT rk AS evidence_key, CASE WHEN l_partkey % 5 <> 0 THEN o_custkey END AS user_id, l_suppkey AS merchant_key,
               CASE WHEN l_partkey % 5 = 0 OR l_partkey % 7 = 0 THEN '' WHEN o_custkey % 3 = 0 THEN 'Claude Pro' ELSE 'Team Annual' END AS plan_name,
               CAST(d - INTERVAL 1 MONTH AS DATE) AS event_date, amt AS amount, CASE WHEN l_suppkey % 2 = 1 THEN 'USD' ELSE 'JPY' END AS currency,
               CASE WHEN l_partkey % 5 = 0 THEN 5 ELSE l_partkey % 3 END AS quality, l_partkey % 14 <> 7 AS recurring,
               CASE WHEN l_partkey % 5 = 0 THEN 'statement' ELSE 'receipt' END AS source
        FROM fx_base JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_review": """
        SELECT receipt_id, user_id, service_id, receipt_month, is_extra, file <> '' AND NOT file_deleted AS available, bits % 17 = 0 AS reviewed,
               CASE bits % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'none' WHEN 3 THEN 'needs_review' WHEN 4 THEN 'failed'
                    WHEN 5 THEN 'skipped' ELSE 'generated' END AS state, bits % 11 = 0 AS recommended, bits % 2 = 0 OR bits % 9 = 6 AS payee,
               bits % 3 > 0 OR bits % 9 = 6 AS recipient, bits % 5 > 0 AS related, bits % 7 > 0 AS date, bits % 23 > 0 AS amount,
               bits % 4 > 0 OR bits % 9 = 6 AS currency, bits % 6 > 0 OR bits % 9 = 6 AS period, issued_on
        FROM fx_receipts""",
    "fx_requests": """
        SELECT o_orderkey AS request_id, o_custkey AS user_id, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS receipt_month,
               o_custkey * 100000 + o_orderkey % (SELECT count(*) FROM {supplier}) AS service_id, o_orderkey % 3 = 0 AS is_extra,
               concat('Memo ', o_orderkey % 4) AS memo, CAST(o_orderdate AS DATE) AS created_at
        FROM {orders}""",
    "fx_arrivals": """
        SELECT rk AS receipt_id, o_custkey AS user_id, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS receipt_month,
               o_custkey * 100000 + l_suppkey AS service_id, l_partkey % 3 = 0 AS is_extra, concat(' memo ', l_partkey % 4) AS memo
        FROM fx_base JOIN {orders} ON l_orderkey = o_orderkey""",
}


def _pools(spark: SparkSession, sf_dir: str):
    options = m.amount_options(view(spark, sf_dir, "fx_lines"))
    unique = m.unique_evidence(view(spark, sf_dir, "fx_evidence"))
    return options, unique, m.direct_edges(options, unique)


def shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    options, unique, _ = _pools(spark, sf_dir)
    return lo.shortage(options, unique).select("statement_id", "line_key", "same_lines", "support", "short")


def unused_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence as if unused, some with another day, amount, merchant or currency than its line."""
    options, unique, _ = _pools(spark, sf_dir)
    key = F.col("component_key")
    moved = unique.select(
        "statement_id", "component_key", F.when(key % 11 == 0, F.col("merchant_key") + 100_000).otherwise(F.col("merchant_key")).alias("merchant_key"),
        F.when(key % 13 == 0, "EUR").otherwise(F.col("currency")).alias("currency"),
        (F.col("signed_amount") + F.when(key % 3 == 0, 10).otherwise(0)).cast("decimal(14,2)").alias("signed_amount"),
        F.expr("date_add(event_date, CAST(component_key % 5 AS INT))").alias("event_date"),
    )
    return lo.unused_reasons(moved, options)


def review_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no charge fits with charges of unread kinds."""
    options = m.amount_options(view(spark, sf_dir, "fx_lines"))
    kept = m.kept_evidence(view(spark, sf_dir, "fx_evidence")).where("role = 'charge'")
    kept = staged(kept.select("statement_id", "merchant_key", "currency", "signed_amount", "event_date", "role", "document_kind", "receipt_order", "receipt_id"), "charges")
    return lo.review_pairing(m.without_charge(options, kept), kept.where("document_kind IN ('unknown', 'invoice')"))


def evidence_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calculation of each match that competes with no other."""
    _, unique, edges = _pools(spark, sf_dir)
    sure = m.uncontested(edges).select("statement_id", "line_key", F.array("component_key").alias("component_keys"))
    return lo.evidence_calculation(sure, unique)


def statement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, evidence = view(spark, sf_dir, "fx_lines"), view(spark, sf_dir, "fx_evidence")
    unique = m.unique_evidence(evidence)
    return lo.statement_summary(lines, m.reconcile(lines, evidence, unique), unique, evidence)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = m.amount_options(view(spark, sf_dir, "fx_lines"))
    return p.plan_change_candidates(options, view(spark, sf_dir, "fx_changes"), view(spark, sf_dir, "fx_history"))


def plan_change_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    milli = F.round(F.col("confidence") * 1000).cast("long").alias("confidence")
    return _candidates(spark, sf_dir).select("line_key", "change_id", "evidence_key", "user_id", "end_days", "billing_days", "unnamed", milli)


def plan_change_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.plan_change_best(_candidates(spark, sf_dir)).select("line_key", "change_id", "evidence_key", "user_id")


def plan_change_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.plan_change_alloc(p.plan_change_best(_candidates(spark, sf_dir))).select("line_key", "change_id", "evidence_key", "user_id")


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.review_status(view(spark, sf_dir, "fx_review").withColumn("amount", F.col("amount").cast("boolean")))


def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("needs_review").cast("int").alias("needs_review")
    return _reviewed(spark, sf_dir).select("receipt_id", "status", "unchecked", flag)


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.review_counts(_reviewed(spark, sf_dir))


def extraction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.extraction_counters(view(spark, sf_dir, "fx_review"))


def period_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue days against the month of the receipt's submission slot, one later for some."""
    expected = F.when(F.col("receipt_id") % 4 == 0, F.add_months("receipt_month", 1)).otherwise(F.col("receipt_month"))
    day = F.when(F.col("receipt_id") % 9 != 0, F.col("issued_on"))
    return view(spark, sf_dir, "fx_review").select("receipt_id", rv.period_check(day, expected, F.col("state").isin(*rv.DONE)).alias("period_status"))


def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that must be unique, tested on keys that repeat in part."""
    catalog, services, receipts = (view(spark, sf_dir, f"fx_{n}") for n in ("catalog", "services", "receipts"))
    return (
        rv.duplicate_keys(services, "service", F.col("user_id"), F.lower("name"), F.col("billing_type"))
        .unionByName(rv.duplicate_keys(catalog, "catalog name", F.lower(F.substring("name", 1, 14))))
        .unionByName(rv.duplicate_keys(receipts, "receipt of a service and month", F.col("service_id"), F.col("receipt_month")))
    )


def dq_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "extra with service": F.col("is_extra") & F.col("service_id").isNotNull(), "no service": ~F.col("is_extra") & F.col("service_id").isNull(),
        "no file": F.col("file") == "", "not of the month": F.dayofmonth("receipt_month") != 1, "no card": ~F.col("p_card_snapshot"),
    }
    return rv.rule_violations(view(spark, sf_dir, "fx_receipts"), "receipt_id", rules)


def resolve_resubmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.resolve_resubmissions(view(spark, sf_dir, "fx_requests"), view(spark, sf_dir, "fx_arrivals"))


QUERIES = {
    f.__name__: f
    for f in (
        shortage, unused_reasons, review_pairing, evidence_calc, statement_summary, plan_change_candidates, plan_change_best, plan_change_alloc,
        review_status, review_counts, extraction_counters, period_check, dq_unique, dq_checks, resolve_resubmissions,
    )
}

POOLS = BOTH + DEDUP.lstrip() + OPTIONS + EDGES
NO_EDGE = "NOT EXISTS (SELECT 1 FROM edges AS e WHERE e.statement_id = {0}.statement_id AND e.{1} = {0}.{1})"
PLAN = with_clause("fx_lines", "fx_changes", "fx_history").rstrip() + OPTIONS + """
, met AS (
    SELECT o.line_key, c.change_id, h.evidence_key, c.user_id, o.amount, h.quality,
           abs(date_diff('day', c.previous_plan_end, o.line_date)) AS end_days, abs(day(h.event_date) - day(o.line_date)) AS billing_days,
           CASE WHEN h.plan_name = '' THEN 1 ELSE 0 END AS unnamed, h.source, CAST(round(c.confidence * 1000) AS BIGINT) AS milli
    FROM options AS o
    JOIN fx_changes AS c ON c.merchant_key = o.merchant_key AND abs(date_diff('day', c.previous_plan_end, o.line_date)) <= 1
    JOIN fx_history AS h ON h.merchant_key = o.merchant_key AND h.currency = o.currency AND h.amount = o.amount
    WHERE c.previous_plan <> '' AND c.confidence >= 0.75 AND (c.change_date IS NULL OR c.change_date <= o.line_date)
          AND (h.user_id IS NULL OR h.user_id = c.user_id)
          AND date_trunc('month', h.event_date) = date_trunc('month', o.line_date) - INTERVAL 1 MONTH
          AND abs(day(h.event_date) - day(o.line_date)) <= 1 AND (c.change_date IS NULL OR h.event_date < c.change_date)
          AND CASE WHEN h.plan_name = '' THEN h.recurring WHEN c.previous_plan = 'Pro plan' THEN h.plan_name = 'Claude Pro' ELSE h.plan_name = 'Team Annual' END
), scored AS (
    SELECT *, least(990, greatest(0, least(990, milli) - CASE WHEN source = 'statement' THEN 120 WHEN unnamed = 1 THEN 80 ELSE 0 END)
              + CASE WHEN end_days = 0 THEN 5 ELSE 0 END + CASE WHEN billing_days = 0 THEN 5 ELSE 0 END) AS confidence
    FROM met
)"""
AVAILABLE = with_clause("fx_review").rstrip()
CHECKED = ", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in rv.CHECKS)
REVIEWED = AVAILABLE + f"""
, reviewed AS (
    SELECT receipt_id, CASE WHEN NOT available THEN 'file_unavailable' WHEN reviewed THEN 'admin_confirmed' WHEN state IN ('queued', 'processing') THEN 'ai_processing'
           WHEN state = 'none' THEN 'ai_unprocessed' WHEN recommended THEN 'resubmission_decision' WHEN state IN ('needs_review', 'skipped') THEN 'manual_review'
           WHEN payee AND recipient AND related AND date AND amount AND currency AND period THEN 'ai_ok' ELSE 'manual_review' END AS status,
           concat_ws(',', {CHECKED}) AS unchecked,
           CASE WHEN available AND state NOT IN ('queued', 'processing', 'none') AND NOT reviewed
                AND NOT (payee AND recipient AND related AND date AND amount AND currency AND period) THEN 1 ELSE 0 END AS needs_review
    FROM fx_review
)"""

ORACLE_SQL = {
    "shortage": POOLS + """
        , same AS (SELECT statement_id, merchant_key, currency, amount, count(DISTINCT line_key) AS n FROM options GROUP BY ALL
        ), charges AS (SELECT statement_id, merchant_key, currency, signed_amount AS amount, count(*) AS n FROM uniq WHERE role = 'charge' GROUP BY ALL)
        SELECT o.statement_id, o.line_key, s.n AS same_lines, coalesce(c.n, 0) AS support,
               CASE WHEN s.n > 1 THEN greatest(s.n - coalesce(c.n, 0), 0) ELSE 0 END AS short
        FROM options AS o JOIN same AS s ON s.statement_id = o.statement_id AND s.merchant_key = o.merchant_key AND s.currency = o.currency AND s.amount = o.amount
        LEFT JOIN charges AS c ON c.statement_id = o.statement_id AND c.merchant_key = o.merchant_key AND c.currency = o.currency AND c.amount = o.amount
        WHERE o.pos = 0""",
    "unused_reasons": POOLS + f"""
        , unused AS (
            SELECT statement_id, component_key, CASE WHEN component_key % 11 = 0 THEN merchant_key + 100000 ELSE merchant_key END AS merchant_key,
                   CASE WHEN component_key % 13 = 0 THEN 'EUR' ELSE currency END AS currency, signed_amount + CASE WHEN component_key % 3 = 0 THEN 10 ELSE 0 END AS signed_amount,
                   event_date + CAST(component_key % 5 AS INTEGER) AS event_date FROM uniq
        ), near AS (
            SELECT u.statement_id, u.component_key, o.line_key, abs(date_diff('day', u.event_date, o.line_date)) AS days,
                   CASE WHEN o.currency = u.currency AND o.amount = u.signed_amount THEN 0 WHEN o.currency = u.currency THEN 1 WHEN o.line_key IS NOT NULL THEN 2 ELSE 3 END AS class
            FROM unused AS u LEFT JOIN options AS o ON o.statement_id = u.statement_id AND o.merchant_key = u.merchant_key
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY statement_id, component_key ORDER BY class, days, line_key) AS n FROM near
        )
        SELECT statement_id, component_key, CASE class WHEN 0 THEN CASE WHEN days > 1 THEN 'date_outside_window' ELSE 'surplus_evidence' END
               WHEN 1 THEN CASE WHEN days <= 1 THEN 'amount_mismatch' ELSE 'amount_and_date_mismatch' END
               WHEN 2 THEN 'currency_mismatch' ELSE 'merchant_not_found' END AS reason, line_key AS closest_line
        FROM placed WHERE n = 1""",
    "review_pairing": POOLS + f"""
        , a AS (SELECT statement_id, merchant_key, line_key, row_number() OVER (PARTITION BY statement_id, merchant_key ORDER BY line_key) AS k
                FROM options AS o WHERE pos = 0 AND {NO_EDGE.format('o', 'line_key')}
        ), b AS (SELECT statement_id, merchant_key, receipt_id, row_number() OVER (PARTITION BY statement_id, merchant_key ORDER BY receipt_order) AS k
                 FROM uniq AS u WHERE role = 'charge' AND document_kind IN ('unknown', 'invoice'))
        SELECT a.statement_id, a.line_key, b.receipt_id FROM a JOIN b ON a.statement_id = b.statement_id AND a.merchant_key = b.merchant_key AND a.k = b.k""",
    "evidence_calc": POOLS + """
        SELECT e.statement_id, e.line_key, concat(u.signed_amount, ' = ', u.signed_amount, ' ', u.currency) AS calculation
        FROM (SELECT *, count(*) OVER (PARTITION BY statement_id, line_key) AS ld, count(*) OVER (PARTITION BY statement_id, component_key) AS pd FROM edges) AS e
        JOIN uniq AS u ON u.statement_id = e.statement_id AND u.component_key = e.component_key WHERE e.ld = 1 AND e.pd = 1""",
    "plan_change_candidates": PLAN + "SELECT line_key, change_id, evidence_key, user_id, end_days, billing_days, unnamed, confidence FROM scored",
    "plan_change_best": PLAN + """
        , ranked AS (SELECT *, rank() OVER (PARTITION BY line_key ORDER BY end_days, unnamed, billing_days, -confidence, quality) AS core FROM scored
        ), top AS (SELECT *, row_number() OVER (PARTITION BY line_key ORDER BY user_id, change_id, evidence_key) AS n,
                          min(user_id) OVER (PARTITION BY line_key) AS lo, max(user_id) OVER (PARTITION BY line_key) AS hi FROM ranked WHERE core = 1)
        SELECT line_key, change_id, evidence_key, user_id FROM top WHERE n = 1 AND lo = hi""",
    "plan_change_alloc": PLAN.replace("WITH ", "WITH RECURSIVE ", 1) + """
        , ranked AS (SELECT *, rank() OVER (PARTITION BY line_key ORDER BY end_days, unnamed, billing_days, -confidence, quality) AS core FROM scored
        ), top AS (SELECT *, row_number() OVER (PARTITION BY line_key ORDER BY user_id, change_id, evidence_key) AS n,
                          min(user_id) OVER (PARTITION BY line_key) AS lo, max(user_id) OVER (PARTITION BY line_key) AS hi FROM ranked WHERE core = 1
        ), best AS (SELECT l.statement_id, l.merchant_key, t.line_key, t.change_id, t.evidence_key, t.user_id,
                           row_number() OVER (PARTITION BY l.statement_id, l.merchant_key ORDER BY end_days, unnamed, billing_days, -confidence, l.sequence, t.line_key, change_id, evidence_key) AS k
                    FROM top AS t JOIN fx_lines AS l ON l.line_key = t.line_key WHERE t.n = 1 AND lo = hi
        ), walk AS (
            SELECT statement_id, merchant_key, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS changes, CAST([] AS BIGINT[]) AS olds, false AS taken FROM best WHERE k = 1
            UNION ALL
            SELECT b.statement_id, b.merchant_key, b.k, CASE WHEN free THEN list_append(changes, b.change_id) ELSE changes END, CASE WHEN free THEN list_append(olds, b.evidence_key) ELSE olds END, free
            FROM (SELECT w.*, b.change_id, b.evidence_key, b.k AS at, NOT list_contains(w.changes, b.change_id) AND NOT list_contains(w.olds, b.evidence_key) AS free
                  FROM walk AS w JOIN best AS b ON b.statement_id = w.statement_id AND b.merchant_key = w.merchant_key AND b.k = w.k + 1) AS s
            JOIN best AS b ON b.statement_id = s.statement_id AND b.merchant_key = s.merchant_key AND b.k = s.at
        )
        SELECT b.line_key, b.change_id, b.evidence_key, b.user_id FROM walk AS w JOIN best AS b ON b.statement_id = w.statement_id AND b.merchant_key = w.merchant_key AND b.k = w.k WHERE w.taken""",
    "review_status": REVIEWED + "SELECT * FROM reviewed",
    "review_counts": REVIEWED + "SELECT status, count(*) AS receipts, sum(needs_review) AS needs_review FROM reviewed GROUP BY status",
    "extraction_counters": AVAILABLE + "\nSELECT receipt_month, count(*) AS receipts, " + ", ".join(
        f"count(CASE WHEN state = '{s}' THEN 1 END) AS {s}" for s in ("queued", "processing", *rv.DONE, "none")) + " FROM fx_review GROUP BY receipt_month",
    "period_check": AVAILABLE + """
        SELECT receipt_id, CASE WHEN state IN ('queued', 'processing', 'none') THEN 'not_checked' WHEN receipt_id % 9 = 0 THEN 'unknown'
               WHEN receipt_id % 4 = 0 THEN 'mismatched' ELSE 'matched' END AS period_status FROM fx_review""",
    "dq_unique": with_clause("fx_catalog", "fx_services", "fx_receipts") + """
        SELECT 'service' AS rule, concat_ws('|', user_id, lower(name), billing_type) AS key, count(*) AS n FROM fx_services GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'catalog name', lower(substr(name, 1, 14)), count(*) FROM fx_catalog GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'receipt of a service and month', concat_ws('|', coalesce(CAST(service_id AS VARCHAR), ''), receipt_month), count(*)
        FROM fx_receipts GROUP BY 2 HAVING count(*) > 1""",
    "dq_checks": with_clause("fx_receipts") + """
        SELECT 'extra with service' AS rule, CAST(receipt_id AS VARCHAR) AS key FROM fx_receipts WHERE is_extra AND service_id IS NOT NULL
        UNION ALL SELECT 'no service', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE NOT is_extra AND service_id IS NULL
        UNION ALL SELECT 'no file', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE file = ''
        UNION ALL SELECT 'not of the month', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE day(receipt_month) <> 1
        UNION ALL SELECT 'no card', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE NOT p_card_snapshot""",
    "resolve_resubmissions": with_clause("fx_requests", "fx_arrivals") + """
        , asked AS (SELECT *, lower(trim(memo)) AS m, row_number() OVER (PARTITION BY user_id, receipt_month, lower(trim(memo)) ORDER BY created_at, request_id) AS k
                    FROM fx_requests WHERE is_extra
        ), came AS (SELECT *, lower(trim(memo)) AS m, row_number() OVER (PARTITION BY user_id, receipt_month, lower(trim(memo)) ORDER BY receipt_id) AS k
                    FROM fx_arrivals WHERE is_extra
        ), exact AS (SELECT a.request_id, c.receipt_id FROM asked AS a JOIN came AS c ON a.user_id = c.user_id AND a.receipt_month = c.receipt_month AND a.m = c.m AND a.k = c.k
        ), ra AS (SELECT user_id, receipt_month, request_id, row_number() OVER (PARTITION BY user_id, receipt_month ORDER BY created_at, request_id) AS k
                  FROM asked WHERE request_id NOT IN (SELECT request_id FROM exact)
        ), rb AS (SELECT user_id, receipt_month, row_number() OVER (PARTITION BY user_id, receipt_month ORDER BY receipt_id) AS k
                  FROM came WHERE receipt_id NOT IN (SELECT receipt_id FROM exact))
        SELECT request_id FROM fx_requests AS r WHERE NOT is_extra AND EXISTS (SELECT 1 FROM fx_arrivals AS a
            WHERE NOT a.is_extra AND a.user_id = r.user_id AND a.receipt_month = r.receipt_month AND a.service_id = r.service_id)
        UNION ALL SELECT request_id FROM exact
        UNION ALL SELECT ra.request_id FROM ra JOIN rb ON ra.user_id = rb.user_id AND ra.receipt_month = rb.receipt_month AND ra.k = rb.k""",
}
