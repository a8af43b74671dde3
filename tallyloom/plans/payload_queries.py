"""Queries of nested payloads with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve as r
from ..sources import payloads as s
from .fixtures import view, with_clause


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per customer and order month, assembled from orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("day", F.to_date("o_orderdate"))
    key, sup = F.col("o_orderkey"), F.col("o_orderkey") % 97
    item = F.struct(
        F.when(key % 3 == 0, "").otherwise(key.cast("string")).alias("line_reference"), F.when(key % 8 == 0, "soon").otherwise(F.col("day").cast("string")).alias("transaction_date"),
        F.when(key % 10 == 0, " ").otherwise(F.concat(F.lit("Shop  "), sup)).alias("merchant_name"), F.concat((key % 5000).cast("string"), F.lit(".00")).alias("amount_jpy"),
        F.when(key % 2 == 0, F.concat(F.lit("-"), (key % 700).cast("string"))).alias("original_amount"), F.when(key % 2 == 0, "us$").otherwise("").alias("original_currency"),
        F.when(key % 5 == 0, "n/a").otherwise((sup + 1).cast("string")).alias("service_catalog_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("matched", "ambiguous", "ignored", "odd")]), (key % 4 + 1).cast("int")).alias("match_status"),
        (key % 6 > 0).alias("receipt_required"), F.when(key % 7 == 0, "high").otherwise(F.concat(F.lit("0."), (key % 9 + 1).cast("string"))).alias("confidence"), F.lit("").alias("reason"),
    )
    month = F.trunc("day", "month")
    rows = orders.select(F.col("o_custkey").alias("c"), month.alias("period_month"), key.alias("k"), item.alias("item"))
    listed = rows.groupBy("c", "period_month").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("all"))
    head = F.struct(
        F.when(F.col("c") % 9 == 0, "").otherwise("**** 7210").alias("card_last4"), F.when(F.col("c") % 11 == 0, "1990-13").otherwise(F.date_format("period_month", "yyyy-MM")).alias("statement_period"),
        F.col("period_month").cast("string").alias("payment_date"), F.lit("").alias("summary_reason"), F.transform("all", lambda x: x["item"]).alias("items"),
    )
    return listed.select(F.concat_ws("/", "c", F.date_format("period_month", "yyyy-MM")).alias("statement_id"), "period_month", F.to_json(head).alias("payload"))


def statement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = s.statement_payloads(_statements(spark, sf_dir), view(spark, sf_dir, "fx_catalog"), "7210")
    return lines.select(
        "statement_id", "sequence", "reference", "line_date", "merchant", (F.col("amount_jpy") * 100).cast("long").alias("amount_jpy"),
        (F.col("original_amount") * 100).cast("long").alias("original_amount"), "original_currency", "catalog_id", "match_status", F.round(F.col("confidence") * 100).cast("long").alias("confidence"),
    )


def statement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, _ = s.statement_payloads(_statements(spark, sf_dir), view(spark, sf_dir, "fx_catalog"), "7210")
    return headers.select("statement_id", "card_last4", "statement_period", "lines", "issues", "status")


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose list is missing, empty, or holds a charge, a refund and a repeated or broken entry."""
    r, key = view(spark, sf_dir, "fx_receipts"), F.col("receipt_id")

    def item(name: str, role: str, amount, day, payee):
        return F.struct(F.lit(name).alias("component_id"), F.lit(role).alias("role"), amount.cast("string").alias("amount"), F.col("currency"), day.cast("string").alias("date"), payee.alias("payee"))

    day, none = F.col("issued_on"), F.lit(None).cast("string")
    items = F.array(
        item("a", "charge", F.col("amount"), day, none), item("b", "Refund", F.lit(5), F.date_add(day, 1), F.lit("Other")),
        item("a", "charge", F.when(key % 3 == 0, "x").otherwise("7.125"), day, none), item("", "note", F.lit(1), day, none),
    )
    listed = F.when(key % 4 == 0, F.lit(None).cast("string")).when(key % 4 == 1, "[]").otherwise(F.to_json(items))
    return r.select(
        "receipt_id", listed.alias("components"), F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("Vendor "), "catalog_id")).alias("payee"), F.lit("").alias("service_label"),
        F.when(key % 5 == 0, "refund").otherwise("charge").alias("document_kind"), F.when(key % 7 != 0, F.col("amount")).alias("amount"), "currency", "issued_on",
    )


def component_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = s.receipt_components(_receipts(spark, sf_dir))
    return rows.select("receipt_id", "component_key", "role", (F.col("signed_amount") * 100).cast("long").alias("signed_amount"), "currency", "event_date", "payee", "document_kind")


def unresolved_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.receipt_components(_receipts(spark, sf_dir))[1].select("receipt_id")


ITEMS = """
, base AS (
    SELECT o_orderkey AS k, concat(o_custkey, '/', strftime(CAST(o_orderdate AS DATE), '%Y-%m')) AS statement_id, o_custkey AS c,
           CAST(o_orderdate AS DATE) AS d, o_orderkey % 97 AS sup, CASE WHEN o_orderkey % 7 = 0 THEN 95 ELSE (o_orderkey % 9 + 1) * 10 END AS sure
    FROM orders
), items AS (
    SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY k) AS nth,
           CASE WHEN k % 5 <> 0 AND sup + 1 IN (SELECT catalog_id FROM fx_catalog) THEN sup + 1 END AS catalog_id FROM base
), weaker AS (
    SELECT *, CASE k % 4 WHEN 0 THEN CASE WHEN catalog_id IS NULL OR sure < 85 THEN 'ambiguous' ELSE 'matched' END
              WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'ignored' ELSE 'unmatched' END AS weak FROM items WHERE k % 10 <> 0
)"""
COMPONENT_ROWS = """
, good AS (
    SELECT receipt_id, concat('receipt-', receipt_id, ':primary') AS component_key, CASE WHEN receipt_id % 5 = 0 THEN 'refund' ELSE 'charge' END AS role,
           CASE WHEN receipt_id % 5 = 0 THEN -amount ELSE amount END * 100 AS signed_amount, currency, issued_on AS event_date,
           concat('Vendor ', catalog_id) AS payee, CASE WHEN receipt_id % 5 = 0 THEN 'refund' ELSE 'charge' END AS document_kind
    FROM fx_receipts WHERE receipt_id % 4 < 2 AND receipt_id % 7 <> 0 AND receipt_id % 6 <> 0
    UNION ALL
    SELECT receipt_id, concat('receipt-', receipt_id, ':a'), 'charge', amount * 100, currency, issued_on, concat('Vendor ', catalog_id),
           CASE WHEN receipt_id % 5 = 0 THEN 'refund' ELSE 'charge' END FROM fx_receipts WHERE receipt_id % 4 >= 2 AND receipt_id % 6 <> 0
    UNION ALL
    SELECT receipt_id, concat('receipt-', receipt_id, ':b'), 'refund', -500, currency, issued_on + 1, 'Other',
           CASE WHEN receipt_id % 5 = 0 THEN 'refund' ELSE 'charge' END FROM fx_receipts WHERE receipt_id % 4 >= 2
    UNION ALL
    SELECT receipt_id, concat('receipt-', receipt_id, ':a-2'), 'charge', 712, currency, issued_on, concat('Vendor ', catalog_id),
           CASE WHEN receipt_id % 5 = 0 THEN 'refund' ELSE 'charge' END FROM fx_receipts WHERE receipt_id % 4 >= 2 AND receipt_id % 6 <> 0 AND receipt_id % 3 <> 0
)"""

def component_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with the keys of their merchants: payees name vendors, every third label a known service."""
    rows = s.receipt_components(_receipts(spark, sf_dir))[0].withColumn("service_label", F.when(F.col("receipt_id") % 3 == 0, "ChatGPT Team").otherwise("of nobody"))
    keys = rows.select("payee").distinct().select(F.col("payee").alias("text"), F.concat(F.lit("TEXT:"), F.upper("payee")).alias("merchant_key"))
    return r.component_merchants(rows, keys).select("receipt_id", "component_key", "merchant_key")


def unresolved_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("receipt_id")
    receipts = s.receipt_components(_receipts(spark, sf_dir))[1].select("receipt_id")
    held = view(spark, sf_dir, "fx_receipts").select("receipt_id", "service_id", F.when(k % 5 == 0, "Label").otherwise("").alias("service_label"), F.when(k % 7 == 0, "Payee").otherwise("").alias("payee"), F.lit("a memo").alias("memo"))
    return r.unresolved_context(receipts.join(held, "receipt_id"), view(spark, sf_dir, "fx_services"), view(spark, sf_dir, "fx_catalog"))


QUERIES = {f.__name__: f for f in (statement_parse, statement_gate, component_explode, unresolved_receipts, component_merchants, unresolved_context)}

ORACLE_SQL = {
    "statement_parse": with_clause("fx_catalog").rstrip() + ITEMS + """
        SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY nth) AS sequence, CASE WHEN k % 3 = 0 THEN CAST(nth AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS reference,
               CASE WHEN k % 8 <> 0 THEN d END AS line_date, concat('Shop ', sup) AS merchant, k % 5000 * 100 AS amount_jpy,
               CASE WHEN k % 2 = 0 THEN k % 700 * 100 END AS original_amount, CASE WHEN k % 2 = 0 THEN 'USD' ELSE '' END AS original_currency, catalog_id,
               CASE WHEN weak = 'ambiguous' AND catalog_id IS NULL AND sure < 50 THEN 'unmatched' ELSE weak END AS match_status, sure AS confidence
        FROM weaker""",
    "statement_gate": with_clause("fx_catalog").rstrip() + ITEMS + """
        SELECT i.statement_id, CASE WHEN c % 9 = 0 THEN '' ELSE '7210' END AS card_last4, CASE WHEN c % 11 = 0 THEN '' ELSE strftime(min(d), '%Y-%m') END AS statement_period,
               count(CASE WHEN k % 10 <> 0 THEN 1 END) AS lines,
               concat_ws(',', CASE WHEN c % 9 = 0 THEN 'card' END, CASE WHEN c % 11 = 0 THEN 'period' END, CASE WHEN count(CASE WHEN k % 10 <> 0 THEN 1 END) = 0 THEN 'no lines' END) AS issues,
               CASE WHEN c % 9 = 0 OR c % 11 = 0 OR count(CASE WHEN k % 10 <> 0 THEN 1 END) = 0 THEN 'needs_review' ELSE 'completed' END AS status
        FROM items AS i GROUP BY i.statement_id, c""",
    "component_explode": with_clause("fx_receipts").rstrip() + COMPONENT_ROWS + "SELECT * FROM good",
    "component_merchants": with_clause("fx_receipts").rstrip() + COMPONENT_ROWS + "SELECT receipt_id, component_key, CASE WHEN receipt_id % 3 = 0 THEN 'OPENAI' ELSE concat('TEXT:', upper(payee)) END AS merchant_key FROM good",
    "unresolved_context": with_clause("fx_receipts", "fx_services", "fx_catalog").rstrip() + COMPONENT_ROWS + """
        SELECT r.receipt_id, CASE WHEN r.receipt_id % 5 = 0 THEN 'Label' WHEN r.receipt_id % 7 = 0 THEN 'Payee' WHEN v.service_id IS NULL THEN 'a memo'
               ELSE concat(v.name, CASE v.billing_type WHEN 'metered' THEN '（従量課金 / API）' WHEN 'subscription' THEN '（サブスク）' ELSE '（一回払い）' END, ' ', (SELECT concat('ALT ', c.name, ' ', c.name, ' Supply-', c.catalog_id, ' Works') FROM fx_catalog AS c WHERE c.catalog_id = v.catalog_id)) END AS text
        FROM fx_receipts AS r LEFT JOIN fx_services AS v ON v.service_id = r.service_id WHERE r.receipt_id NOT IN (SELECT receipt_id FROM good)""",
    "unresolved_receipts": with_clause("fx_receipts").rstrip() + COMPONENT_ROWS + "SELECT receipt_id FROM fx_receipts WHERE receipt_id NOT IN (SELECT receipt_id FROM good)",
}
