"""Views over the given tables in the shapes that the operators read.

Each is one SELECT that both engines understand: integer arithmetic on keys and dates only. Money is a
whole number of units here and becomes DECIMAL(14,2) in `view`. Braces name the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("customer", "supplier", "orders", "lineitem", "events", "documents")
MONEY = ("amount", "original_amount", "amount_jpy", "signed_amount")

VIEWS = {
    "fx_base": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, CAST(l_shipdate AS DATE) AS d,
               CAST(10 * ceil(l_quantity / 10) AS BIGINT) AS amt,
               l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                   l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rk
        FROM {lineitem}""",
    "fx_lines": """
        SELECT year(d) * 100 + month(d) AS statement_id, rk AS line_key, rk AS sequence,
               d + CAST(l_partkey % 3 - 1 AS INTEGER) AS line_date, l_suppkey AS merchant_key,
               CASE WHEN l_suppkey % 2 = 1 THEN amt END AS original_amount,
               CASE WHEN l_suppkey % 2 = 1 THEN 'USD' ELSE '' END AS original_currency,
               CASE WHEN l_suppkey % 2 = 1 THEN amt * 150 ELSE amt END AS amount_jpy
        FROM fx_base WHERE l_returnflag <> 'R'""",
    "fx_evidence": """
        SELECT year(d) * 100 + month(d) AS statement_id, rk AS component_key, rk AS receipt_id, rk AS receipt_order,
               l_suppkey AS merchant_key, CASE WHEN l_returnflag = 'R' THEN -amt ELSE amt END AS signed_amount,
               CASE WHEN l_suppkey % 2 = 1 THEN 'USD' ELSE 'JPY' END AS currency, d AS event_date,
               CASE WHEN l_returnflag = 'R' THEN 'refund' ELSE 'charge' END AS role,
               CASE WHEN l_returnflag = 'R' OR l_partkey % 19 = 0 THEN 'refund' WHEN l_partkey % 5 = 0 THEN 'invoice'
                    WHEN l_partkey % 11 = 0 THEN 'unknown' ELSE 'charge' END AS document_kind,
               CASE WHEN l_partkey % 4 = 0 THEN concat('in-', l_orderkey) ELSE '' END AS invoice_number,
               CASE WHEN l_partkey % 6 = 1 THEN concat('tx ', l_orderkey, '/', l_partkey % 3) ELSE '' END AS transaction_id,
               CASE WHEN l_returnflag = 'R' THEN concat('IN', l_orderkey) ELSE '' END AS related_transaction_id
        FROM fx_base WHERE l_returnflag = 'R' OR l_partkey % 7 <> 0""",
    "fx_users": """
        SELECT c_custkey AS user_id, concat('u', c_custkey) AS username, concat('U', c_custkey, '@Example.com') AS email,
               c_mktsegment = 'MACHINERY' AS is_staff, c_custkey % 17 <> 0 AS is_active,
               CASE WHEN c_custkey % 23 = 0 THEN 'stopped' ELSE 'active' END AS account_status
        FROM {customer}""",
    "fx_catalog": """
        SELECT s_suppkey AS catalog_id, s_name AS name,
               CASE s_suppkey % 3 WHEN 0 THEN 'metered' WHEN 1 THEN 'subscription' ELSE 'one_time' END AS billing_type,
               concat('ALT ', s_name, '; Supply-', s_suppkey, ' Works') AS merchant_aliases, s_suppkey % 13 <> 0 AS is_active
        FROM {supplier}""",
    "fx_services": """
        SELECT u * 100000 + sv AS service_id, u AS user_id, sv AS catalog_id, concat('Service ', sv) AS name,
               CASE sv % 3 WHEN 0 THEN 'metered' WHEN 1 THEN 'subscription' ELSE 'one_time' END AS billing_type,
               (u + sv) % 5 <> 0 AS is_active, (u + sv) % 7 <> 0 AS uses_p_card,
               CASE WHEN (u + sv) % 5 = 0 THEN DATE '1998-01-01' END AS final_receipt_month,
               CASE WHEN (u + sv) % 4 = 0 THEN 'user' ELSE 'staff' END AS registration_source,
               CASE WHEN (u + sv) % 10 = 0 THEN 'user' WHEN (u + sv) % 5 = 0 THEN 'staff' ELSE '' END AS deactivation_source
        FROM (SELECT DISTINCT o_custkey AS u, l_suppkey AS sv FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) AS pairs""",
    "fx_submissions": """
        SELECT o_custkey AS user_id, period_month, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'submitted' ELSE 'draft' END AS status
        FROM (SELECT o_custkey, o_orderkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) + INTERVAL 1 MONTH AS DATE) AS period_month
              FROM {orders}) AS o
        GROUP BY o_custkey, period_month""",
    "fx_receipts": """
        SELECT rk AS receipt_id, o_custkey AS user_id, CASE WHEN l_partkey % 29 <> 0 THEN o_custkey * 100000 + l_suppkey END AS service_id,
               l_suppkey AS catalog_id, l_partkey % 29 = 0 AS is_extra, CAST(date_trunc('month', d) AS DATE) AS receipt_month, d AS issued_on, amt AS amount,
               CASE WHEN l_suppkey % 2 = 1 THEN 'USD' ELSE 'JPY' END AS currency,
               CASE WHEN l_partkey % 31 = 0 THEN '' ELSE concat('receipts/', rk, '.pdf') END AS file,
               l_partkey % 13 = 0 AS file_deleted, (o_custkey + l_suppkey) % 7 <> 0 AS p_card_snapshot, l_partkey AS bits
        FROM fx_base JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_declarations": """
        SELECT DISTINCT o_custkey AS user_id, o_custkey * 100000 + o_orderkey % (SELECT count(*) FROM {supplier}) AS service_id,
               CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS receipt_month
        FROM {orders}""",
    "fx_months": """
        SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS receipt_month FROM fx_base""",
    "fx_names": """
        SELECT s_suppkey AS name_id, CASE s_suppkey % 6 WHEN 0 THEN upper(s_name) WHEN 1 THEN lower(concat('alt ', s_name))
                   WHEN 2 THEN concat('*', s_name, ' / TOKYO') WHEN 3 THEN concat('Supply ', s_suppkey, ' works')
                   WHEN 4 THEN concat('OPENAI *CHATGPT ', s_suppkey) ELSE concat('pay.', s_suppkey, ' Unlisted Vendor') END AS text
        FROM {supplier}""",
}


def _needs(name: str, seen: list[str]) -> list[str]:
    for other in VIEWS:
        if other != name and other in VIEWS[name] and other not in seen:
            _needs(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_clause(*names: str, tables: dict[str, str] | None = None) -> str:
    """WITH ... of the named views and those they need, over tables of their own names."""
    seen: list[str] = []
    for name in names:
        _needs(name, seen)
    plain = tables or {t: t for t in TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in seen) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_clause(name, tables={t: "{%s}" % t for t in TABLES}) + f"SELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{%s}" % t in sql}
    df = spark.sql(sql, **used)
    return df.withColumns({c: F.col(c).cast("decimal(14,2)") for c in df.columns if c in MONEY})
