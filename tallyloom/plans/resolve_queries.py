"""Queries of text functions and entity resolution with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import resolve as r
from .fixtures import view, with_clause


def catalog_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.catalog_aliases(view(spark, sf_dir, "fx_catalog"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_names")


def catalog_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.catalog_strength(_names(spark, sf_dir), catalog_alias(spark, sf_dir))


def catalog_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_entries(_names(spark, sf_dir), catalog_alias(spark, sf_dir))


def merchant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.merchant_keys(_names(spark, sf_dir), view(spark, sf_dir, "fx_catalog"))


def text_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's noisy spelling against its own name."""
    both = _names(spark, sf_dir).join(view(spark, sf_dir, "fx_catalog"), F.col("name_id") == F.col("catalog_id"))
    return both.select("name_id", t.text_related(F.col("text"), F.col("name")).cast("int").alias("related"), t.normal_text(F.col("text")).alias("normal"))


PLANS = ("Pro plan", "Max plan - 20x", "Claude Pro", "claude max", "Team Annual", "ChatGPT Team", "Basic subscription", "")


def plans_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan names of consecutive orders of each customer, chosen by their keys."""
    names = F.array(*[F.lit(p) for p in PLANS])
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pick = lambda k: F.element_at(names, (F.col(k) % len(PLANS) + 1).cast("int"))
    return orders.select("o_orderkey", t.plans_related(pick("o_orderkey"), pick("o_custkey")).cast("int").alias("related"))


def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and currencies as receipts print them, from order totals."""
    sign = F.element_at(F.array(*[F.lit(x) for x in ("$", "¥", "usd ", "EUR", "x")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    units, tenths = F.floor("o_totalprice").cast("long"), F.col("o_orderkey") % 1000
    printed = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(""), sign, F.format_number(units, 0), F.lit("."), F.lpad(tenths.cast("string"), 3, "0"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", sign.alias("sign"), printed.alias("printed"))
    return orders.select(
        "o_orderkey", (t.signed_amount(F.col("printed")) * 100).cast("long").alias("signed"), (t.unsigned_amount(F.col("printed")) * 100).cast("long").alias("unsigned"),
        t.currency_code(F.col("sign")).alias("currency"),
    )


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PNG", ".jpeg", ".tar.gz", "")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("r-"), "o_custkey", ending).alias("name"))
    return orders.select("o_orderkey", t.file_type(F.col("name")).alias("file_type"))


def build_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = view(spark, sf_dir, "fx_receipts")
    user, payee = F.concat(F.lit("u "), "user_id"), F.concat(F.lit("Vendor: "), "catalog_id", F.lit(" / Ltd."))
    name = t.receipt_filename(F.col("issued_on"), user, payee, F.col("amount") + F.when(F.col("bits") % 3 == 0, F.lit(0.5).cast("decimal(4,2)")).otherwise(0), F.col("currency"), F.lit(".pdf"))
    return receipts.select("receipt_id", name.alias("filename"))


def bill_to_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail addresses of documents against users who are known by them; those of odd first documents have no address of their own."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = documents.select("doc_id", t.first_email(F.col("text")).alias("email")).where("email <> ''")
    users = seen.groupBy("email").agg(F.min("doc_id").alias("user_id")).withColumn("username", F.concat(F.lit("login"), "user_id"))
    users = users.withColumn("email", F.when(F.col("user_id") % 2 == 0, F.col("email")))
    return r.bill_to_user(documents, users)


def user_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "fx_users")
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("IF(o_orderkey % 2 = 0, concat('u', o_custkey, '@EXAMPLE.com'), concat('U', o_custkey))").alias("address"))
    return r.user_lookup(asked, users)


def service_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each service with an odd id sum, asked for by name only or by entry only."""
    services = view(spark, sf_dir, "fx_services")
    wanted = services.select(
        F.col("service_id").alias("request_id"), "user_id", F.expr("IF(catalog_id % 2 = 0, catalog_id, NULL)").alias("catalog_id"), F.upper("name").alias("name"), "billing_type"
    )
    return r.same_service(wanted, services)


def _norm(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def _tokens(x: str, generic: str = "', '".join(t.GENERIC_TOKENS)) -> str:
    return f"list_filter(regexp_extract_all(upper({x}), '[A-Z0-9]{{3,}}'), lambda w: length(w) >= 4 AND NOT list_contains(['{generic}'], w))"


ALIASES = """
, alias AS (
    SELECT DISTINCT catalog_id, trim(alias) AS alias FROM (
        SELECT catalog_id, name AS alias FROM fx_catalog
        UNION ALL SELECT catalog_id, unnest(string_split_regex(merchant_aliases, '[,;\n]+')) FROM fx_catalog) AS a
    WHERE trim(alias) <> ''
)"""
STRENGTH = ALIASES + f"""
, n AS (SELECT DISTINCT text, {_norm('text')} AS a, {_tokens('text')} AS tokens FROM fx_names
), al AS (SELECT catalog_id, {_norm('alias')} AS b, {_tokens('alias')} AS tokens FROM alias
), strength AS (
    SELECT text, catalog_id, max(CASE WHEN a = b THEN 4
        WHEN least(length(a), length(b)) >= 8 AND (contains(a, b) OR contains(b, a)) THEN 3
        WHEN least(length(a), length(b)) >= 5 AND (contains(a, b) OR contains(b, a)) THEN 2
        WHEN list_has_any(n.tokens, al.tokens) THEN 2 ELSE 0 END) AS strength
    FROM n, al GROUP BY text, catalog_id
), best AS (
    SELECT s.text, s.catalog_id, s.strength FROM strength AS s
    JOIN (SELECT text, max(strength) AS top FROM strength GROUP BY text) AS m ON m.text = s.text AND m.top = s.strength WHERE s.strength > 0
)"""
NAMES = with_clause("fx_names", "fx_catalog").rstrip()
KNOWN = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{'|'.join(s)}') THEN '{k}'" for k, s in t.KNOWN_MERCHANTS) + " ELSE '' END"
EMAIL = r"lower(regexp_extract(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', 0))"

QUERIES = {
    f.__name__: f
    for f in (
        catalog_alias, catalog_strength, catalog_best, merchant_keys, text_related, plans_related, parse_amounts, file_types, build_filename,
        bill_to_user, user_lookup, service_identity,
    )
}

PLAN_LIST = "['" + "', '".join(PLANS) + "']"


def _plan(x: str) -> str:
    low = f"regexp_replace(lower({x}), '\\b(monthly|annual|subscription|plan)\\b', ' ', 'g')"
    return f"trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g'))"


def _plan_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: length(w) >= 3 AND NOT list_contains(['{chr(39) + ', ' + chr(39)}'], w))".replace(
        f"['{chr(39) + ', ' + chr(39)}']", "['" + "', '".join(t.VENDOR_WORDS) + "']"
    )


ORACLE_SQL = {
    "catalog_alias": with_clause("fx_catalog").rstrip() + ALIASES + "SELECT catalog_id, alias FROM alias",
    "catalog_strength": NAMES + STRENGTH + "SELECT text, catalog_id, strength FROM strength WHERE strength > 0",
    "catalog_best": NAMES + STRENGTH + "SELECT text, catalog_id, strength FROM best",
    "merchant_keys": NAMES + STRENGTH + f"""
        , ids AS (SELECT text, string_agg(catalog_id, ':' ORDER BY catalog_id) AS ids FROM best GROUP BY text)
        SELECT DISTINCT n.text, CASE WHEN {KNOWN.format('n.a')} <> '' THEN {KNOWN.format('n.a')} WHEN i.ids IS NOT NULL THEN concat('CATALOG:', i.ids)
               WHEN len(n.tokens) > 0 THEN concat('TEXT:', (SELECT w FROM (SELECT unnest(n.tokens) AS w) AS u ORDER BY length(w) DESC, w LIMIT 1))
               ELSE concat('TEXT:', n.a) END AS merchant_key
        FROM n LEFT JOIN ids AS i ON i.text = n.text""",
    "text_related": with_clause("fx_names", "fx_catalog") + f"""
        SELECT name_id, CASE WHEN (a = b AND length(a) >= 3) OR (least(length(a), length(b)) >= 5 AND (contains(a, b) OR contains(b, a)))
               OR list_has_any({_tokens('text')}, {_tokens('name')}) THEN 1 ELSE 0 END AS related, a AS normal
        FROM (SELECT *, {_norm('text')} AS a, {_norm('name')} AS b FROM fx_names JOIN fx_catalog ON name_id = catalog_id) AS x""",
    "plans_related": f"""
        SELECT o_orderkey, CASE WHEN a <> '' AND b <> '' AND (a = b OR (least(length(a), length(b)) >= 5 AND (contains(a, b) OR contains(b, a)))
               OR list_has_any({_plan_words('a')}, {_plan_words('b')})) THEN 1 ELSE 0 END AS related
        FROM (SELECT o_orderkey, {_plan(f'{PLAN_LIST}[CAST(o_orderkey % 8 + 1 AS INTEGER)]')} AS a, {_plan(f'{PLAN_LIST}[CAST(o_custkey % 8 + 1 AS INTEGER)]')} AS b FROM orders) AS p""",
    "parse_amounts": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -c ELSE c END AS signed, c AS unsigned,
               CASE o_custkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'JPY' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' ELSE '' END AS currency
        FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) * 100 + m // 10
                     + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END AS c
              FROM (SELECT *, o_orderkey % 1000 AS m FROM orders) AS o) AS p""",
    "file_types": """
        SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg'
               ELSE 'application/octet-stream' END AS file_type FROM orders""",
    "build_filename": with_clause("fx_receipts") + """
        SELECT receipt_id, concat(strftime(issued_on, '%y%m%d'), '_u_', user_id, '_Vendor_', catalog_id, '_', amount,
               CASE WHEN bits % 3 = 0 THEN '.5' ELSE '' END, '_', currency, '.pdf') AS filename FROM fx_receipts""",
    "bill_to_user": f"""
        WITH found AS (SELECT doc_id, {EMAIL} AS address FROM documents),
             users AS (SELECT address, min(doc_id) AS user_id FROM found WHERE address <> '' GROUP BY address HAVING min(doc_id) % 2 = 0)
        SELECT f.doc_id, f.address, u.user_id FROM found AS f LEFT JOIN users AS u ON u.address = f.address WHERE f.address <> ''""",
    "user_lookup": with_clause("fx_users") + """
        SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN concat('u', o_custkey, '@EXAMPLE.com') ELSE concat('U', o_custkey) END AS address, u.user_id
        FROM orders JOIN fx_users AS u ON u.user_id = o_custkey WHERE NOT u.is_staff""",
    "service_identity": with_clause("fx_services") + """
        SELECT s.service_id AS request_id, s.service_id FROM fx_services AS s""",
}
