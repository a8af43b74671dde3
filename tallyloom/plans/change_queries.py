"""Queries of state changes and the arrival stream with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as ch
from ..sources.stages import stage_folder, staged
from ..streaming import arrivals
from .fixtures import view, with_clause


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, f"fx_{n}") for n in names]


def apply_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = view(spark, sf_dir, "fx_services")
    act = F.element_at(F.array(*[F.lit(a) for a in ("activate", "deactivate", "no_card", "")]), (F.col("service_id") % 4 + 1).cast("int"))
    actions = services.select("service_id", act.alias("action"), F.lit("1998-02-01").cast("date").alias("final_month")).where("action <> ''")
    out = ch.apply_services(services, actions)
    return out.select("service_id", F.col("is_active").cast("int").alias("is_active"), F.col("uses_p_card").cast("int").alias("uses_p_card"), "final_receipt_month")


def upload_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    submissions, _ = ch.upload_effects(*_views(spark, sf_dir, "receipts", "submissions", "declarations"))
    return submissions.select("user_id", "period_month", "status")


def kept_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, declarations = ch.upload_effects(*_views(spark, sf_dir, "receipts", "submissions", "declarations"))
    return declarations.select("user_id", "service_id", "receipt_month")


def apply_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.apply_declarations(*_views(spark, sf_dir, "declarations", "services", "receipts")).select("user_id", "service_id", "receipt_month")


def user_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table after the removal of stopped users."""
    users, services, submissions, declarations, receipts = _views(spark, sf_dir, "users", "services", "submissions", "declarations", "receipts")
    out = ch.remove_users(users.where("account_status = 'stopped'"), {"services": services, "submissions": submissions, "declarations": declarations}, {"receipts": receipts})
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.count("user_id").alias("with_user")).select(F.lit(name).alias("name"), "n", "with_user") for name, df in out.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def backfill_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.canonical_catalog(view(spark, sf_dir, "fx_services"))[0]


def backfill_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.canonical_catalog(view(spark, sf_dir, "fx_services"))[1]


def manifest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.manifest_paths(view(spark, sf_dir, "fx_receipts"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of receipts: a receipt for each user and type, updated at the event's time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.concat_ws("/", "user_id", "event_type").alias("receipt_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"),
        F.date_format("ts", "yyyy-MM").alias("period_month"),
    )


def stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each receipt after its versions came as a stream of files."""
    versions = staged(_versions(spark, sf_dir).repartition(3, "event_id"), "arrivals-source")
    source = versions.inputFiles()[0].rsplit("/", 1)[0]
    base = f"{stage_folder(spark)}/arrivals-{source.rsplit('-', 1)[-1]}"
    return arrivals.run_arrivals(spark, source, versions.schema, f"{base}/table", f"{base}/checkpoint")


QUERIES = {
    f.__name__: f
    for f in (apply_services, upload_effects, kept_declarations, apply_declarations, user_removal, backfill_catalog, backfill_links, manifest_paths, stream_pending)
}

REMOVED = "user_id IN (SELECT user_id FROM fx_users WHERE account_status = 'stopped')"
ORACLE_SQL = {
    "apply_services": with_clause("fx_services") + """
        SELECT service_id, CASE service_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE CASE WHEN is_active THEN 1 ELSE 0 END END AS is_active,
               CASE WHEN service_id % 4 <> 2 AND uses_p_card THEN 1 ELSE 0 END AS uses_p_card,
               CASE WHEN service_id % 4 = 1 AND uses_p_card THEN DATE '1998-02-01' WHEN service_id % 4 = 3 AND uses_p_card THEN final_receipt_month END AS final_receipt_month
        FROM fx_services""",
    "upload_effects": with_clause("fx_receipts", "fx_submissions") + """
        SELECT s.user_id, s.period_month, CASE WHEN s.status = 'submitted' AND EXISTS (SELECT 1 FROM fx_receipts AS r WHERE r.user_id = s.user_id
               AND CAST(r.receipt_month + INTERVAL 1 MONTH AS DATE) = s.period_month) THEN 'draft' ELSE s.status END AS status
        FROM fx_submissions AS s""",
    "kept_declarations": with_clause("fx_receipts", "fx_declarations") + """
        SELECT user_id, service_id, receipt_month FROM fx_declarations AS d
        WHERE NOT EXISTS (SELECT 1 FROM fx_receipts AS r WHERE r.service_id = d.service_id AND r.receipt_month = d.receipt_month)""",
    "apply_declarations": with_clause("fx_receipts", "fx_declarations", "fx_services") + """
        SELECT user_id, service_id, receipt_month FROM fx_declarations AS d
        WHERE service_id IN (SELECT service_id FROM fx_services WHERE billing_type = 'metered' AND uses_p_card)
              AND NOT EXISTS (SELECT 1 FROM fx_receipts AS r WHERE r.service_id = d.service_id AND r.receipt_month = d.receipt_month)""",
    "user_removal": with_clause("fx_users", "fx_services", "fx_submissions", "fx_declarations", "fx_receipts") + f"""
        SELECT 'services' AS name, count(*) AS n, count(*) AS with_user FROM fx_services WHERE NOT {REMOVED}
        UNION ALL SELECT 'submissions', count(*), count(*) FROM fx_submissions WHERE NOT {REMOVED}
        UNION ALL SELECT 'declarations', count(*), count(*) FROM fx_declarations WHERE NOT {REMOVED}
        UNION ALL SELECT 'receipts', count(*), count(CASE WHEN NOT {REMOVED} THEN 1 END) FROM fx_receipts""",
    "backfill_catalog": with_clause("fx_services") + """
        SELECT min(service_id) AS catalog_id, arg_min(name, service_id) AS name, billing_type, count(*) AS services FROM fx_services GROUP BY lower(name), billing_type""",
    "backfill_links": with_clause("fx_services") + """
        SELECT service_id, min(service_id) OVER (PARTITION BY lower(name), billing_type) AS catalog_id FROM fx_services""",
    "manifest_paths": with_clause("fx_receipts") + """
        SELECT receipt_id, concat(strftime(receipt_month, '%Y-%m'), '/u', user_id, '/', CASE WHEN is_extra THEN 'extra' ELSE 'service' END, '/', receipt_id, '_', receipt_id, '.pdf') AS path
        FROM fx_receipts WHERE file <> '' AND NOT file_deleted""",
    "stream_pending": """
        SELECT receipt_id, event_id, updated_at, period_month FROM (
            SELECT concat(user_id, '/', event_type) AS receipt_id, event_id, epoch_us(ts) AS updated_at, strftime(ts, '%Y-%m') AS period_month,
                   row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) AS v
        WHERE n = 1""",
}
