"""Messages to users: texts from templates, an outbox whose keys send nothing twice, and counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import service_name

URGENT_MARK = "【重要】"


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy年MM月")


def month_query(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def service_list(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One text per key with a line for each service (name, billing_type), in the order of the names."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "billing_type"))), lambda s: F.concat(F.lit("・"), service_name(s["name"], s["billing_type"])))
    return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias(name))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced; names without a value stay. Values are not searched for names."""
    pieces = F.regexp_extract_all(template, F.lit(r"(?s)(\{\w+\}|[^{]+|\{)"), F.lit(1))
    known = F.create_map(*[x for n, v in values.items() for x in (F.lit("{%s}" % n), v)])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def reminder_messages(candidates: DataFrame, status: DataFrame, kind: str, subject: str, body: str, app: str, url: str) -> DataFrame:
    """user_id, receipt_month, subject, body of each reminder. candidates: user_id, receipt_month, user_name.
    status are the service-month rows of compliance.service_month_status."""
    keys = ["user_id", "receipt_month"]
    joined = candidates
    for name, state in (("missing_services", "missing"), ("api_pending_services", "api_pending")):
        joined = joined.join(service_list(status.where(F.col("status") == state), keys, name), keys, "left").withColumn(name, F.coalesce(name, F.lit("・なし")))
    values = {
        "app_name": F.lit(app), "user_name": F.col("user_name"), "target_month": month_label(F.add_months("receipt_month", 1)), "receipt_month": month_label(F.col("receipt_month")),
        "upload_url": F.concat(F.lit(f"{url}?receipt_month="), month_query(F.col("receipt_month"))), "missing_services": F.col("missing_services"), "api_pending_services": F.col("api_pending_services"),
    }
    title = F.trim(rendered(F.lit(subject), values))
    if kind == "urgent":
        title = F.when(title.startswith(URGENT_MARK), title).otherwise(F.concat(F.lit(URGENT_MARK), title))
    return joined.select(*keys, F.substring(title, 1, 255).alias("subject"), rendered(F.lit(body), values).alias("body"))


def resubmission_messages(requests: DataFrame, app: str, url: str) -> DataFrame:
    """request_id, subject, body of notices. requests: request_id, user_name, period_month, service_name,
    billing_type, is_extra, filename, message."""
    month = F.add_months("period_month", -1)
    shown = F.when(F.col("is_extra"), "その他").otherwise(service_name(F.col("service_name"), F.col("billing_type")))
    file = F.when(F.coalesce("filename", F.lit("")) != "", F.col("filename")).otherwise("-")
    subject = F.concat(F.lit(f"【再提出依頼】{app}: "), month_label(month), F.lit("分 "), shown, F.lit(" の領収書を再度アップロードしてください"))
    body = F.concat(
        F.col("user_name"), F.lit(" 様\n\n対象領収書月: "), month_label(month), F.lit("\n対象サービス: "), shown, F.lit("\n対象ファイル: "), file, F.lit("\n\n"), F.trim("message"),
        F.lit(f"\n\n以下のページから正しい領収書を再度アップロードしてください。\n{url}?receipt_month="), month_query(month),
    )
    return requests.select("request_id", F.substring(subject, 1, 255).alias("subject"), body.alias("body"))


def outbox(candidates: DataFrame, log: DataFrame, kind: str, force: str | None = None) -> DataFrame:
    """candidates (user_id, receipt_month, email, stopped) with idempotency_key and action: sent keys are left
    out, failed ones retried in place, others inserted; users who may get no mail are logged as skipped. With
    `force` all are sent anew under keys with that suffix."""
    address = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    key = F.concat(F.lit(f"{kind}:"), month_query(F.add_months("receipt_month", 1)), F.lit(":user-"), F.col("user_id").cast("string"), F.lit(":"), address)
    keyed = candidates.withColumn("idempotency_key", key if force is None else F.concat(key, F.lit(f":force:{force}")))
    known = log.groupBy("idempotency_key").agg(F.bool_or(F.col("status") == "sent").alias("sent"))
    joined = keyed.join(known, "idempotency_key", "left").where("sent IS NULL OR NOT sent")
    action = F.when(F.col("sent").isNull(), "insert").otherwise("retry")
    return joined.withColumn("action", action).withColumn("status", F.when(F.col("stopped"), "skipped").otherwise("pending")).drop("sent")


def run_counts(selected: DataFrame, results: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row per month: selected, sent, skipped, failed and already_sent of a run, or the selection alone of a dry one.

    results: receipt_month, status of what was tried; what was selected and not tried was sent before.
    """
    chosen = selected.groupBy("receipt_month").agg(F.count(F.lit(1)).alias("selected"))
    states = ("sent", "skipped", "failed")
    if dry_run:
        return chosen.select("receipt_month", "selected", *[F.lit(0).cast("long").alias(s) for s in (*states, "already_sent")])
    tried = results.groupBy("receipt_month").agg(F.count(F.lit(1)).alias("tried"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    return chosen.join(tried, "receipt_month", "left").na.fill(0).select("receipt_month", "selected", *states, (F.col("selected") - F.col("tried")).alias("already_sent"))
