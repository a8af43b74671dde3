"""Requests for services and for new receipts: checks, approvals and their effects, as joins of tables.

services: service_id, user_id, catalog_id, name, billing_type, is_active, uses_p_card, memo,
registration_source, deactivation_source, final_receipt_month. requests: request_id, user_id,
service_name, billing_type, uses_p_card, purpose, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line
from .exclusive import numbered_rows

SERVICE_COLUMNS = ["service_id", "user_id", "catalog_id", "name", "billing_type", "is_active", "uses_p_card", "memo", "registration_source", "deactivation_source", "final_receipt_month"]
#: Rows of one bucket when ids are given to new rows.
ID_BUCKET = 4096


def _low(name: str) -> Column:
    return F.lower(one_line(F.col(name)))


def _noted(memo: Column, note: Column) -> Column:
    """memo with the notes behind it that it does not hold; note is an array."""
    held = F.trim(F.coalesce(memo, F.lit("")))
    new = F.filter(note, lambda n: ~F.contains(held, n))
    return F.array_join(F.filter(F.concat(F.array(held), new), lambda x: x != ""), "\n")


def request_problems(requests: DataFrame, services: DataFrame, catalog: DataFrame, waiting: DataFrame) -> DataFrame:
    """request_id, problems: why a request should not be filed: an active service, a catalog entry (active or
    not) or a waiting request of the same name, in any case, and billing type."""
    keyed = requests.withColumn("low", _low("service_name"))
    mine = services.where("is_active").select("user_id", _low("name").alias("low"), "billing_type").distinct().withColumn("used", F.lit(True))
    first = Window.partitionBy("low", "billing_type").orderBy("catalog_id")
    entries = catalog.withColumn("low", _low("name")).withColumn("k", F.row_number().over(first)).where("k = 1").select("low", "billing_type", F.col("is_active").alias("entry_active"))
    asked = waiting.where("status = 'pending'").select("user_id", _low("service_name").alias("low"), "billing_type", F.col("request_id").alias("other"))
    asked = asked.groupBy("user_id", "low", "billing_type").agg(F.min("other").alias("low_id"), F.max("other").alias("high_id"))
    out = keyed.join(mine, ["user_id", "low", "billing_type"], "left").join(entries, ["low", "billing_type"], "left").join(asked, ["user_id", "low", "billing_type"], "left")
    another = (F.col("low_id") != F.col("request_id")) | (F.col("high_id") != F.col("request_id"))
    problems = F.array_compact(
        F.array(F.when(F.col("used"), "already used"), F.when(F.col("entry_active"), "in catalog").when(~F.col("entry_active"), "in catalog, inactive"), F.when(another, "already asked"))
    )
    return out.select("request_id", F.array_join(problems, ",").alias("problems"))


def approve_requests(requests: DataFrame, decisions: DataFrame, services: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, services, catalog) after decisions (request_id, action approve or reject) on pending requests.

    An approved name gets the catalog entry of that name, in any case, and billing type: the one of
    lowest id, made active, or a new one. The user's service of that name and billing of lowest id is made
    active and takes the entry, the request's card flag and its purpose, once; otherwise a new service is made. New ids
    follow the largest ones. Of several approved requests of one user and name the latest id decides the flag.
    """
    judged = requests.join(decisions, "request_id", "left").withColumn("low", _low("service_name"))
    pending = F.col("status") == "pending"
    yes = judged.where(pending & (F.col("action") == "approve"))
    state = F.when(pending & (F.col("action") == "approve"), "approved").when(pending & (F.col("action") == "reject"), "rejected").otherwise(F.col("status"))
    after = judged.select("request_id", "user_id", "service_name", "billing_type", state.alias("status"))

    names = yes.groupBy("low", "billing_type").agg(F.min_by(one_line(F.col("service_name")), "request_id").alias("new_name"))
    known = catalog.withColumn("low", _low("name")).groupBy("low", "billing_type").agg(F.min("catalog_id").alias("catalog_id"))
    asked = names.join(known, ["low", "billing_type"], "left")
    top = catalog.agg(F.coalesce(F.max("catalog_id"), F.lit(0)).alias("top"))
    fresh = numbered_rows(asked.where("catalog_id IS NULL"), [], F.substring("low", 1, 2), [F.col("low"), F.col("billing_type")], "k").crossJoin(F.broadcast(top))
    fresh = fresh.select("low", "billing_type", (F.col("top") + F.col("k")).alias("catalog_id"), F.col("new_name").alias("name"))
    woken = asked.where("catalog_id IS NOT NULL").select("catalog_id", F.lit(True).alias("woken"))
    entries = catalog.select("catalog_id", "name", "billing_type", "is_active").join(woken, "catalog_id", "left")
    entries = entries.select("catalog_id", "name", "billing_type", (F.col("is_active") | F.coalesce("woken", F.lit(False))).alias("is_active"))
    entries = entries.unionByName(fresh.select("catalog_id", "name", "billing_type", F.lit(True).alias("is_active")))

    targets = asked.where("catalog_id IS NOT NULL").select("low", "billing_type", "catalog_id").unionByName(fresh.select("low", "billing_type", "catalog_id"))
    wishes = yes.groupBy("user_id", "low", "billing_type").agg(
        F.max_by("uses_p_card", "request_id").alias("card"), F.transform(F.array_sort(F.collect_list(F.struct("request_id", "purpose"))), lambda x: F.concat(F.lit("例外申請用途: "), x["purpose"])).alias("notes")
    ).join(targets, ["low", "billing_type"]).join(entries.select("catalog_id", F.col("name").alias("entry_name")), "catalog_id")
    held = services.withColumn("low", _low("name"))
    mine = held.groupBy("user_id", "low", "billing_type").agg(F.min("service_id").alias("service_id"))
    wishes = wishes.join(mine, ["user_id", "low", "billing_type"], "left")
    w = wishes.where("service_id IS NOT NULL").select("service_id", F.struct("catalog_id", "entry_name", "card", "notes").alias("w"))
    joined = services.join(w, "service_id", "left")
    got, new = F.col("w").isNotNull(), F.col("w")
    changed = joined.select(
        "service_id", "user_id", F.when(got, new["catalog_id"]).otherwise(F.col("catalog_id")).alias("catalog_id"), F.when(got, new["entry_name"]).otherwise(F.col("name")).alias("name"), "billing_type",
        (F.col("is_active") | got).alias("is_active"), F.when(got, new["card"]).otherwise(F.col("uses_p_card")).alias("uses_p_card"),
        F.when(got, _noted(F.col("memo"), new["notes"])).otherwise(F.col("memo")).alias("memo"), F.when(got, "exception_request").otherwise(F.col("registration_source")).alias("registration_source"),
        F.when(got, "").otherwise(F.col("deactivation_source")).alias("deactivation_source"), F.when(~got, F.col("final_receipt_month")).alias("final_receipt_month"),
    )
    top = services.agg(F.coalesce(F.max("service_id"), F.lit(0)).alias("top"))
    made = numbered_rows(wishes.where("service_id IS NULL").drop("service_id"), [], F.floor(F.col("user_id") / ID_BUCKET), [F.col("user_id"), F.col("low"), F.col("billing_type")], "k").crossJoin(F.broadcast(top))
    made = made.select(
        (F.col("top") + F.col("k")).alias("service_id"), "user_id", "catalog_id", F.col("entry_name").alias("name"), "billing_type", F.lit(True).alias("is_active"), F.col("card").alias("uses_p_card"),
        F.array_join("notes", "\n").alias("memo"), F.lit("exception_request").alias("registration_source"), F.lit("").alias("deactivation_source"), F.lit(None).cast("date").alias("final_receipt_month"),
    )
    return after, changed.unionByName(made), entries


def register_services(wanted: DataFrame, services: DataFrame, catalog: DataFrame) -> DataFrame:
    """Services after users chose catalog entries (user_id, catalog_id, uses_p_card, memo), each at most once: the user's
    service of lowest id with that entry, or its name, in any case, and billing, comes back to life with the
    entry's name; otherwise a new one is made."""
    chosen = wanted.join(catalog.select("catalog_id", F.col("name").alias("entry_name"), F.col("billing_type").alias("entry_billing")), "catalog_id")
    keyed = chosen.withColumn("low", _low("entry_name"))
    by_entry = keyed.join(services.select("user_id", "catalog_id", "service_id"), ["user_id", "catalog_id"]).select("user_id", "catalog_id", "service_id")
    pool = services.select("user_id", _low("name").alias("low"), F.col("billing_type").alias("entry_billing"), "service_id")
    by_name = keyed.join(pool, ["user_id", "low", "entry_billing"]).select("user_id", "catalog_id", "service_id")
    mine = by_entry.unionByName(by_name).groupBy("user_id", "catalog_id").agg(F.min("service_id").alias("service_id"))
    full = keyed.join(mine, ["user_id", "catalog_id"], "left")
    old = full.where("service_id IS NOT NULL").groupBy("service_id").agg(F.max(F.struct("catalog_id", "entry_name", "entry_billing", F.col("uses_p_card").alias("card"), F.col("memo").alias("said"))).alias("w"))
    got, w = F.col("w").isNotNull(), F.col("w")
    changed = services.join(old, "service_id", "left").select(
        "service_id", "user_id", F.coalesce(w["catalog_id"], F.col("catalog_id")).alias("catalog_id"), F.coalesce(w["entry_name"], F.col("name")).alias("name"), F.coalesce(w["entry_billing"], F.col("billing_type")).alias("billing_type"),
        (F.col("is_active") | got).alias("is_active"), F.coalesce(w["card"], F.col("uses_p_card")).alias("uses_p_card"), F.coalesce(F.when(F.trim(w["said"]) != "", F.trim(w["said"])), F.col("memo")).alias("memo"),
        F.when(got, "user").otherwise(F.col("registration_source")).alias("registration_source"), F.when(got, "").otherwise(F.col("deactivation_source")).alias("deactivation_source"),
        F.when(~got, F.col("final_receipt_month")).alias("final_receipt_month"),
    )
    top = services.agg(F.coalesce(F.max("service_id"), F.lit(0)).alias("top"))
    made = numbered_rows(full.where("service_id IS NULL").drop("service_id"), [], F.floor(F.col("user_id") / ID_BUCKET), [F.col("user_id"), F.col("catalog_id")], "k").crossJoin(F.broadcast(top))
    made = made.select(
        (F.col("top") + F.col("k")).alias("service_id"), "user_id", "catalog_id", F.col("entry_name").alias("name"), F.col("entry_billing").alias("billing_type"), F.lit(True).alias("is_active"), "uses_p_card",
        F.trim(F.coalesce("memo", F.lit(""))).alias("memo"), F.lit("user").alias("registration_source"), F.lit("").alias("deactivation_source"), F.lit(None).cast("date").alias("final_receipt_month"),
    )
    return changed.unionByName(made)


def rename_entries(services: DataFrame, catalog: DataFrame, renamed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(services, catalog) after entries took new names and billing types (catalog_id, new_name, new_billing): services follow."""
    news = F.broadcast(renamed) if renamed.isEmpty() else renamed

    def follow(df: DataFrame) -> DataFrame:
        joined = df.join(news, "catalog_id", "left")
        return joined.withColumn("name", F.coalesce("new_name", "name")).withColumn("billing_type", F.coalesce("new_billing", "billing_type")).select(df.columns)

    return follow(services), follow(catalog)


def resubmission_message(receipts: DataFrame) -> Column:
    """The reason for a resubmission, as its user reads it: the given one, else that of the recommendation (what
    follows 理由:, its first line), else the unchecked items, else a general one; no final full stop."""
    advice = F.trim(F.coalesce("recommendation", F.lit("")))
    cut = F.when(F.contains(advice, F.lit("理由:")), F.trim(F.element_at(F.split(advice, "理由:", 2), -1))).otherwise(advice)
    first = F.trim(F.element_at(F.split(cut, r"\r?\n"), 1))
    given = F.trim(F.coalesce("reason", F.lit("")))
    reason = (
        F.when(given != "", given).when(advice != "", first).when(F.coalesce("unchecked", F.lit("")) != "", F.concat(F.lit("管理者確認で未確認項目が残りました: "), "unchecked"))
        .otherwise("管理者が領収書本体を確認し、再提出が必要と判断しました")
    )
    return F.rtrim(F.substring(reason, 1, 1000), F.lit("。．. "))


def request_resubmissions(receipts: DataFrame, asked: DataFrame, submissions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, receipts, submissions): receipts that people send back become requests and are removed, their
    submitted months are drafts again. asked: receipt_id, reason. Only receipts with an extraction result
    (has_result) can be sent back."""
    gone = receipts.where("has_result").join(asked, "receipt_id")
    requests = gone.select("receipt_id", "user_id", "period_month", "service_name", "billing_type", "is_extra", "memo", resubmission_message(gone).alias("message"), F.lit("open").alias("status"))
    left = receipts.join(gone.select("receipt_id"), "receipt_id", "left_anti")
    touched = gone.select("user_id", "period_month").distinct().withColumn("touched", F.lit(True))
    joined = submissions.join(touched, ["user_id", "period_month"], "left")
    reopened = joined.withColumn("status", F.when(F.col("touched") & (F.col("status") == "submitted"), "draft").otherwise(F.col("status"))).drop("touched")
    return requests, left, reopened


def delete_requests(requests: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Requests without those of the months (period_month), or without all of them."""
    return requests.limit(0) if months is None else requests.join(months, "period_month", "left_anti")


def drop_empty_submissions(submissions: DataFrame, receipts: DataFrame, removed: DataFrame) -> DataFrame:
    """Submissions without those whose last receipt is among the removed ones."""
    keys = ["user_id", "period_month"]
    hit = removed.select(*keys).distinct().join(receipts.join(removed.select("receipt_id"), "receipt_id", "left_anti").select(*keys).distinct(), keys, "left_anti")
    return submissions.join(hit, keys, "left_anti")


def resolve_off_card(requests: DataFrame, off: DataFrame) -> DataFrame:
    """Requests, with open ones of services that left the card resolved. off: user_id, name, billing_type."""
    gone = off.select("user_id", _low("name").alias("low"), "billing_type").distinct().withColumn("off", F.lit(True))
    joined = requests.withColumn("low", _low("service_name")).join(gone, ["user_id", "low", "billing_type"], "left")
    hit = F.coalesce("off", F.lit(False)) & ~F.col("is_extra") & (F.col("status") == "open")
    return joined.withColumn("status", F.when(hit, "resolved").otherwise(F.col("status"))).drop("low", "off")


def arrival_snapshots(receipts: DataFrame, services: DataFrame, months_kept: int) -> DataFrame:
    """Arriving receipts with what their service was called then; extras belong to none. The file expires
    months_kept months (1 to 3) after the upload."""
    own = services.select("service_id", F.struct("name", "billing_type", "uses_p_card").alias("s"))
    joined = receipts.join(own, "service_id", "left")
    extra, kept = F.col("is_extra"), max(1, min(3, months_kept))
    expiry = F.col("uploaded_at") + F.expr(f"make_ym_interval(0, {kept})")
    return joined.select(
        *[c for c in receipts.columns if c != "currency"], F.upper(F.coalesce("currency", F.lit(""))).alias("currency"), F.when(extra, "その他").otherwise(F.coalesce("s.name", F.lit(""))).alias("service_name"),
        F.when(extra, "other").otherwise(F.col("s.billing_type")).alias("billing_type"), F.when(extra, False).otherwise(F.coalesce("s.uses_p_card", F.lit(False))).alias("p_card_snapshot"),
        F.when(F.coalesce("file", F.lit("")) != "", expiry).alias("expires_at"),
    )


def remove_statements(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with statement_id without the rows of removed statements."""
    ids = gone.select("statement_id").distinct()
    return {name: df.join(ids, "statement_id", "left_anti") for name, df in tables.items()}
