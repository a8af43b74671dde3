"""Month statistics in one pass over facts, lists behind the counts, audits of keys and rules, and batches by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compliance import available, general_users
from .exclusive import placed_rows
from .review import DONE

#: Counters of receipts of a month; columns as of review.review_status.
REVIEW_COUNTERS = {
    "ai_pending": "available AND state = 'none'",
    "ai_ready": "available AND state = 'none'",
    "ai_processing": "available AND state IN ('queued', 'processing')",
    "ai_queued": "available AND state = 'queued'",
    "ai_review": "available AND NOT reviewed AND state IN ('needs_review', 'failed')",
    "period_mismatch": "available AND NOT reviewed AND period_state = 'mismatched'",
    "manual_review": "available AND NOT reviewed AND has_result AND NOT all_passed",
    "recipient_name_review": "available AND NOT reviewed AND has_result AND NOT recipient",
    "service_payee_review": "available AND NOT reviewed AND has_result AND NOT related",
    "resubmission_decision": "available AND NOT reviewed AND recommended",
}
#: Counters of users of a month; columns as of compliance.history_rows and user_service_counts.
USER_COUNTERS = {
    "total_users": "1",
    "active_users": "int(account_status = 'active')",
    "submitted": "int(display = 'submitted')",
    "draft": "int(display = 'draft')",
    "not_started": "int(display = 'not_started')",
    "not_required": "int(display = 'not_required')",
    "incomplete_users": "int(NOT complete)",
    "missing_services": "missing",
    "api_pending_services": "api_pending",
    "api_pending_users": "int(api_pending > 0)",
    "receipts": "receipts",
    "available_files": "available",
    "active_services": "active",
    "active_p_card_services": "active_p_card",
    "active_non_p_card_services": "active_non_p_card",
    "user_registered": "user_registered",
    "user_stopped": "user_stopped",
}
OPEN = "open_resubmissions"
STATISTICS = [*USER_COUNTERS, *REVIEW_COUNTERS, OPEN]


def month_facts(history: DataFrame, users: DataFrame, service_counts: DataFrame, reviewed: DataFrame, requests: DataFrame) -> DataFrame:
    """receipt_month, user_id and STATISTICS: rows of users, receipts and requests, each with its own counters and 0 for the rest."""
    people = general_users(users).select("user_id", "account_status")
    rows = history.join(people, "user_id").join(service_counts.drop("total"), "user_id")
    one = rows.select("receipt_month", "user_id", *[F.expr(e).cast("long").alias(n) for n, e in USER_COUNTERS.items()])
    checked = reviewed.join(people, "user_id", "left_semi").select("receipt_month", "user_id", *[F.coalesce(F.expr(e), F.lit(False)).cast("long").alias(n) for n, e in REVIEW_COUNTERS.items()])
    asked = requests.where("status = 'pending'").join(people, "user_id", "left_semi").select("receipt_month", "user_id", F.lit(1).cast("long").alias(OPEN))
    out = one.unionByName(checked, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    return out.select("receipt_month", "user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in STATISTICS])


def month_statistics(facts: DataFrame) -> DataFrame:
    """STATISTICS for each user and month, each month, and overall (level 0, 1 and 3), with needs_attention at the first level.

    One aggregation over grouping sets: tasks combine their facts before the shuffle, and no month is one task.
    """
    month, user = F.col("receipt_month"), F.col("user_id")
    sets = [[month, user], [month], []]
    out = facts.groupingSets(sets, month, user).agg(F.grouping_id().cast("int").alias("level"), *[F.sum(n).alias(n) for n in STATISTICS])
    due = (F.col("missing_services") > 0) | (F.col("api_pending_services") > 0) | (F.col("manual_review") > 0)
    return out.withColumn("needs_attention", F.when(F.col("level") == 0, due))


def own_history(history: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each user's submitted or started months, with how many services are still open in them."""
    held = submissions.select("user_id", F.add_months("period_month", -1).alias("receipt_month"), F.col("status").alias("submission_status"))
    return held.join(history.drop("submission"), ["user_id", "receipt_month"]).select(
        "user_id", "receipt_month", "submission_status", "display", (F.col("missing") + F.col("api_pending")).alias("remaining"), "receipts", (F.col("available") > 0).alias("has_files"),
    )


def submission_list(submissions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Submissions with their receipts and how many files of these are there; one without receipts counts 0."""
    there = available(F.col("file"), F.col("file_deleted"))
    counts = receipts.groupBy("user_id", F.add_months("receipt_month", 1).alias("period_month")).agg(F.count(F.lit(1)).alias("receipts"), F.count_if(there).alias("available_files"))
    joined = submissions.join(counts, ["user_id", "period_month"], "left")
    return joined.select("user_id", "period_month", "status", F.coalesce("receipts", F.lit(0)).alias("receipts"), F.coalesce("available_files", F.lit(0)).alias("available_files"))


def resubmission_rows(requests: DataFrame, users: DataFrame, services: DataFrame) -> DataFrame:
    """Requests with user and service names and their place in the month's list: by status, user, service, time."""
    named = requests.join(users.select("user_id", "username"), "user_id", "left").join(services.select("service_id", F.col("name").alias("service_name")), "service_id", "left")
    order = [F.col(c) for c in ("status", "username", "service_name", "created_at", "request_id")]
    return placed_rows(named, ["receipt_month"], order, "place")


def open_resubmissions(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that have an open request, and how many."""
    return requests.where("status = 'pending'").groupBy(*keys).agg(F.count(F.lit(1)).alias("open"))


def active_assignments(catalog: DataFrame, services: DataFrame, users: DataFrame) -> DataFrame:
    """Active services of catalog entries with their users: a row for each instead of a list for each entry."""
    held = services.where("is_active").select("catalog_id", "service_id", "user_id", "uses_p_card")
    return catalog.select("catalog_id", F.col("name").alias("catalog_name")).join(held, "catalog_id").join(users.select("user_id", "username"), "user_id")


def offered_catalogs(catalog: DataFrame, services: DataFrame, users: DataFrame) -> DataFrame:
    """Catalog entries that active general users hold with a card: those offered where a statement line is read."""
    held = services.where("is_active AND uses_p_card").join(general_users(users).select("user_id"), "user_id", "left_semi")
    return catalog.join(held.select("catalog_id").distinct(), "catalog_id", "left_semi")


def managed_receipts(receipts: DataFrame, users: DataFrame, month: Column | None = None) -> DataFrame:
    """Receipts of users that staff manage, with whether the user is active; of one month if given."""
    kept = receipts.join(users.where("NOT is_staff").select("user_id", F.col("is_active").alias("user_active")), "user_id")
    return kept if month is None else kept.where(F.col("receipt_month") == month)


def repeated_keys(tables: dict[str, tuple[DataFrame, dict[str, tuple[Column | None, list[Column]]]]]) -> DataFrame:
    """rule, key, n for each key that more than one row holds.

    tables: name -> (table, {rule: (rows it is about or None for all, columns)}). Each table is read once, its
    rows stand under each of its rules, and all rules are counted by one aggregation. Rows with a null key column are not counted.
    """
    out = None
    for table, rules in tables.values():
        keys = []
        for rule, (about, columns) in rules.items():
            filled = F.lit(True) if about is None else F.coalesce(about, F.lit(False))
            for c in columns:
                filled = filled & c.isNotNull()
            keys.append(F.when(filled, F.struct(F.lit(rule).alias("rule"), F.concat_ws("|", *[c.cast("string") for c in columns]).alias("key"))))
        one = table.select(F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.rule", "k.key")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def purge_batches(receipts: DataFrame, as_of: Column, size: int, dry_run: bool = True) -> DataFrame:
    """Expired files in the order in which they go: kind, receipt_id, file, expires_at, place, batch.

    receipts: kind, receipt_id, file, file_deleted, expires_at. Places run within a kind from 1, by expiry and
    receipt_id, over sorted parts and their counts, so no task sorts a kind alone; batch b holds places b * size + 1 to (b + 1) * size.
    dry_run only lists; else the rows come as they are afterwards, with file empty, purged_at set and all else kept.
    """
    due = receipts.where(available(F.col("file"), F.col("file_deleted")) & (F.col("expires_at") <= as_of))
    listed = placed_rows(due, ["kind"], [F.col("expires_at"), F.col("receipt_id")], "place").withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long"))
    if dry_run:
        return listed
    return listed.withColumn("purged_file", F.col("file")).withColumn("file", F.lit("")).withColumn("file_deleted", F.lit(True)).withColumn("purged_at", as_of)


def filtered_reviews(reviewed: DataFrame, status: str | None) -> DataFrame:
    """Receipts of one review status (all if None) with their place, newest first, within the month."""
    kept = reviewed if status is None else reviewed.where(F.col("status") == status)
    return placed_rows(kept, ["receipt_month"], [F.desc("issued_on"), F.desc("receipt_id")], "place")


def review_flags(reviewed: DataFrame) -> DataFrame:
    """reviewed with the optional check counted in and the derived flags.

    optional_passed: the one check that is not required, null where it does not apply. can_request: a file
    with a result, not confirmed; needs_decision: of those, where a new submission is recommended.
    """
    can = F.col("available") & F.col("state").isin(*DONE) & ~F.col("reviewed")
    label = (
        F.when(F.col("reviewed"), "confirmed").when(F.col("state").isin("queued", "processing"), "processing").when(~F.col("has_result"), "unprocessed")
        .when(F.col("recommended"), "decision").when(~F.col("all_passed"), "manual").otherwise("ok")
    )
    return (
        reviewed.withColumn("optional_passed", F.when(F.col("card_checked"), F.col("card"))).withColumn("can_request", can).withColumn("needs_decision", can & F.col("recommended"))
        .withColumn("unchecked_all", F.concat_ws(",", F.when(F.col("unchecked") != "", F.col("unchecked")), F.when(F.col("card_checked") & ~F.col("card"), "card"))).withColumn("label", label)
    )
