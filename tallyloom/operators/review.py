"""Review status of receipts, period checks, decisions, and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_of

CHECKS = ("payee", "recipient", "related", "date", "amount", "currency", "period")
DONE = ("generated", "needs_review", "failed", "skipped")


def review_status(receipts: DataFrame) -> DataFrame:
    """receipts (available, reviewed, state, recommended, and a boolean for each of CHECKS) with unchecked,
    all_passed, has_result, needs_review and the exclusive status."""
    missing = F.array_compact(F.array(*[F.when(~F.col(c), c) for c in CHECKS]))
    out = receipts.withColumn("unchecked", F.array_join(missing, ",")).withColumn("all_passed", F.size(missing) == 0)
    out = out.withColumn("has_result", F.col("state").isin(*DONE))
    status = (
        F.when(~F.col("available"), "file_unavailable").when(F.col("reviewed"), "admin_confirmed").when(F.col("state").isin("queued", "processing"), "ai_processing")
        .when(~F.col("has_result"), "ai_unprocessed").when(F.col("recommended"), "resubmission_decision").when(F.col("state").isin("needs_review", "skipped"), "manual_review")
        .when(F.col("all_passed"), "ai_ok").otherwise("manual_review")
    )
    return out.withColumn("status", status).withColumn("needs_review", F.col("available") & F.col("has_result") & ~F.col("all_passed") & ~F.col("reviewed"))


def review_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("status").agg(F.count(F.lit(1)).alias("receipts"), F.count_if(F.col("needs_review")).alias("needs_review"))


def extraction_counters(receipts: DataFrame) -> DataFrame:
    states = ("queued", "processing", *DONE, "none")
    return receipts.groupBy("receipt_month").agg(F.count(F.lit(1)).alias("receipts"), *[F.count_if(F.col("state") == s).alias(s) for s in states])


def period_check(day: Column, expected: Column, checked: Column) -> Column:
    return F.when(~checked, "not_checked").when(day.isNull(), "unknown").when(month_of(day) == expected, "matched").otherwise("mismatched")


def claim_batch(receipts: DataFrame, as_of: str, size: int, stale_minutes: int = 30) -> DataFrame:
    """The next receipts to process: waiting ones, and those that have been in work for too long, oldest first."""
    stale = (F.col("state") == "processing") & (F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {stale_minutes} MINUTES"))
    return receipts.where(F.col("available") & ((F.col("state") == "queued") | stale)).orderBy("updated_at", "receipt_id").limit(size)


def duplicate_keys(table: DataFrame, rule: str, *keys: Column) -> DataFrame:
    """rule, key, n for each key that more than one row holds."""
    named = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return table.groupBy(named.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key", "n")


def rule_violations(table: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule, key for each rule that a row breaks, in one pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]))
    return table.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def resolve_resubmissions(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """request_id of open requests that new receipts resolve.

    Requests of registered services go when a receipt of the same user, month and service is there.
    Extras go one for one: first equal memos, k-th with k-th, then the oldest left with what is left.
    """
    from pyspark.sql import Window

    key = ["user_id", "receipt_month"]
    registered = requests.where("NOT is_extra").join(receipts.where("NOT is_extra").select(*key, "service_id").distinct(), [*key, "service_id"], "left_semi").select("request_id")

    def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    memo = F.lower(F.trim(F.coalesce("memo", F.lit(""))))
    asked = requests.where("is_extra").select(*key, "request_id", "created_at", memo.alias("memo"))
    came = receipts.where("is_extra").select(*key, "receipt_id", memo.alias("memo"))
    a, b = numbered(asked, [*key, "memo"], ["created_at", "request_id"]), numbered(came, [*key, "memo"], ["receipt_id"])
    exact = a.join(b, [*key, "memo", "k"])
    rest_a = numbered(asked.join(exact.select("request_id"), "request_id", "left_anti"), key, ["created_at", "request_id"])
    rest_b = numbered(came.join(exact.select("receipt_id"), "receipt_id", "left_anti"), key, ["receipt_id"])
    return registered.unionByName(exact.select("request_id")).unionByName(rest_a.join(rest_b, [*key, "k"]).select("request_id"))
