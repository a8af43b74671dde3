"""Monthly compliance: which services of which users owe a receipt, for all users and months in one plan.

services: service_id, user_id, catalog_id, name, billing_type, is_active, uses_p_card,
final_receipt_month. receipts: receipt_id, user_id, service_id, receipt_month, file, file_deleted.
declarations: user_id, service_id, receipt_month. users: user_id, is_staff, is_active, account_status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exclusive import numbered_rows


def general_users(users: DataFrame) -> DataFrame:
    return users.where("is_active AND NOT is_staff")


def available(file: Column, deleted: Column) -> Column:
    return (F.coalesce(file, F.lit("")) != "") & ~deleted


def services_in_scope(services: DataFrame, months: DataFrame) -> DataFrame:
    """Services for each month in which they are active, or were until at least then.

    Months are few and broadcast only while they are; they multiply the services by design.
    """
    final = F.col("is_active") | (F.col("final_receipt_month") >= F.col("receipt_month"))
    listed = months.groupBy().agg(F.array_sort(F.collect_set("receipt_month")).alias("months"))
    return services.crossJoin(listed).withColumn("receipt_month", F.explode("months")).drop("months").where(final)


def service_month_status(services: DataFrame, months: DataFrame, receipts: DataFrame, declarations: DataFrame) -> DataFrame:
    """Uploadable services per month with status uploaded, no_usage, api_pending or missing.

    What a service has in each month is a map beside the service, and months are looked up in it where they
    are listed: services, receipts and declarations meet by service, and the product with the months is never shuffled.
    """
    has = receipts.where("service_id IS NOT NULL").groupBy("service_id", "receipt_month").agg(
        F.bool_or(available(F.col("file"), F.col("file_deleted"))).alias("has_receipt"), F.count(F.lit(1)).alias("receipts")
    )
    by_month = F.map_from_entries(F.collect_list(F.struct("receipt_month", F.struct("has_receipt", "receipts")))).alias("has")
    said = declarations.groupBy("service_id").agg(F.collect_set("receipt_month").alias("said"))
    known = services.where("uses_p_card").join(has.groupBy("service_id").agg(by_month), "service_id", "left").join(said, "service_id", "left")
    at = F.try_element_at("has", F.col("receipt_month"))
    declared = F.coalesce(F.array_contains("said", F.col("receipt_month")), F.lit(False))
    metered = F.col("billing_type") == "metered"
    status = F.when(at["has_receipt"], "uploaded").when(metered & declared, "no_usage").when(metered, "api_pending").otherwise("missing")
    return services_in_scope(known, months).withColumn("status", status).withColumn("receipts", F.coalesce(at["receipts"], F.lit(0))).drop("has", "said")


def user_month_summary(status: DataFrame, scope: DataFrame) -> DataFrame:
    """Counts per user and month; scope are all services in scope, with or without card."""
    is_ = lambda s: F.col("status") == s
    metered = F.col("billing_type") == "metered"
    rows = status.groupBy("user_id", "receipt_month").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_("uploaded")).alias("uploaded"), F.count_if(is_("no_usage")).alias("no_usage"),
        F.count_if(~metered).alias("required"), F.count_if(metered).alias("usage_based"), F.count_if(is_("missing")).alias("missing"),
        F.count_if(is_("api_pending")).alias("api_pending"),
    )
    other = scope.groupBy("user_id", "receipt_month").agg(F.count_if(~F.col("uses_p_card")).alias("non_p_card"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "uploaded", "no_usage", "required", "usage_based", "missing", "api_pending")]
    return _verdicts(other.join(rows, ["user_id", "receipt_month"], "left").select("user_id", "receipt_month", *zero, "non_p_card"))


def _verdicts(out: DataFrame) -> DataFrame:
    return (
        out.withColumn("resolved", F.col("uploaded") + F.col("no_usage"))
        .withColumn("complete", (F.col("missing") == 0) & (F.col("api_pending") == 0))
        .withColumn("progress", F.concat_ws("/", "resolved", "total"))
        .withColumn("no_receipt_needed", (F.col("total") > 0) & F.col("complete") & (F.col("no_usage") == F.col("total")))
    )


def submit_check(status: DataFrame, shown: int = 5) -> DataFrame:
    """Per user and month whether it can be submitted, and the first services that block it."""
    blocking = F.col("status").isin("missing", "api_pending")
    names = F.array_sort(F.collect_list(F.when(blocking, F.struct("name", "billing_type"))))
    out = status.groupBy("user_id", "receipt_month").agg(F.count_if(blocking).alias("blocking"), names.alias("names"))
    return out.select(
        "user_id", "receipt_month", (F.col("blocking") == 0).cast("int").alias("can_submit"), "blocking",
        F.array_join(F.transform(F.slice("names", 1, shown), lambda x: x["name"]), ", ").alias("preview"),
        F.greatest(F.col("blocking") - shown, F.lit(0)).alias("more"),
    )


def services_with_marks(services: DataFrame, receipts: DataFrame, declarations: DataFrame) -> DataFrame:
    """Services that are ever in scope with `ends`, the last day of that, and the months that a file (`up`) or a declaration (`said`) covers."""
    there = available(F.col("file"), F.col("file_deleted"))
    has = receipts.where("service_id IS NOT NULL").where(there).groupBy("service_id").agg(F.collect_set("receipt_month").alias("up"))
    said = declarations.groupBy("service_id").agg(F.collect_set("receipt_month").alias("said"))
    ends = F.when(F.col("is_active"), F.to_date(F.lit("9999-12-31"))).otherwise(F.col("final_receipt_month"))
    none = F.array().cast("array<date>")
    known = services.withColumn("ends", ends).where("ends IS NOT NULL").join(has, "service_id", "left").join(said, "service_id", "left")
    return known.withColumns({c: F.coalesce(c, none) for c in ("up", "said")})


MARKS = ("up_metered", "up_other", "no_usage")
SCOPES = ("total", "required", "usage_based", "non_p_card")


def user_scopes(services: DataFrame, receipts: DataFrame, declarations: DataFrame) -> DataFrame:
    """A row for each user: `scopes`, what is in scope until which day, and `marks`, what is covered in which month.

    Services meet at their user once; their months are counted only where something covers them.
    """
    card = F.coalesce("uses_p_card", F.lit(False)) & F.col("user_id").isNotNull()
    metered = F.col("billing_type") == "metered"
    count = lambda c, n: F.coalesce(c, F.lit(False)).cast("long").alias(n)
    zero = lambda names: [F.lit(0).cast("long").alias(n) for n in names]
    base = F.struct(F.lit(False).alias("mark"), F.col("ends").alias("at"), count(card, "total"), count(card & ~metered, "required"), count(card & metered, "usage_based"), count(~F.col("uses_p_card"), "non_p_card"), *zero(MARKS))

    def of(month: Column) -> Column:
        up = F.array_contains("up", month)
        return F.struct(
            F.lit(True).alias("mark"), month.alias("at"), *zero(SCOPES), count(up & metered, "up_metered"), count(up & ~F.coalesce(metered, F.lit(False)), "up_other"), count(~up & metered, "no_usage"),
        )

    covered = F.when(card, F.filter(F.array_union("up", F.when(metered, F.col("said")).otherwise(F.array().cast("array<date>"))), lambda m: m <= F.col("ends")))
    rows = services_with_marks(services, receipts, declarations).repartition("user_id")
    rows = rows.select("user_id", F.explode(F.concat(F.array(base), F.coalesce(F.transform(covered, of), F.array().cast(_items())))).alias("x")).select("user_id", "x.*")
    sums = rows.groupBy("user_id", "mark", "at").agg(*[F.sum(n).alias(n) for n in (*SCOPES, *MARKS)])
    return sums.groupBy("user_id").agg(
        F.collect_list(F.when(~F.col("mark"), F.struct("at", *SCOPES))).alias("scopes"),
        F.map_from_entries(F.collect_list(F.when(F.col("mark"), F.struct("at", F.struct(*MARKS))))).alias("marks"),
    )


def _items() -> str:
    return "array<struct<mark: boolean, at: date, " + ", ".join(f"{n}: bigint" for n in (*SCOPES, *MARKS)) + ">>"


def with_months(rows: DataFrame, months: DataFrame, last: Column) -> DataFrame:
    """rows for each month until `last`; nothing is shuffled after this."""
    listed = months.groupBy().agg(F.array_sort(F.collect_set("receipt_month")).alias("months"))
    return rows.crossJoin(F.broadcast(listed)).withColumn("receipt_month", F.explode(F.filter("months", lambda m: m <= last))).drop("months")


def scope_summary(scopes: DataFrame, months: DataFrame) -> DataFrame:
    """The rows of user_month_summary from user_scopes; further columns of scopes pass through."""
    rest = [c for c in scopes.columns if c not in ("user_id", "scopes", "marks")]
    rows = with_months(scopes, months, F.array_max(F.col("scopes.at")))
    month = F.col("receipt_month")
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in SCOPES])
    rows = rows.withColumn("at", F.aggregate("scopes", start, lambda a, x: F.when(x["at"] >= month, F.struct(*[(a[n] + x[n]).alias(n) for n in SCOPES])).otherwise(a)))
    rows = rows.withColumn("m", F.try_element_at("marks", month))
    mark = {n: F.coalesce(F.col("m")[n], F.lit(0)) for n in MARKS}
    at = F.col("at")
    return _verdicts(rows.select(
        "user_id", "receipt_month", at["total"].alias("total"), (mark["up_metered"] + mark["up_other"]).alias("uploaded"), mark["no_usage"].alias("no_usage"), at["required"].alias("required"),
        at["usage_based"].alias("usage_based"), (at["total"] - at["usage_based"] - mark["up_other"]).alias("missing"), (at["usage_based"] - mark["up_metered"] - mark["no_usage"]).alias("api_pending"),
        at["non_p_card"].alias("non_p_card"), *rest,
    ))


def scope_history(scopes: DataFrame, months: DataFrame, submissions: DataFrame, receipts: DataFrame) -> DataFrame:
    """The rows of history_rows from user_scopes: a user's submissions and receipt counts lie beside its scopes, so all meet by user alone."""
    held, counts = _held(submissions).repartition("user_id"), _receipt_counts(receipts.repartition("user_id"))
    by_month = lambda *names: F.map_from_entries(F.collect_list(F.struct("receipt_month", F.struct(*names))))
    held = held.where("receipt_month IS NOT NULL").groupBy("user_id", "receipt_month").agg(F.collect_list(F.struct("submission")).alias("list"))
    counts = counts.where("receipt_month IS NOT NULL").groupBy("user_id").agg(by_month(*COUNTS).alias("counts"))
    rows = scopes.join(held.groupBy("user_id").agg(by_month("list").alias("held")), "user_id", "left").join(counts, "user_id", "left")
    out = scope_summary(rows, months)
    at = F.try_element_at("counts", F.col("receipt_month"))
    out = out.withColumn("held", F.explode_outer(F.try_element_at("held", F.col("receipt_month"))["list"])).withColumn("submission", F.col("held.submission"))
    return _displayed(out.withColumns({c: F.coalesce(at[c], F.lit(0)) for c in COUNTS}).withColumn("has_submission", F.col("held").isNotNull()).drop("held", "counts"))


def scope_submit_check(services: DataFrame, months: DataFrame, receipts: DataFrame, declarations: DataFrame, shown: int = 5) -> DataFrame:
    """The rows of submit_check; a user's services lie in one row, sorted by name, and each month takes the open ones."""
    metered = F.coalesce(F.col("billing_type") == "metered", F.lit(False))
    said = F.when(metered, F.col("said")).otherwise(F.array().cast("array<date>"))
    one = services_with_marks(services.where("uses_p_card"), receipts, declarations).select("user_id", F.struct("name", "billing_type", "ends", F.array_union("up", said).alias("covered")).alias("s"))
    rows = with_months(one.groupBy("user_id").agg(F.array_sort(F.collect_list("s")).alias("list")), months, F.array_max(F.col("list.ends")))
    month = F.col("receipt_month")
    rows = rows.select("user_id", "receipt_month", F.transform(F.filter("list", lambda s: (s["ends"] >= month) & ~F.array_contains(s["covered"], month)), lambda s: s["name"]).alias("names"))
    blocking = F.size("names").cast("long")
    return rows.select(
        "user_id", "receipt_month", (blocking == 0).cast("int").alias("can_submit"), blocking.alias("blocking"), F.array_join(F.slice("names", 1, shown), ", ").alias("preview"),
        F.greatest(blocking - shown, F.lit(0)).alias("more"),
    )


def user_service_counts(users: DataFrame, services: DataFrame) -> DataFrame:
    on, card = F.col("is_active"), F.col("uses_p_card")
    counts = services.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(on).alias("active"), F.count_if(on & card).alias("active_p_card"), F.count_if(on & ~card).alias("active_non_p_card"),
        F.count_if(F.col("registration_source") == "user").alias("user_registered"), F.count_if(~on & (F.col("deactivation_source") == "user")).alias("user_stopped"),
    )
    names = [c for c in counts.columns if c != "user_id"]
    return general_users(users).select("user_id").join(counts, "user_id", "left").select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def catalog_usage(catalog: DataFrame, services: DataFrame) -> DataFrame:
    used = services.groupBy("catalog_id").agg(
        F.count(F.lit(1)).alias("assigned"), F.countDistinct(F.when(F.col("is_active"), F.col("user_id"))).alias("active_users"), F.count_if(F.col("is_active")).alias("active_services")
    )
    names = ["assigned", "active_users", "active_services"]
    return catalog.select("catalog_id", "name").join(used, "catalog_id", "left").select("catalog_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def account_status(users: DataFrame, services: DataFrame) -> DataFrame:
    """Status that active services imply, for general users only; others keep theirs."""
    active = services.where("is_active").select("user_id").distinct().withColumn("has_active", F.lit(True))
    derived = F.when(F.col("has_active"), "active").otherwise("stopped")
    return users.join(active, "user_id", "left").select("user_id", F.when(F.col("is_staff"), F.col("account_status")).otherwise(derived).alias("account_status"))


def month_display_status(status: Column, required: Column, uploaded: Column) -> Column:
    return F.when(status == "submitted", "submitted").when(required == 0, "not_required").when(status.isNotNull() | (uploaded > 0), "draft").otherwise("not_started")


COUNTS = ("receipts", "available", "extra", "purged")


def _held(submissions: DataFrame) -> DataFrame:
    return submissions.select("user_id", F.add_months("period_month", -1).alias("receipt_month"), F.col("status").alias("submission"))


def _receipt_counts(receipts: DataFrame) -> DataFrame:
    there = available(F.col("file"), F.col("file_deleted"))
    return receipts.groupBy("user_id", "receipt_month").agg(
        F.count(F.lit(1)).alias("receipts"), F.count_if(there).alias("available"), F.count_if(F.col("is_extra")).alias("extra"), F.count_if(F.col("file_deleted")).alias("purged")
    )


def _displayed(joined: DataFrame) -> DataFrame:
    return joined.withColumn("display", month_display_status(F.col("submission"), F.col("total"), F.col("receipts"))).withColumn(
        "attention", (F.col("missing") > 0) | (F.col("api_pending") > 0)
    )


def history_rows(summary: DataFrame, submissions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Per user and receipt month the summary with submission state and receipt counts."""
    keys = ["user_id", "receipt_month"]
    joined = summary.join(_held(submissions), keys, "left").join(_receipt_counts(receipts), keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS})
    return _displayed(joined)


def history_totals(rows: DataFrame) -> DataFrame:
    shown = [F.count_if(F.col("display") == s).alias(s) for s in ("submitted", "not_required", "draft", "not_started")]
    sums = [F.sum(c).alias(c) for c in ("total", "uploaded", "no_usage", "missing", "api_pending", "receipts", "available", "extra", "purged")]
    return rows.groupBy("receipt_month").agg(F.count(F.lit(1)).alias("users"), *shown, *sums, F.count_if(F.col("complete")).alias("complete"), F.count_if(F.col("attention")).alias("attention"))


def reminder_candidates(users: DataFrame, summary: DataFrame, kind: str) -> DataFrame:
    """Active users with an active account to remind: initial for missing receipts, urgent for pending usage too."""
    due = F.col("missing") > 0
    if kind == "urgent":
        due = due | (F.col("api_pending") > 0)
    reached = general_users(users).where("account_status = 'active'")
    return summary.where(due).join(reached.select("user_id", "username", "email"), "user_id")


def reminder_outbox(candidates: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """Messages that are not yet sent: key, and whether the row is new or retries a failed one."""
    key = F.concat_ws(":", F.lit("reminder"), F.lit(kind), F.date_format("receipt_month", "yyyy-MM"), "user_id")
    last = log.groupBy("idempotency_key").agg(F.bool_or(F.col("status") == "sent").alias("sent"))
    keyed = candidates.withColumn("idempotency_key", key).join(last, "idempotency_key", "left")
    return keyed.where("sent IS NULL OR NOT sent").withColumn("action", F.when(F.col("sent").isNull(), "insert").otherwise("retry"))


def statement_receipts(receipts: DataFrame, users: DataFrame) -> DataFrame:
    """Receipts that a statement month is matched with, in their order."""
    usable = receipts.where(available(F.col("file"), F.col("file_deleted"))).where("is_extra OR p_card_snapshot")
    own = usable.join(users.where("NOT is_staff").select("user_id"), "user_id", "left_semi")
    return numbered_rows(own, ["receipt_month"], F.col("issued_on"), [F.col("receipt_id")], "receipt_order")


def historical_receipts(receipts: DataFrame, users: DataFrame, months: DataFrame, back: int = 3) -> DataFrame:
    """Per statement month the receipts of the `back` months before it, whether their files remain or not."""
    spread = months.select(F.col("receipt_month").alias("statement_month"), F.explode(F.sequence(F.lit(1), F.lit(back))).alias("k"))
    wanted = spread.select("statement_month", F.add_months("statement_month", -F.col("k")).alias("receipt_month"))
    kept = receipts.where("is_extra OR p_card_snapshot").join(users.where("NOT is_staff").select("user_id"), "user_id", "left_semi")
    return kept.join(wanted, "receipt_month")


def selectable_catalogs(catalog: DataFrame, users: DataFrame, services: DataFrame) -> DataFrame:
    """Active catalog entries, and how many general users do not hold them yet."""
    owners = services.join(general_users(users).select("user_id"), "user_id", "left_semi").groupBy("catalog_id").agg(F.countDistinct("user_id").alias("owners"))
    people = general_users(users).agg(F.count(F.lit(1)).alias("people"))
    return (
        catalog.where("is_active").select("catalog_id").join(owners, "catalog_id", "left").crossJoin(people)
        .select("catalog_id", (F.col("people") - F.coalesce("owners", F.lit(0))).alias("open_users"))
    )
