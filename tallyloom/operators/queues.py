"""Work queues and triage: what waits, in which order, and why a row is set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import reminder_kind


def exception_queue(requests: DataFrame, size: int) -> DataFrame:
    """The first `size` requests: pending ones first, then the newest."""
    return requests.orderBy(F.when(F.col("status") == "pending", 0).otherwise(1), F.desc("created_at"), F.desc("request_id")).limit(size)


def resubmission_counts(requests: DataFrame) -> DataFrame:
    """Per month the requests and how many are open."""
    return requests.groupBy("receipt_month").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "pending").alias("open"))


def item_triage(items: DataFrame) -> DataFrame:
    """items (confidence, memo, receipt_required, gate_errors, line_date, has_amount) with their triage."""
    manual = (F.col("confidence") >= 1) & F.coalesce("memo", F.lit("")).startswith("管理者")
    triage = (
        F.when(manual, "manual").when(~F.col("receipt_required"), "ignored").when(F.col("gate_errors") > 0, "statement_error")
        .when(F.col("line_date").isNull() | ~F.col("has_amount"), "missing_fields").otherwise("auto")
    )
    return items.withColumn("triage", triage)


def pending_statements(statements: DataFrame, receipts: DataFrame) -> DataFrame:
    """Statements that a changed receipt of their month makes due, but those in work or failed."""
    months = receipts.select("period_month").distinct()
    return statements.where("status NOT IN ('processing', 'failed')").join(months, "period_month", "left_semi")


def declaration_conflicts(matched: DataFrame, declarations: DataFrame) -> DataFrame:
    """Declarations of no usage for services and months that a matched line has."""
    return declarations.join(matched.select("service_id", "receipt_month").distinct(), ["service_id", "receipt_month"], "left_semi")


def reminders_of_days(days: DataFrame, schedule: DataFrame) -> DataFrame:
    """Days with the kind of reminder that runs then; of several schedules the earliest days count."""
    return days.join(F.broadcast(schedule.orderBy("reminder_day", "warning_day").limit(1)), F.lit(True)).select("d", reminder_kind(F.col("d"), F.col("reminder_day"), F.col("warning_day")).alias("kind")).where("kind IS NOT NULL")


def missing_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    return users.join(profiles, "user_id", "left_anti").select("user_id", F.lit("active").alias("account_status"))


def service_changes(services: DataFrame) -> DataFrame:
    """Services that users registered or stopped themselves."""
    return services.where("registration_source = 'user' OR deactivation_source = 'user'")
