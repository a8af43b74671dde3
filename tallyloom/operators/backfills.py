"""Repairs of stored rows after rules have changed: each returns the table with the changed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Reasons of rows that older rules have left.
UNLINKED_NOTE = "旧月次ルールで照合された領収書を解除しました。"


def link_owners(items: DataFrame, receipts: DataFrame, services: DataFrame, statements: DataFrame) -> DataFrame:
    """line_key, user_id, catalog_id of items: those of the matched receipt, else of the matched service, else the
    statement's user."""
    r = receipts.select("receipt_id", F.col("user_id").alias("r_user"), F.col("service_id").alias("r_service"))
    entry = services.select(F.col("service_id").alias("r_service"), F.col("catalog_id").alias("r_catalog"))
    s = services.select("service_id", F.col("user_id").alias("s_user"), F.col("catalog_id").alias("s_catalog"))
    st = statements.select("statement_id", F.col("user_id").alias("t_user"))
    joined = items.select("line_key", "statement_id", "receipt_id", "service_id").join(r.join(entry, "r_service", "left"), "receipt_id", "left").join(s, "service_id", "left").join(st, "statement_id", "left")
    return joined.select("line_key", F.coalesce("r_user", "s_user", "t_user").alias("user_id"), F.coalesce("r_catalog", "s_catalog").alias("catalog_id"))


def upload_actors(receipts: DataFrame) -> DataFrame:
    """receipt_id, uploaded_by, upload_source: receipts without an uploader were uploaded by their user."""
    none = F.col("uploaded_by").isNull()
    return receipts.select("receipt_id", F.coalesce("uploaded_by", "user_id").alias("uploaded_by"), F.when(none, "user").otherwise(F.col("upload_source")).alias("upload_source"))


def shift_months(statements: DataFrame, items: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, items) by the rule that a statement's month is the submission month.

    A statement whose own text names the month after the stored one moves there. Items of statements that
    are neither in work nor failed lose a receipt of another month; unless people decided the item, also
    its user and service, and a match becomes ambiguous.
    """
    parsed = F.when(F.col("statement_period").rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat("statement_period", F.lit("-01")), "yyyy-MM-dd"))
    month = F.trunc("period_month", "month")
    moved = statements.withColumn("period_month", F.when(parsed == F.add_months(month, 1), parsed).otherwise(month))
    held = F.col("status").isin("processing", "failed")
    has = items.select("statement_id").distinct().withColumn("has_items", F.lit(True))
    moved = moved.join(has, "statement_id", "left").withColumn("status", F.when(~held & F.col("has_items"), "needs_review").otherwise(F.col("status"))).drop("has_items")
    months = receipts.select("receipt_id", F.trunc("period_month", "month").alias("receipt_period"))
    target = moved.select("statement_id", F.col("period_month").alias("right_month"), (~held).alias("open"))
    joined = items.join(months, "receipt_id", "left").join(target, "statement_id", "left")
    wrong = F.coalesce(F.col("open") & (F.col("receipt_period") != F.col("right_month")), F.lit(False))
    manual = (F.col("confidence") >= 1) & F.coalesce("memo", F.lit("")).startswith("管理者")
    lost = wrong & ~manual
    memo = F.trim(F.coalesce("memo", F.lit("")))
    noted = F.when(F.contains(memo, F.lit(UNLINKED_NOTE)), memo).otherwise(F.concat_ws(" ", F.when(memo != "", memo), F.lit(UNLINKED_NOTE)))
    return moved, joined.select(
        "line_key", "statement_id", F.when(~wrong, F.col("receipt_id")).alias("receipt_id"), F.when(~lost, F.col("user_id")).alias("user_id"), F.when(~lost, F.col("service_id")).alias("service_id"),
        F.when(lost & (F.col("match_status") == "matched"), "ambiguous").otherwise(F.col("match_status")).alias("match_status"), "confidence", F.when(wrong, noted).otherwise(F.col("memo")).alias("memo"),
    )


def reason_codes(items: DataFrame) -> DataFrame:
    """line_key, reason_code of items that were matched before reasons were kept."""
    manual = (F.col("confidence") >= 1) & F.trim(F.coalesce("memo", F.lit(""))).startswith("管理者")
    receipt, state = F.col("receipt_id").isNotNull(), F.col("match_status")
    code = (
        F.when(state == "ignored", "ignored").when(manual, "manual_confirmed").when(receipt & (state == "matched"), "auto_strong").when(receipt & (state == "ambiguous"), "auto_amount_only")
        .when(F.col("service_id").isNotNull(), "service_only").when(state == "ambiguous", "insufficient_evidence").otherwise("no_compatible_receipt")
    )
    return items.select("line_key", code.alias("reason_code"))


def requeue_incomplete(receipts: DataFrame) -> DataFrame:
    """receipt_id, state, generated_filename, recommended: extracted receipts whose file is there, that nobody has
    confirmed and that lack amount, day or currency, are to be read again."""
    again = F.col("available") & ~F.col("reviewed") & F.col("state").isin("generated", "needs_review", "failed", "skipped") & ~(F.col("amount_ok") & F.col("date_ok") & F.col("currency_ok"))
    return receipts.select(
        "receipt_id", F.when(again, "not_processed").otherwise(F.col("state")).alias("state"), F.when(again, "").otherwise(F.col("generated_filename")).alias("generated_filename"),
        (F.col("recommended") & ~again).alias("recommended"),
    )


def retire_ambiguous(items: DataFrame) -> DataFrame:
    """line_key, match_status: ambiguous matches end as unmatched lines where a receipt is required, as ignored ones else."""
    left = F.when(F.col("receipt_required"), "unmatched").otherwise("ignored")
    return items.select("line_key", F.when(F.col("match_status") == "ambiguous", left).otherwise(F.col("match_status")).alias("match_status"))


def mark_pending(statements: DataFrame, marker: str, most: int = 5000) -> DataFrame:
    """statement_id, memo: statements that are neither in work nor failed get a marker, once."""
    memo = F.trim(F.coalesce("memo", F.lit("")))
    marked = F.substring(F.concat_ws(" ", F.when(memo != "", memo), F.lit(marker)), 1, most)
    due = ~F.col("status").isin("processing", "failed") & ~F.contains(memo, F.lit(marker))
    return statements.select("statement_id", F.when(due, marked).otherwise(F.col("memo")).alias("memo"))


def unconfirm_mismatches(receipts: DataFrame) -> DataFrame:
    """receipt_id, period_state, reviewed: confirmed receipts whose month turned out to be another one are open again."""
    same = F.trunc("issued_on", "month") == F.trunc("receipt_month", "month")
    state = F.when(~F.col("checked"), "not_checked").when(F.col("issued_on").isNull(), "unknown").when(same, "matched").otherwise("mismatched")
    return receipts.select("receipt_id", state.alias("period_state"), (F.col("reviewed") & (state != "mismatched")).alias("reviewed"))
