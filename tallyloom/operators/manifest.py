"""The monthly manifest: one sheet of text columns for each month, and its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compliance import available
from .exclusive import placed_rows

# What codes are called in the sheet.
SUBMISSION = {"draft": "未提出領収書あり", "submitted": "提出済み"}
BILLING = {"subscription": "サブスク", "metered": "従量課金 / API", "one_time": "一回払い", "other": "その他"}
UPLOAD = {"user": "ユーザー本人", "admin": "管理者代理"}
EXTRACTION = {
    "not_processed": "未確認", "queued": "AI待機中", "processing": "AI抽出中", "generated": "作成済み", "needs_review": "要確認", "failed": "失敗", "skipped": "スキップ",
}
PERIOD = {"not_checked": "未確認", "matched": "対象領収書月確認済み", "mismatched": "対象領収書月不一致", "unknown": "確認不可"}
REVIEW = {"not_reviewed": "未確認", "confirmed": "管理者確認済み"}
STORED, DELETED, ABSENT = "保存中", "削除済み", "未保存"

# The columns of the sheet in their order. Each comes from the column of its name unless
# another is given, as text, or as what its kind says: a dictionary of labels, yes or no, an ISO time, sorted JSON.
COLUMNS: tuple[tuple, ...] = (
    ("period_month", "month"), ("username",), ("email",), ("submission_status", SUBMISSION), ("submitted_at", "time"), ("receipt_kind", "kind"), ("service_name", "text", "service_name_snapshot"),
    ("billing_type", BILLING, "billing_type_snapshot"), ("p_card_usage_at_upload", "yes", "p_card_snapshot"), ("amount",), ("currency",), ("issued_on",), ("upload_source", UPLOAD),
    ("uploaded_by", "uploader"), ("uploaded_at", "time"), ("expires_at", "time"), ("file_status", "file"), ("display_filename", "shown"), ("original_filename",),
    ("ai_filename_status", EXTRACTION), ("ai_filename_admin_memo",), ("ai_extracted_payee",), ("ai_extracted_service_label",), ("ai_extracted_plan_name",),
    ("plan_change_details", "json"), ("ai_extracted_recipient_name",), ("ai_extracted_card_last4",), ("ai_receipt_month",), ("ai_period_check_status", PERIOD), ("ai_period_check_memo",),
    ("ai_check_card_last4", "yes"), ("ai_check_payee", "yes"), ("ai_check_recipient_name", "yes"), ("ai_recipient_name_check_memo",), ("ai_check_service_payee_related", "yes"),
    ("ai_service_payee_check_memo",), ("ai_check_date", "yes"), ("ai_check_amount", "yes"), ("ai_check_currency", "yes"), ("ai_check_period_match", "yes"), ("ai_resubmission_recommended", "yes"),
    ("ai_resubmission_recommendation_memo",), ("admin_review_status", REVIEW), ("admin_reviewed_by", "reviewer"), ("admin_reviewed_at", "time"), ("admin_review_note",),
    ("admin_filename_overridden", "yes"), ("file_size", "size"), ("memo",),
)
NAMES = tuple(c[0] for c in COLUMNS)


def sorted_json(df: DataFrame, name: str) -> Column:
    """A struct as JSON with its fields in order of name and a space behind commas and colons; {} for null."""
    fields = sorted(f.name for f in df.schema[name].dataType.fields)
    plain = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    parts = [F.concat(F.lit(f'"{f}": '), plain(f"`{name}`.`{f}`")) for f in fields]
    return F.when(F.col(name).isNull(), "{}").otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")


def _cell(df: DataFrame, name: str, kind: object = "text", source: str | None = None) -> Column:
    here = (source or name) in df.columns
    types = {"yes": "boolean", "time": "timestamp", "month": "date", "size": "long"}
    value = F.col(source or name) if here else F.lit(None).cast(types.get(kind, "string") if isinstance(kind, str) else "string")
    if isinstance(kind, dict):
        labels = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
        return F.coalesce(F.try_element_at(labels, value), value)
    special = {
        "month": lambda: F.date_format(value, "yyyy-MM"),
        "time": lambda: _iso(value),
        "yes": lambda: F.when(value, "yes").otherwise("no"),
        "json": lambda: sorted_json(df, name) if here else F.lit("{}"),
        "kind": lambda: F.when(F.col("is_extra"), "extra").otherwise("registered_service"),
        "file": lambda: F.when(available(F.col("file"), F.col("file_deleted")), STORED).when(F.col("file_deleted"), DELETED).otherwise(ABSENT),
        "shown": lambda: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("generated_filename", "original_filename")]),
        "uploader": lambda: F.coalesce("uploader_name", F.when(F.col("upload_source") == "user", F.col("username")), F.lit("-")),
        "reviewer": lambda: F.coalesce("reviewer_name", F.lit("-")),
        "size": lambda: F.when(value > 0, value.cast("string")),
    }
    return special.get(kind, lambda: value.cast("string"))()


def manifest(submissions: DataFrame, users: DataFrame, receipts: DataFrame) -> DataFrame:
    """NAMES as text, and receipt_id, for every receipt of the submissions; null cells are empty.

    submissions: submission_id, user_id, period_month, submission_status, submitted_at. users: user_id, username, email.
    receipts: submission_id, receipt_id, uploaded_by_id, reviewed_by_id and what COLUMNS name; those that are missing are empty.
    """
    names = users.select("user_id", "username", "email")
    by = lambda key, name: names.select(F.col("user_id").alias(key), F.col("username").alias(name))
    rows = receipts.drop("user_id").join(submissions, "submission_id").join(names, "user_id", "left")
    rows = rows.join(by("uploaded_by_id", "uploader_name"), "uploaded_by_id", "left").join(by("reviewed_by_id", "reviewer_name"), "reviewed_by_id", "left")
    return rows.select("receipt_id", *[F.coalesce(_cell(rows, *c), F.lit("")).alias(c[0]) for c in COLUMNS])


def csv_line(cells: list[Column]) -> Column:
    """Cells with commas between; those with a comma, quote or line break in quotes, quotes doubled."""
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return F.concat_ws(",", *quoted)


def write_manifest(sheet: DataFrame, path: str) -> None:
    """Writes each month's sheet to path/month=YYYY-MM, by user and receipt, as files that in order of name make one CSV with one header.

    Files come from sorted parts, so a large month is several files and no task holds it whole.
    """
    placed = placed_rows(sheet, ["period_month"], [F.col("username"), F.col("receipt_id")], "place")
    body = placed.select(F.col("period_month").alias("month"), "place", csv_line([F.col(n) for n in NAMES]).alias("value"))
    header = sheet.select(F.col("period_month").alias("month")).distinct().select("month", F.lit(0).cast("long").alias("place"), F.lit(",".join(NAMES)).alias("value"))
    ordered = header.unionByName(body).repartitionByRange("month", "place").sortWithinPartitions("month", "place")
    ordered.select("month", "value").write.partitionBy("month").text(path)
