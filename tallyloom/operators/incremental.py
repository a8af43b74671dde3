"""Reconciliation of what has changed only: statements whose lines, evidence or marks differ from the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, LongType, StringType, StructField, StructType

from ..sources.stages import staged
from ..sources.versions import VersionedTable
from .matching import reconcile

# Marks in a statement's memo that ask for a new reconciliation.
RECONCILE_MARKERS = (
    "【月次ルール更新】明細月と対象領収書月の対応を修正したため、最新の領収書と再照合します。",
    "【月次ルール更新】全社明細月と領収書発行月を同じ月として照合するため、最新の領収書と再照合します。",
    "【照合ルール更新】必須条件・優先順位方式へ更新したため、最新の領収書と再照合します。",
    "【照合ルール更新】領収書のカード末尾を必須条件から補助加点へ変更したため、最新の領収書と再照合します。",
    "【照合ルール更新】金額照合を許容差なしの完全一致へ変更したため、最新の領収書と再照合します。",
    "【照合ルール更新】利用日±1日・金額/通貨完全一致・ご利用先/払先関連の単純一対一照合へ変更したため、最新の領収書と再照合します。",
    "【照合ルール更新】2026年7月実明細61行・提出PDF63件の全件検証に基づき、取引構成要素・重複排除・返金純額照合へ更新したため再照合します。",
    "【照合ルール更新】法的な払先と領収書本文のサービス名を分離し、Google One等をサービス名で照合するため再照合します。",
    "【照合ルール更新】契約変更書類と過去の旧プラン実績による推定対応を追加したため再照合します。",
    "【照合ルール更新】契約変更メタデータを再抽出し、旧プラン名を抽出できない定期契約も厳格条件で推定候補へ含めるため再照合します。",
    "【照合ルール更新】契約変更書類のBill to利用者と前月カード明細の請求周期を推定対応に利用するため再照合します。",
    "【領収書更新】領収書の追加・差し替え・AI解析結果更新があったため、最新状態で再照合します。",
)

DIGEST = StructType([StructField("n_lines", LongType()), StructField("n_evidence", LongType()), StructField("digest", DecimalType(38, 0)), StructField("check", LongType())])


def marked_for_reconcile(memo: Column) -> Column:
    """Whether a memo holds one of the marks."""
    out = F.lit(False)
    for marker in RECONCILE_MARKERS:
        out = out | F.contains(F.coalesce(memo, F.lit("")), F.lit(marker))
    return out


def without_markers(memo: Column) -> Column:
    """A memo after the statement has been reconciled: its marks go, other text stays."""
    out = F.coalesce(memo, F.lit(""))
    for marker in RECONCILE_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def pending_statements(statements: DataFrame, month: str | None = None, statement_id: int | None = None) -> DataFrame:
    """Statements whose memo holds a mark, but those in work or failed; of one month or one statement if given."""
    due = statements.where(marked_for_reconcile(F.col("memo")) & ~F.col("status").isin("processing", "failed"))
    if month is not None:
        due = due.where(F.col("period_month") == F.lit(month).cast("date"))
    return due if statement_id is None else due.where(F.col("statement_id") == statement_id)


def statement_digests(lines: DataFrame, evidence: DataFrame) -> DataFrame:
    """statement_id with the counts of its lines and evidence and a digest of both that no order of rows changes.

    Rows add up as two kinds of hashes, so tasks combine them before the shuffle and repeated rows count.
    """
    parts = None
    for rows, name in ((lines, "n_lines"), (evidence, "n_evidence")):
        columns = [F.col(c).cast("string") for c in sorted(rows.columns)]
        told = F.concat_ws("\u001f", *[F.coalesce(c, F.lit("\u001e")) for c in columns])
        one = rows.select("statement_id", F.xxhash64(F.lit(name), told).cast("decimal(20,0)").alias("h"), F.crc32(told.cast("binary")).alias("c"), *[F.lit(int(n == name)).alias(n) for n in ("n_lines", "n_evidence")])
        parts = one if parts is None else parts.unionByName(one)
    found = parts.groupBy("statement_id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_evidence").alias("n_evidence"), F.sum("h").alias("digest"), F.sum("c").alias("check"))
    return found.withColumn("digest", F.col("digest").cast("decimal(38,0)"))


def statement_changes(digests: DataFrame, known: DataFrame) -> DataFrame:
    """statement_id and change (new, changed, removed) of statements whose digest is not the known one."""
    names = DIGEST.names
    a, b = digests.select("statement_id", F.struct(*names).alias("now")), known.select("statement_id", F.struct(*names).alias("then"))
    met = a.join(b, "statement_id", "full").where(~F.col("now").eqNullSafe(F.col("then")))
    return met.select("statement_id", F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def result_table(spark: SparkSession, root: str, lines: DataFrame) -> VersionedTable:
    """Matched lines by statement, and with each statement the digest it was solved with."""
    keys = [lines.schema[c] for c in ("statement_id", "merchant_key", "line_key")]
    schema = StructType([StructField(f.name, f.dataType) for f in keys]).add("match_type", "string").add("basis", "string")
    return VersionedTable(spark, root, schema.add("component_keys", ArrayType(StringType())), ["statement_id"], DIGEST)


def reconcile_changed(lines: DataFrame, evidence: DataFrame, root: str, statements: DataFrame | None = None) -> tuple[DataFrame, VersionedTable]:
    """Solves the statements that are new, changed or marked, puts their matches in place of the old ones, drops those
    of statements that are gone, and returns (what has been solved or dropped, the table of results).

    statements (statement_id, period_month, status, memo) names further ones to solve by their marks. A run
    without changes reads and hashes the rows, but solves and writes nothing.
    """
    spark = lines.sparkSession
    table = result_table(spark, root, lines)
    digests = staged(statement_digests(lines, evidence), "digests")
    due = statement_changes(digests, table.groups())
    if statements is not None:
        marked = pending_statements(statements).select("statement_id", F.lit("marked").alias("change"))
        due = due.unionByName(marked.join(due, "statement_id", "left_anti").join(digests, "statement_id", "left_semi"))
    due = staged(due, "due-statements")
    if due.isEmpty():
        return due, table
    now = due.where("change <> 'removed'").select("statement_id")
    found = reconcile(staged(lines.join(now, "statement_id", "left_semi"), "due-lines"), staged(evidence.join(now, "statement_id", "left_semi"), "due-evidence"))
    found = found.withColumn("component_keys", F.transform("component_keys", lambda k: k.cast("string")))
    table.replace(found, digests.join(now, "statement_id", "left_semi"), due.where("change = 'removed'").select("statement_id"))
    return due, table
