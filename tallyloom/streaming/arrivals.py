"""Receipts that arrive as a stream: the stored table takes the latest version of each, and the
statements of their months are due again; and messages that arrive as a stream and go out once.

Which version of a receipt is the latest is the stream's own state, kept by receipt in the engine's store: a
batch looks up and changes the entries of its own receipts and writes the rows that have changed, however large the
table is. An older version that comes late changes nothing, also where a receipt has moved to another month,
and a repeated batch writes the same rows again. Changes are folded into the table by compact().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.messages import outbox

#: Folders of the log of messages; a batch reads those of its own keys.
LOG_BUCKETS = 1024
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEFORE = "month_before"


def latest_versions(rows: DataFrame) -> DataFrame:
    """The row of each receipt_id that was updated last; ties by the larger event_id."""
    order = Window.partitionBy("receipt_id").orderBy(F.desc("updated_at"), F.desc("event_id"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def due_statements(statements: DataFrame, receipts: DataFrame) -> DataFrame:
    """Statements of the months of the receipts, but those in work or failed. Of changes also the months that receipts have left."""
    months = receipts.select("period_month")
    if BEFORE in receipts.columns:
        months = months.unionByName(receipts.select(F.col(BEFORE).alias("period_month")).where("period_month IS NOT NULL"))
    return statements.where("status NOT IN ('processing', 'failed')").join(months.distinct(), "period_month", "left_semi")


class LatestVersion(StatefulProcessor):
    """Passes on the newest row of a receipt if it is newer than what the state holds, with the month it had before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = StructType([StructField("updated_at", LongType()), StructField("event_id", LongType()), StructField("month", StringType())])
        self.held = handle.getValueState("latest", kinds)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r["updated_at"], r["event_id"]))
        known = self.held.get() if self.held.exists() else None
        if known is None or (newest["updated_at"], newest["event_id"]) > (known[0], known[1]):
            month = newest["period_month"]
            self.held.update((newest["updated_at"], newest["event_id"], None if month is None else str(month)))
            yield Row(**newest.asDict(), **{BEFORE: None if known is None else known[2]})

    def close(self) -> None:
        pass


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folders in `folder` that were written to their end."""
    fs, at = _files(spark, folder)
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_files(spark, f"{folder}/{n}/_SUCCESS")[1]))


def stored_receipts(spark: SparkSession, schema: StructType, table: str) -> DataFrame:
    """The table: the last folded state and the changes since, of each receipt the latest."""
    bases = _numbers(spark, f"{table}/base")
    since = [n for n in _numbers(spark, f"{table}/changes") if not bases or n > bases[-1]]
    paths = [f"{table}/base/{n}" for n in bases[-1:]] + [f"{table}/changes/{n}" for n in since]
    return latest_versions(spark.read.schema(schema).parquet(*paths)) if paths else spark.createDataFrame([], schema)


def changes_of(spark: SparkSession, schema: StructType, table: str, batch: int) -> DataFrame:
    """The rows that a batch has changed, with the month that each had before."""
    return spark.read.schema(StructType([*schema, StructField(BEFORE, StringType())])).parquet(f"{table}/changes/{batch}")


def compact(spark: SparkSession, schema: StructType, table: str) -> int:
    """Folds all changes into one state and deletes what it replaces; a run that fails leaves the old folders. Returns how many went."""
    bases, changes = _numbers(spark, f"{table}/base"), _numbers(spark, f"{table}/changes")
    if not changes or (bases and bases[-1] >= changes[-1]):
        return 0
    stored_receipts(spark, schema, table).write.mode("overwrite").parquet(f"{table}/base/{changes[-1]}")
    old = [f"{table}/base/{n}" for n in bases] + [f"{table}/changes/{n}" for n in changes]
    for path in old:
        fs, at = _files(spark, path)
        fs.delete(at, True)
    return len(old)


def run_arrivals(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Drains the folder `source` through the stream and returns the table that it leaves, which stays as it was
    if nothing new has come. Rows without receipt_id are one receipt. schema has receipt_id, event_id and updated_at (long), and period_month."""
    out = StructType([*schema, StructField(BEFORE, StringType())])

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/changes/{batch_id}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        newest = stream.groupBy("receipt_id").transformWithState(LatestVersion(), out, "Update", "None")
        newest.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return stored_receipts(spark, schema, table)


def log_bucket(key: str = "idempotency_key"):
    return F.pmod(F.xxhash64(key), F.lit(LOG_BUCKETS)).cast("int")


def run_outbox(spark: SparkSession, source: str, schema: StructType, log: str, checkpoint: str, kind: str, files_per_batch: int = 1) -> DataFrame:
    """Drains candidates (user_id, receipt_month, email, stopped) through the stream into the log of messages and
    returns it: idempotency_key, status, batch. A key that the log has as sent is never logged again, whichever
    batch or run brings it; within a batch a key counts once. A message is logged as sent before anybody sends it, so that
    none goes out twice: whoever sends takes the rows of a batch, and logs a failure as a row of status failed, which is tried again.

    The log lies in LOG_BUCKETS folders by a hash of the key, with Bloom filters in its files: a batch reads the folders of its own keys.
    """
    columns = StructType([StructField("idempotency_key", StringType()), StructField("status", StringType()), StructField("batch", LongType()), StructField("bucket", IntegerType())])
    spark.createDataFrame([], columns).write.partitionBy("bucket").mode("ignore").parquet(log)

    def store(batch: DataFrame, batch_id: int) -> None:
        nothing = spark.createDataFrame([], columns)
        wanted = outbox(batch, nothing, kind).select("idempotency_key", log_bucket().alias("bucket"))
        buckets = sorted(r["bucket"] for r in wanted.select("bucket").distinct().collect())  # at most LOG_BUCKETS
        known = spark.read.schema(columns).parquet(log).where(F.col("bucket").isin(buckets))
        due = outbox(batch, known.where(F.col("batch") < batch_id), kind).dropDuplicates(["idempotency_key"])
        sent = due.select("idempotency_key", F.when(F.col("status") == "skipped", "skipped").otherwise("sent").alias("status"), F.lit(batch_id).cast("long").alias("batch"), log_bucket().alias("bucket"))
        again = known.where(F.col("batch") == batch_id).select("idempotency_key")
        new = sent.join(again, "idempotency_key", "left_anti").repartition("bucket")
        new.write.option("parquet.bloom.filter.enabled#idempotency_key", "true").partitionBy("bucket").mode("append").parquet(log)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(columns).parquet(log).drop("bucket")
