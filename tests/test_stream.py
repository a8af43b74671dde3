"""The arrival stream: late older versions and repeated batches change nothing."""

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.streaming import arrivals

SCHEMA = "receipt_id string, event_id long, updated_at long, period_month string"


def test_latest_version_wins_in_any_order(spark, tmp_path):
    first = [("a", 1, 10, "2026-07"), ("b", 2, 10, "2026-07"), ("a", 3, 30, "2026-08")]
    later = [("a", 4, 20, "2026-07"), ("b", 5, 10, "2026-07"), ("c", 6, 5, "2026-06")]
    source = f"{tmp_path}/in"
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    args = (spark, source, schema, f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    arrivals.run_arrivals(*args)
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    out = arrivals.run_arrivals(*args)
    assert {(r.receipt_id, r.event_id) for r in out.collect()} == {("a", 3), ("b", 5), ("c", 6)}
    quiet = arrivals.run_arrivals(*args)
    assert {(r.receipt_id, r.event_id) for r in quiet.collect()} == {("a", 3), ("b", 5), ("c", 6)}
    again = arrivals.latest_versions(out.unionByName(spark.createDataFrame(first, schema)))
    assert again.exceptAll(out).count() == 0 == out.exceptAll(again).count()


def test_due_statements_are_those_of_the_months(spark):
    statements = spark.createDataFrame([(1, "2026-07", "completed"), (2, "2026-08", "processing"), (3, "2026-06", "completed")], "statement_id int, period_month string, status string")
    came = spark.createDataFrame([("x", "2026-07"), ("y", "2026-08")], "receipt_id string, period_month string")
    assert [r.statement_id for r in arrivals.due_statements(statements, came).orderBy(F.col("statement_id")).collect()] == [1]


def test_an_empty_source_leaves_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert arrivals.run_arrivals(spark, f"{tmp_path}/in", schema, f"{tmp_path}/table", f"{tmp_path}/checkpoint").count() == 0


def test_messages_of_a_stream_go_out_once(spark, tmp_path):
    schema = "user_id long, receipt_month date, email string, stopped boolean"
    month = dt.date(2026, 6, 1)
    spark.createDataFrame([(1, month, "A@x.example", False), (2, month, "b@x.example", True)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, f"{tmp_path}/log", f"{tmp_path}/checkpoint", "initial")
    arrivals.run_outbox(*args)
    spark.createDataFrame([(1, month, "a@x.example", False), (3, month, "c@x.example", False)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = arrivals.run_outbox(*args).collect()
    assert sorted((r.idempotency_key, r.status) for r in got) == [("initial:2026-07:user-1:a@x.example", "sent"), ("initial:2026-07:user-2:b@x.example", "skipped"), ("initial:2026-07:user-3:c@x.example", "sent")]


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """Work goes with the batch: ten thousand receipts are held, three come, and two rows are written."""
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    spark.range(10_000).select(F.concat(F.lit("r"), "id").alias("receipt_id"), "id", F.lit(5).cast("long").alias("updated_at"), F.lit("2026-07").alias("period_month")).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    args = (spark, source, schema, table, f"{tmp_path}/checkpoint")
    assert arrivals.run_arrivals(*args).count() == 10_000
    late = [("r7", 20_000, 9, "2026-08"), ("r8", 20_001, 1, "2026-09"), ("new", 20_002, 1, "2026-07")]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    out = arrivals.run_arrivals(*args)
    changed = arrivals.changes_of(spark, schema, table, 1).collect()
    assert {(r["receipt_id"], r["period_month"], r["month_before"]) for r in changed} == {("r7", "2026-08", "2026-07"), ("new", "2026-07", None)}
    assert out.count() == 10_001 and out.where("receipt_id = 'r7'").first()["period_month"] == "2026-08"
    statements = spark.createDataFrame([(1, "2026-07", "completed"), (2, "2026-08", "completed"), (3, "2026-09", "completed")], "statement_id int, period_month string, status string")
    assert sorted(r["statement_id"] for r in arrivals.due_statements(statements, arrivals.changes_of(spark, schema, table, 1).where("receipt_id = 'r7'")).collect()) == [1, 2]
    assert arrivals.compact(spark, schema, table) == 2 and arrivals.compact(spark, schema, table) == 0
    folded = arrivals.stored_receipts(spark, schema, table)
    assert folded.count() == 10_001 and folded.where("receipt_id = 'r7'").first()["period_month"] == "2026-08"
    spark.createDataFrame([("r8", 30_000, 10, "2026-06")], schema).coalesce(1).write.mode("append").parquet(source)
    again = arrivals.run_arrivals(*args)
    assert again.count() == 10_001 and again.where("receipt_id = 'r8'").first()["period_month"] == "2026-06"


def test_a_batch_reads_the_log_of_its_keys(spark, tmp_path):
    """Ten keys against a log in all folders: under one in a hundred of its files is read."""
    log = f"{tmp_path}/log"
    keys = spark.range(100_000).select(F.concat(F.lit("old:"), "id").alias("idempotency_key"), F.lit("sent").alias("status"), F.lit(-1).cast("long").alias("batch"))
    keys.withColumn("bucket", arrivals.log_bucket()).repartition(4, "bucket").write.partitionBy("bucket").parquet(log)
    few = sorted(r["bucket"] for r in keys.limit(10).select(arrivals.log_bucket().alias("bucket")).distinct().collect())
    every = spark.read.parquet(log)
    some = every.where(F.col("bucket").isin(few))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.select(F.input_file_name()).distinct().count() <= 10 and len(every.inputFiles()) == arrivals.LOG_BUCKETS and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "")
    schema = "user_id long, receipt_month date, email string, stopped boolean"
    spark.createDataFrame([(k, dt.date(2026, 6, 1), "a@x.example", False) for k in range(10)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, log, f"{tmp_path}/checkpoint", "initial")
    assert arrivals.run_outbox(*args).count() == 100_010 and arrivals.run_outbox(*args).count() == 100_010
