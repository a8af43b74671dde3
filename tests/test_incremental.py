"""Versioned tables survive failed runs; only statements that have changed are solved again."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from test_matching import LINE, PIECE, day, piece

from tallyloom.operators import incremental as inc
from tallyloom.operators import matching
from tallyloom.sources.versions import VersionedTable

SCHEMA = StructType().add("k", "integer").add("v", "string")


def table_of(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/table", SCHEMA, ["k"], StructType().add("note", "string"))


def put(spark, table, rows, keys, gone=()):
    return table.replace(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, f"n{k}") for k in keys], "k int, note string"), spark.createDataFrame([(k,) for k in gone], "k int"))


def held(table):
    return sorted((r["k"], r["v"]) for r in table.rows().collect())


def test_groups_are_replaced_whole(spark, tmp_path):
    table = table_of(spark, tmp_path)
    assert held(table) == [] and table.groups().count() == 0
    assert put(spark, table, [(1, "a"), (1, "a"), (2, "b"), (3, "c")], [1, 2, 3]) == 1
    assert put(spark, table, [(2, "B")], [2, 3, 4], gone=[1]) == 2
    assert held(table) == [(2, "B")] and sorted((r["k"], r["note"], r["_run"]) for r in table.groups().collect()) == [(2, "n2", 2), (3, "n3", 2), (4, "n4", 2)]
    put(spark, table, [(1, "again")], [1])
    assert table.vacuum() == 0 and table.compact() == 4
    assert held(table) == [(1, "again"), (2, "B")] and table.vacuum() == 3 and held(table) == [(1, "again"), (2, "B")]


def test_a_run_killed_half_way_leaves_the_old_rows(spark, tmp_path):
    table = table_of(spark, tmp_path)
    put(spark, table, [(k, "old") for k in range(50)], range(50))
    broken = spark.range(50).repartition(5).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")).alias("v"))
    groups = spark.range(50).select(F.col("id").cast("int").alias("k"), F.lit("n").alias("note"))
    with pytest.raises(Exception, match="lost"):
        table.replace(broken, groups)
    assert held(table) == [(k, "old") for k in range(50)]
    table._commit, kept = lambda *a: (_ for _ in ()).throw(OSError("killed before the commit")), table._commit
    with pytest.raises(OSError):
        put(spark, table, [(1, "new")], [1])
    assert held(table) == [(k, "old") for k in range(50)]
    table._commit = kept
    assert put(spark, table, [(1, "new")], [1]) == 2 and held(table)[1] == (1, "new") and table.vacuum() == 2
    with pytest.raises(RuntimeError, match="another run"):
        table._commit(2, "runs/none", False)
    assert len(held(table)) == 50


def case(spark, changed=False):
    lines = [(s, f"L{s}-{n}", n, day(n), "M", Decimal(20 + n % 3), "USD", None) for s in (1, 2, 3) for n in range(1, 12)]
    pieces = [(s, *piece(f"C{s}-{n}", 1 + n % 11, str(20 + n % 3), n, merchant="M")[1:]) for s in (1, 2, 3) for n in range(1, 10)]
    if changed:
        pieces = [p for p in pieces if p[1] != "C2-4"]
        lines = [line for line in lines if line[0] != 3] + [(4, "L4-1", 1, dt.date(2026, 7, 2), "M", Decimal(21), "USD", None)]
    return spark.createDataFrame(lines, LINE), spark.createDataFrame([p for p in pieces if p[0] != 3] if changed else pieces, PIECE)


def matches(frame):
    return sorted((r["statement_id"], r["line_key"], r["match_type"], tuple(r["component_keys"])) for r in frame.collect())


def test_only_changed_statements_are_solved(spark, tmp_path, monkeypatch):
    solved = []
    plain = matching.reconcile
    monkeypatch.setattr(inc, "reconcile", lambda a, b: solved.append(sorted(r[0] for r in a.select("statement_id").distinct().collect())) or plain(a, b))
    due, table = inc.reconcile_changed(*case(spark), f"{tmp_path}/r")
    assert solved == [[1, 2, 3]] and matches(table.rows()) == matches(plain(*case(spark)))
    lines, evidence = case(spark)
    due, table = inc.reconcile_changed(lines.repartition(5), evidence.orderBy(F.desc("component_key")), f"{tmp_path}/r")
    assert due.count() == 0 and len(solved) == 1
    due, table = inc.reconcile_changed(*case(spark, changed=True), f"{tmp_path}/r")
    assert {(r["statement_id"], r["change"]) for r in due.collect()} == {(2, "changed"), (3, "removed"), (4, "new")} and solved[1] == [2, 4]
    assert matches(table.rows()) == matches(plain(*case(spark, changed=True)))
    memo = "注記 " + inc.RECONCILE_MARKERS[3]
    marked = spark.createDataFrame([(1, "2026-07-01", "completed", memo), (2, "2026-07-01", "failed", memo), (4, "2026-07-01", "completed", "注記")], "statement_id int, period_month string, status string, memo string")
    due, table = inc.reconcile_changed(*case(spark, changed=True), f"{tmp_path}/r", marked)
    assert [tuple(r) for r in due.collect()] == [(1, "marked")] and solved[2] == [1] and matches(table.rows()) == matches(plain(*case(spark, changed=True)))


def test_marks_are_found_and_taken_off(spark):
    memos = [(k, f"前 {m} 後") for k, m in enumerate(inc.RECONCILE_MARKERS)] + [(50, "前 後"), (51, None), (52, "")]
    got = {r["k"]: (r["hit"], r["rest"]) for r in spark.createDataFrame(memos, "k int, memo string").select("k", inc.marked_for_reconcile(F.col("memo")).alias("hit"), inc.without_markers(F.col("memo")).alias("rest")).collect()}
    assert len(inc.RECONCILE_MARKERS) == 12 and all(got[k] == (k < 12, "前 後" if k < 51 else "") for k in got)
