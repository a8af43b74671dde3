"""Choices in which each thing is used once, and places of rows without one task per group."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import staged
from .parts import connected_parts

#: Candidates that one task walks through.
BLOCK_CANDIDATES = 50_000


def in_order(rows: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with _part and _at, spans): rows sorted by keys and then order in parts of a range partitioning.

    _at rises with the order. spans has for each key and part _first (its lowest _at), _n rows and
    _ahead, the rows of the key in the parts before, so a row's place in its key from 0 is
    _at - _first + _ahead. No task holds more than one part of a key.
    """
    by = [*[F.col(k) for k in keys], *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    marked = staged(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    spans = marked.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return marked, spans.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def same_keys(keys: list[str], left: str, right: str) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return test


def placed_rows(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`, their place from 1 within keys, however many rows a key has."""
    marked, spans = in_order(rows, keys, order)
    spans = staged(spans, "spans")
    met = marked.alias("r").join(spans.alias("s"), same_keys([*keys, "_part"], "r", "s"))
    return met.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_at") - F.col("_first") + F.col("_ahead") + 1).alias(name))


def walk(table: pa.Table, columns: list[str]) -> pa.Table:
    """The rows taken in order of _at, each only if none of its _names is taken yet."""
    table = table.take(pc.sort_indices(table, [("_at", "ascending")]))
    used: set[str] = set()
    taken = []
    for k, names in enumerate(table.column("_names").to_pylist()):
        if used.isdisjoint(names):
            used.update(names)
            taken.append(k)
    return table.take(pa.array(taken, pa.int64())).select(columns)


def in_blocks(candidates: DataFrame, keys: list[str], total: int, block: int) -> DataFrame:
    """What the walk takes of candidates none of which conflicts with one of other keys; many keys go to one task."""
    keep = [c for c in candidates.columns if c not in ("_part", "_block", "_size", *(k for k in keys if k.startswith("_")))]
    dealt = candidates.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-total // block)))))
    return dealt.groupBy("_block").applyInArrow(lambda table: walk(table, keep), dealt.select(keep).schema)


def greedy_choice(candidates: DataFrame, order: list[Column], resources: Column, scope: list[str], block: int = BLOCK_CANDIDATES) -> DataFrame:
    """The candidates that a walk in `order` takes, each only if none of its resources is taken yet.

    `resources` is an array of names; `order` must make a total order; candidates of different
    `scope` share no resource. Scopes of at most `block` candidates go to tasks whole, many to one task.
    Larger ones fall into the connected parts of what shares resources; parts of at most `block` go to
    tasks as well. What is larger is settled in rounds: candidates that come first for all their resources are taken
    and their rivals go; where that settles few, the next `block` candidates in order are walked by one task.
    """
    columns = candidates.columns
    by = [o.alias(f"_o{k}") for k, o in enumerate(order)]
    ready = candidates.select("*", resources.alias("_names"), *by)
    marked, _ = in_order(ready, [], [F.col(f"_o{k}") for k in range(len(order))])
    marked = marked.drop(*[f"_o{k}" for k in range(len(order))], "_part")
    sizes = staged(marked.groupBy(*scope).agg(F.count(F.lit(1)).alias("_size")), "scopes")
    total, most = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    if most <= block:
        return in_blocks(marked, scope, total, block).select(columns)
    sized = marked.alias("r").join(sizes.alias("s"), same_keys(scope, "r", "s")).select("r.*", "_size")
    small = in_blocks(sized.where(F.col("_size") <= block).drop("_size"), scope, total, block)
    large = staged(sized.where(F.col("_size") > block).drop("_size"), "large-scopes")
    return small.unionByName(_by_parts(large, block)).select(columns)


def _by_parts(candidates: DataFrame, block: int) -> DataFrame:
    others = F.expr("slice(_names, 2, greatest(size(_names) - 1, 0))")
    parts = staged(connected_parts(candidates.select(F.col("_names")[0].alias("a"), F.explode(others).alias("b"))), "greedy-parts")
    named = candidates.withColumn("_lead", F.col("_names")[0]).join(parts.select(F.col("node").alias("_lead"), F.col("part").alias("_root")), "_lead", "left")
    named = staged(named.withColumn("_root", F.coalesce("_root", "_lead")).drop("_lead"), "greedy-rooted")
    sizes = staged(named.groupBy("_root").agg(F.count(F.lit(1)).alias("_size")), "greedy-sizes")
    total, most = sizes.agg(F.sum("_size"), F.max("_size")).first()
    if most <= block:
        return in_blocks(named, ["_root"], total, block)
    sized = named.join(sizes, "_root")
    small = in_blocks(sized.where(F.col("_size") <= block).drop("_size"), ["_root"], total, block)
    return small.unionByName(_in_rounds(sized.where(F.col("_size") > block).drop("_size", "_root"), block))


def _in_rounds(candidates: DataFrame, block: int) -> DataFrame:
    left, taken = staged(candidates, "greedy"), None
    while not left.isEmpty():
        each = left.select("_at", F.explode("_names").alias("name"))
        first = each.groupBy("name").agg(F.min("_at").alias("_at")).groupBy("_at").agg(F.count(F.lit(1)).alias("_wins"))
        now = staged(left.join(first, "_at").where(F.col("_wins") == F.size("_names")).drop("_wins"), "greedy-taken")
        if now.count() * 8 < block:
            head = left.orderBy("_at").limit(block).withColumn("_all", F.lit(0))
            now = staged(in_blocks(head, ["_all"], 1, 1), "greedy-taken")
        taken = now if taken is None else taken.unionByName(now)
        lost = each.join(now.select(F.explode("_names").alias("name")).distinct(), "name", "left_semi").select("_at").distinct()
        left = staged(left.join(lost, "_at", "left_anti"), "greedy")
    return candidates.limit(0) if taken is None else taken


def numbered_rows(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """rows with `name`, their place from 1 within keys in the order of bucket and then `order`.

    Rows are counted by bucket, the counts are summed up, and each bucket is numbered on its own, so a
    key of any size spreads over its buckets. bucket must rise with the order.
    """
    marked = rows.withColumn("_bucket", bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_b"), "_ahead")
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return marked.withColumn("_place", place).join(ahead, same).withColumn(name, (F.col("_place") + F.col("_ahead")).cast("int")).select(*rows.columns, name)
