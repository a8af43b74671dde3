"""Connected parts of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import staged


def connected_parts(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, part): part is the smallest node that is reached. Only nodes with an edge.

    A round points each node at its smallest neighbour, follows the pointers once more and puts the ends of the
    edges in place of what points at them, so parts shrink until no edge is left.
    """
    left = staged(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "part-edges")
    parts = None
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        far = near.select(F.col("node").alias("low"), F.col("low").alias("part"))
        moved = staged(staged(near, "part-near").join(far, "low").select("node", "part"), "part-moved")
        a, b = moved.select(F.col("node").alias("a"), F.col("part").alias("pa")), moved.select(F.col("node").alias("b"), F.col("part").alias("pb"))
        left = staged(left.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "part-edges")
        if parts is None:
            parts = moved
        else:
            onward = moved.select(F.col("node").alias("part"), F.col("part").alias("next"))
            parts = staged(parts.join(onward, "part", "left").select("node", F.coalesce("next", "part").alias("part")), "parts")
    return left.select(F.col("a").alias("node"), F.col("b").alias("part")) if parts is None else parts
