"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root), root the smallest node of the component; only nodes with an edge.

    Each round maps every node to its smallest neighbour, jumps once more along these pointers, and
    rewrites the edges between the images. The image of a connected graph stays connected and its
    smallest node maps to itself, so the rounds end with one image for each component; loops, nulls
    and repeated edges do no harm.
    """
    at = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "cc-edges")
    roots = None
    while not at.isEmpty():
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(
            both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "cc-up"
        )
        up2 = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        jump = materialize(up.join(up2, "up").select("node", "root"), "cc-jump")
        left = jump.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = jump.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        at = materialize(
            at.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "cc-edges",
        )
        if roots is None:
            roots = jump
        else:
            step = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = materialize(
                roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots"
            )
    if roots is None:
        return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
