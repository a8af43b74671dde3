"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times, whose mean is its source's target repetition
rate. The number is the inverse of the distribution at a uniform value that a hash of the document's
id and a seed gives, so it depends on neither partitions nor order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused_name

STEP_RATE = 16.0
TERMS = 100
KEY_DIGITS = 13


def uniform(*parts: Column | str) -> Column:
    """A number from 0 to 1 by the first 52 bits of an MD5."""
    named = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(named), 1, KEY_DIGITS), 16, 10).cast("double") / F.lit(float(16**KEY_DIGITS))


def source_rates(docs: DataFrame, power: float = 0.5, weights: DataFrame | None = None) -> DataFrame:
    """source, mass (characters), rate: mean repetitions that bring each source to its weight.

    weights (source, weight) gives the shares of the output's characters, which are as many as the
    input's; without it a source weighs mass ** power. Sources without weight get rate 0, sources
    without characters rate 1. A null source is a source of its own.
    """
    masses = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("mass"))
    if weights is None:
        weighed = masses.withColumn("weight", F.pow(F.col("mass").cast("double"), F.lit(power)))
    else:
        named = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        weighed = masses.join(named, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = weighed.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight") * F.col("all_mass") / F.col("mass")
    return weighed.join(F.broadcast(totals)).select("source", "mass", F.when(F.col("mass") > 0, share).otherwise(F.lit(1.0)).alias("rate"))


def _distribution(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... TERMS - 1 events; mean is at most STEP_RATE."""
    start = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, k: Column) -> Column:
        total = acc["sum"] + acc["p"]
        return F.struct((acc["p"] * mean / (k + 1)).alias("p"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step)["all"]


def mix_sources(docs: DataFrame, power: float = 0.5, weights: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """The rows of docs, each repeated, plus copy (from 0), copies and shuffle_key, in global random order.

    A rate above STEP_RATE is a sum of equal smaller ones, each with a hash of its own. Rows of equal
    doc_id repeat equally often; a null doc_id is an id of its own. An empty table gives an empty
    result. Columns of docs named copy, copies or shuffle_key are replaced.
    """
    names = [c for c in docs.columns if c not in ("copy", "copies", "shuffle_key")]
    rates = source_rates(docs, power, weights)
    steps = F.greatest(F.ceil(F.col("rate") / STEP_RATE), F.lit(1)).cast("int")
    own = [unused_name(docs, stem) for stem in ("source", "steps", "below")]
    table = materialize(rates.select(*[c.alias(x) for c, x in zip((F.col("source"), steps, _distribution(F.col("rate") / steps)), own, strict=True)]), "mix-rates")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(
        F.sequence(F.lit(1), F.col(own[1])),
        lambda j: F.size(F.filter(own[2], lambda below: below <= uniform(name, j.cast("string"), seed))),
    )
    counted = (
        docs.select(*names)
        .join(table, F.col("source").eqNullSafe(F.col(own[0])))
        .withColumn("copies", F.aggregate(draws, F.lit(0), lambda a, b: a + b))
        .where("copies > 0")
        .select(*names, "copies")
    )
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    keyed = copies.withColumn("shuffle_key", uniform(name, F.col("copy").cast("string"), seed, "order"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy").select(*names, "copy", "copies", "shuffle_key")
