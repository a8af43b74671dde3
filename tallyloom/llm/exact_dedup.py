"""Exact deduplication by skew-safe combining.

Copies are combined in three steps, each of which compares full texts: inside every scan task (the
partial aggregate), per salt for digests that hold many rows, and over the salts' winners. A digest
only routes rows; two texts are one class only if the texts are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused_name


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_classes(
    docs: DataFrame,
    normalize: Callable[[Column], Column] = lambda c: c,
    digest: Callable[[Column], Column] = sha256_digest,
    salts: int = 32,
    heavy_parts: int = 1000,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. The largest doc_id of a class stays; rows whose doc_id is null lose
    against any other. Of fully repeated rows exactly one is kept. An empty table gives an empty
    result; columns other than doc_id and text are not read. A digest is heavy if it holds more than
    1/heavy_parts of all rows, so at most heavy_parts digests are broadcast.
    """
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), normalize(F.coalesce(F.col("text"), F.lit(""))).alias("body")
    )
    narrow = materialize(
        rows.select(
            "doc_id",
            digest(F.col("body")).alias("digest"),
            F.sha2("body", 256).alias("text_sha256") if digest is not sha256_digest else F.lit(None).cast("string").alias("text_sha256"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "exact-narrow",
    )
    per_digest = narrow.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max_by("rid", "doc_id"), F.min("rid")).alias("win_rid")
    )
    total = narrow.count()
    heavy = materialize(per_digest.where(F.col("n") * heavy_parts > total).select("digest"), "exact-heavy")

    merged = (
        rows.withColumn("digest", digest(F.col("body")))
        .join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "digest", "left")
        .withColumn("salt", F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(F.lit(-1)))
        .groupBy("digest", "salt", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    winners = materialize(
        merged.select("digest", "salt", F.when(F.col("salt") >= 0, F.col("body")).alias("body"), "keep_id", "n"),
        "exact-winners",
    )
    columns = ["digest", "keep_id", "n"]
    classes = (
        winners.where("salt < 0")
        .select(columns)
        .unionByName(
            winners.where("salt >= 0").groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")).select(columns)
        )
    )
    info = materialize(
        classes.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .join(per_digest.select("digest", "win_rid"), "digest"),
        "exact-classes",
    )
    is_heavy = heavy.withColumn("hot", F.lit(True))
    marked = narrow.join(F.broadcast(is_heavy), "digest", "left")
    single = info.where("n_texts = 1")
    out = (
        marked.where("hot").join(F.broadcast(single.join(F.broadcast(heavy), "digest")), "digest")
        .unionByName(marked.where("hot IS NULL").join(single, "digest"))
        .withColumn("kept", F.col("rid") == F.col("win_rid"))
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    out = out.withColumn("text_sha256", F.coalesce("text_sha256", F.lower(F.hex("digest")))).select(columns)
    clash = info.where("n_texts > 1").select("digest")
    if clash.limit(1).count():
        out = out.unionByName(_by_content(rows, digest, clash).select(columns))
    return out


def _by_content(rows: DataFrame, digest: Callable[[Column], Column], clash: DataFrame) -> DataFrame:
    """Digests that different texts share: classes by the texts themselves."""
    body = materialize(
        rows.withColumn("digest", digest(F.col("body"))).join(clash, "digest", "left_semi").withColumn("rid", F.monotonically_increasing_id()),
        "exact-clash",
    )
    found = body.groupBy("digest", "body").agg(
        F.max("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.coalesce(F.max_by("rid", "doc_id"), F.min("rid")).alias("win_rid"),
    )
    return (
        body.join(found, ["digest", "body"])
        .withColumn("kept", F.col("rid") == F.col("win_rid"))
        .withColumn("text_sha256", F.sha2("body", 256))
    )


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without all but one row of each class of equal texts.

    Of equal texts the row of the largest doc_id stays, rows without doc_id last; of rows that repeat both, one stays. Null
    texts count as empty. An empty table gives an empty result; columns may have any names.
    """
    ids, shas = unused_name(docs, "id"), unused_name(docs, "sha")
    kept = exact_classes(docs, **options).where("kept").select(F.col("doc_id").alias(ids), F.col("text_sha256").alias(shas))
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    match = docs["doc_id"].eqNullSafe(F.col(ids)) & (sha == F.col(shas))
    marked = docs.join(kept, match, "left_semi")
    named = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    twice = named.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(ids), F.col("sha").alias(shas))
    if not twice.limit(1).count():
        return marked
    alone = marked.join(twice, match, "left_anti")
    body = unused_name(docs, "body")
    again = marked.join(twice, match, "left_semi").withColumn(body, F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", body]).drop(body)
    return alone.unionByName(again)
