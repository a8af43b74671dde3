"""SimHash near-duplicates with a pigeonring filter.

The 64 bits are a ring of segments. If two fingerprints differ in at most d bits, then from some
segment on, every chain of l consecutive segments differs in at most floor(l * d / segments) bits.
With more segments than d the first segment of that chain is equal, and the second differs in so few
bits that one of its parts is equal too; those two make the join key. Pairs that meet on a key are
tested on all prefixes of the chain before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .components import connected_components

BITS = 64
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCK = 1 << 15
HOT_PARTS = 1000


def fingerprint(text: str, ngram: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text; 0 without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < ngram else map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False))
    return fingerprint_of(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), ">u8"))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these unsigned 64-bit hashes."""
    digests = np.ascontiguousarray(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), BLOCK):
        ones += np.unpackbits(digests[at : at + BLOCK], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = np.array([fingerprint(t, ngram) for t in part.column("body").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(start: int, stop: int) -> int:
    """Bits start to stop - 1, counted from the highest."""
    return ((1 << (stop - start)) - 1) << (BITS - stop)


def ring_segments(segments: int) -> list[tuple[int, int]]:
    cuts = [i * BITS // segments for i in range(segments + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def ring_keys(segments: int, distance: int) -> list[tuple[int, int]]:
    """(first segment, key mask): the first segment joined with one part of the next."""
    ring, parts = ring_segments(segments), 2 * distance // segments + 1
    keys = []
    for i in range(segments):
        start, stop = ring[(i + 1) % segments]
        cuts = [start + p * (stop - start) // parts for p in range(parts + 1)]
        keys += [(i, _mask(*ring[i]) | _mask(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return keys


def chain_holds(x: Column, first: Column, segments: int, distance: int) -> Column:
    """Whether each chain from segment `first` keeps its budget, given x, the differing bits."""
    ring, test = ring_segments(segments), F.lit(False)
    for i in range(segments):
        covered, within = 0, first == i
        for length in range(1, segments + 1):
            covered |= _mask(*ring[(i + length - 1) % segments])
            within = within & (F.bit_count(x.bitwiseAND(F.lit(_signed(covered)))) <= length * distance // segments)
        test = test | within
    return test


def hamming_links(fps: DataFrame, distance: int = 2, segments: int = 3, crowd: int = 32) -> DataFrame:
    """Edges (a, b) with the same components as all pairs of distinct `fp` within `distance` bits.

    Keys that up to `crowd` fingerprints share give pairs. A key that more share gives no pairs: its
    fingerprints meet at the fingerprints one bit away from them. Two fingerprints differ in at most
    two bits exactly if they have such a meeting point in common, and at most 65 can meet in one, so
    linking those to the smallest of them loses no component. At distance one
    the meeting point must itself be one of the two, so only such points link.
    """
    if not 0 <= distance <= 2 or segments <= distance:
        raise ValueError("distance must be 0, 1 or 2, and below the number of segments")
    keys = ring_keys(segments, distance)
    nodes = fps.select("fp").where("fp IS NOT NULL").distinct()
    spread = nodes.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("ring"), F.lit(i).alias("first"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
                    for k, (i, mask) in enumerate(keys)
                ]
            )
        ).alias("x"),
    ).select("fp", "x.*")
    counts = spread.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(spread.join(counts, ["ring", "key"]), "simhash-met")
    few = met.where(F.col("n") <= crowd).select("ring", "key", "first", F.col("fp").alias("a"))
    other = few.select("ring", "key", F.col("a").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        few.join(other, ["ring", "key"])
        .where(F.col("a") < F.col("b"))
        .where(chain_holds(x, F.col("first"), segments, distance))
        .where(F.bit_count(x) <= distance)
        .select("a", "b")
    )
    flips = [0] + [1 << i for i in range(BITS)]
    points = met.where(F.col("n") > crowd).select("fp").distinct().select(
        "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(f))) for f in flips])).alias("point")
    )
    meetings = points.groupBy("point").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")
    middle = F.array_min("all") if distance == 2 else F.when(F.array_contains("all", F.col("point")), F.col("point"))
    stars = meetings.select(middle.alias("m"), F.explode("all").alias("o")).where("m <> o").select(F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b"))
    return pairs.unionByName(stars.where(F.bit_count(x) <= distance)).distinct()


def near_duplicates(docs: DataFrame, ngram: int = 3, distance: int = 2, segments: int = 3, crowd: int = 32) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay repeated;
    rows without doc_id take part, and a component of such rows only has a null id. An empty table
    gives an empty result. Other columns are not read.
    """
    prints = materialize(fingerprints(docs, ngram), "simhash-prints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-firsts")
    roots = connected_components(hamming_links(firsts, distance, segments, crowd))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = rooted.join(least, "root").select("fp", "component_id")
    names = firsts.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    names = materialize(names, "simhash-names")
    # fingerprints of over 1 / HOT_PARTS of the rows are at most HOT_PARTS: their rows are named where they lie
    many = F.col("n") * HOT_PARTS > prints.count()
    hot = names.where(many).select("fp", F.struct("component_id").alias("hot"))
    marked = prints.join(F.broadcast(hot), "fp", "left")
    named = marked.where("hot IS NOT NULL").select("doc_id", "fp", "hot.component_id").unionByName(
        marked.where("hot IS NULL").join(names.where(~many), "fp").select("doc_id", "fp", "component_id")
    )
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
