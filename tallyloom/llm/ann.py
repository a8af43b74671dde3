"""Nearest neighbours by score-aware anisotropic product quantisation, with an exact check.

Codebooks of 16 centres a subspace (four-bit codes) are fitted to a loss that weighs the residual along
the vector, which distorts large inner products, above the rest. Tables of query and centre products give
the product of a query with each row's code. With the row's length along its code and off it, which the index
keeps, that product bounds the distance from below. Rows whose bound is not above the k-th
distance found so far get their exact distance, so no nearest row is left out, whatever the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CENTRES = 16
SUBSPACE = 2
PARALLEL_WEIGHT = 4.0
SAMPLE_ROWS = 8192
QUERY_BLOCK = 4096
#: Rows of a batch that each query ranks exactly before the bounds decide about the rest.
SHORTLIST = 160
#: Rows that are scored, and pairs that are ranked exactly, in one step.
SCAN_ROWS, EXACT_ROWS = 4096, 8192
#: Room for rounding in bounds, as a part of the lengths that meet in them.
ROUNDING = 1e-12
INDEX_SCHEMA = "vec_id long, codes binary, along double, across double, vector binary"


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and not all zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(wide, lambda x: x != 0)


class Codebooks:
    """Centres (subspaces, CENTRES, SUBSPACE) for vectors padded with zeros to whole subspaces."""

    def __init__(self, centres: np.ndarray, dims: int):
        self.centres, self.dims = centres, dims

    @staticmethod
    def split(vectors: np.ndarray) -> np.ndarray:
        n, dims = vectors.shape
        padded = np.zeros((n, -(-dims // SUBSPACE) * SUBSPACE))
        padded[:, :dims] = vectors
        return padded.reshape(n, -1, SUBSPACE)

    def encode(self, vectors: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres."""
        parts = self.split(vectors)
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        flat = np.stack(
            [((parts[:, m, None, :] - c) ** 2).sum(axis=2) for m, c in enumerate(self.centres)], axis=1
        )  # rows, subspaces, centres: squared residuals
        along = np.stack([np.einsum("nd,nkd->nk", parts[:, m], parts[:, m, None, :] - c) for m, c in enumerate(self.centres)], axis=1)
        codes = flat.argmin(axis=2)
        each = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0]
        total = each.sum(axis=1)
        for _ in range(passes):
            for m in range(parts.shape[1]):
                others = total - each[:, m]
                loss = flat[:, m] + (PARALLEL_WEIGHT - 1) * (others[:, None] + along[:, m]) ** 2 / norms[:, None]
                codes[:, m] = loss.argmin(axis=1)
                each[:, m] = along[np.arange(len(codes)), m, codes[:, m]]
                total = others + each[:, m]
        return codes.astype(np.uint8)

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 8, seed: int = 7) -> Codebooks:
        parts, rng = cls.split(sample), np.random.default_rng(seed)
        norms = (sample.astype(np.float64) ** 2).sum(axis=1)
        chosen = rng.integers(0, len(sample), (parts.shape[1], CENTRES))
        book = cls(np.stack([parts[rows, m] for m, rows in enumerate(chosen)]), sample.shape[1])
        gain, eye = PARALLEL_WEIGHT - 1, np.eye(SUBSPACE)
        for _ in range(rounds):
            codes = book.encode(sample, passes=1)
            chosen = np.stack([c[codes[:, m]] for m, c in enumerate(book.centres)], axis=1)
            each = ((parts - chosen) * parts).sum(axis=2)
            for m in range(parts.shape[1]):
                x = parts[:, m]
                others = each.sum(axis=1) - each[:, m]
                weight = gain * (others + (x**2).sum(axis=1)) / norms
                left = eye + gain * np.einsum("ni,nj->nij", x, x) / norms[:, None, None]
                right = x * (1 + weight)[:, None]
                for k in range(CENTRES):
                    own = codes[:, m] == k
                    if own.any():
                        book.centres[m, k] = np.linalg.solve(left[own].sum(axis=0), right[own].sum(axis=0))
                each[:, m] = ((x - book.centres[m][codes[:, m]]) * x).sum(axis=1)
        return book

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with each centre: (queries, subspaces, CENTRES)."""
        return np.einsum("qmd,mkd->qmk", self.split(queries), self.centres)

    def rebuilt(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return np.concatenate([c[codes[:, m]] for m, c in enumerate(self.centres)], axis=1)[:, : self.dims]


def build_index(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Codebooks | None, np.ndarray, np.ndarray]:
    """(index, codebooks, vec_ids and vectors of the sample). Codebooks are fitted on the sample, at most sample_rows
    rows, chosen by a hash of vec_id; every usable vector of the most frequent length is encoded and indexed, with
    its length along the vector that its code stands for, and across it."""
    good = vectors.where(usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sizes = good.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], INDEX_SCHEMA), None, np.zeros(0, np.int64), np.zeros((0, 0))
    good = good.where(F.size("v") == sizes[0]["dims"])
    chosen = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec_id", "v").toPandas()
    names, sample = chosen["vec_id"].to_numpy(np.int64), np.array(chosen["v"].tolist(), np.float64)
    book = Codebooks.fit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                codes = book.encode(x)
                near = book.rebuilt(codes)
                ways = near / np.maximum(np.sqrt((near**2).sum(axis=1, keepdims=True)), np.finfo(float).tiny)
                along = (x * ways).sum(axis=1)
                across = np.sqrt(((x - along[:, None] * ways) ** 2).sum(axis=1))
                if codes.shape[1] % 2:
                    codes = np.pad(codes, ((0, 0), (0, 1)))
                nibbles = codes[:, ::2] | codes[:, 1::2] << 4
                lists = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (nibbles, x)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists[0], pa.array(along), pa.array(across), lists[1]], ["vec_id", "codes", "along", "across", "vector"])

    return materialize(good.mapInArrow(run, INDEX_SCHEMA), "ann-index"), book, names, sample


def _stack(binaries: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(binaries), dtype).reshape(len(binaries), -1)


def _products(lut: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Product of each query with the vector that each row's code stands for."""
    out = np.zeros((len(lut), len(codes)))
    for m in range(lut.shape[1]):
        out += lut[:, m, codes[:, m]]
    return out


def _bounds(products: np.ndarray, lengths: np.ndarray, q: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """At most the distance of each query and row.

    Both vectors split into what lies along the code's vector, where they are known, and what lies across it,
    where the lengths alone are known and differ by no more than the vectors do.
    """
    on = np.where(lengths > 0, products / np.where(lengths > 0, lengths, 1.0), 0.0)
    norms = (q**2).sum(axis=1)[:, None]
    off = np.sqrt(np.maximum(norms - on**2, 0.0))
    # the root of a small difference of squares is known to the root of their rounding
    room = ROUNDING * (np.sqrt(norms) + np.abs(along) + across)
    loose = np.minimum(np.sqrt(ROUNDING * norms), ROUNDING * norms / np.maximum(off, np.finfo(float).tiny))
    return np.hypot(np.maximum(np.abs(on - along) - room, 0.0), np.maximum(np.abs(off - across) - room - loose, 0.0))


def _best(distances: np.ndarray, names: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the keep smallest distances, ties by smaller name."""
    if len(distances) > keep:
        at = np.flatnonzero(distances <= np.partition(distances, keep - 1)[keep - 1])
    else:
        at = np.arange(len(distances))
    return at[np.lexsort((names[at], distances[at]))[:keep]]


def _limits(own: np.ndarray, queries: np.ndarray, names: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each query has k rows of the sample, infinite if the sample has fewer."""
    out = np.full(len(own), np.inf)
    half = (sample**2).sum(axis=1) / 2
    for start in range(0, len(own), 64):
        guesses = half - queries[start : start + 64] @ sample.T
        for i, guess in enumerate(guesses, start):
            guess[names == own[i]] = np.inf
            if len(sample) - np.count_nonzero(names == own[i]) >= k:
                near = np.argpartition(guess, k - 1)[:k]
                out[i] = np.sqrt(((sample[near] - queries[i]) ** 2).sum(axis=1)).max()
    return out


def _search_block(index: DataFrame, book: Codebooks, names: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int, shortlist: int) -> DataFrame:
    """The k nearest rows of the index for a block of at most QUERY_BLOCK queries; each task of the scan reports at most k for each."""
    sent = index.sparkSession.sparkContext.broadcast((names, queries, limits, book))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, least, codebooks = sent.value
        least, tables = least.copy(), codebooks.tables(q)
        held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in own]

        def rank(i: int, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
            for start in range(0, len(at), EXACT_ROWS):
                rows = at[start : start + EXACT_ROWS]
                d = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
                both = np.concatenate([held[i][0], d]), np.concatenate([held[i][1], ids[rows]])
                first = _best(*both, k)
                held[i] = both[0][first], both[1][first]
            if len(held[i][0]) == k:
                least[i] = min(least[i], held[i][0][-1])

        for batch in (batch.slice(at, SCAN_ROWS) for batch in batches for at in range(0, batch.num_rows, SCAN_ROWS)):
            ids, along, across = (batch.column(c).to_numpy() for c in ("vec_id", "along", "across"))
            packed, x = _stack(batch.column("codes").to_pylist(), "u1"), _stack(batch.column("vector").to_pylist(), "<f8")
            codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(ids), -1)[:, : tables.shape[1]]
            lengths = np.sqrt((codebooks.rebuilt(codes) ** 2).sum(axis=1))
            for start in range(0, len(own), 64):
                bounds = _bounds(_products(tables[start : start + 64], codes), lengths, q[start : start + 64], along, across)
                for i, line in enumerate(bounds, start):
                    at = np.flatnonzero(~(line > least[i]) & (ids != own[i]))
                    if len(at) > shortlist:
                        at = at[np.argpartition(line[at], shortlist)]
                        rank(i, at[:shortlist], ids, x)
                        at = at[shortlist:][~(line[at[shortlist:]] > least[i])]
                    rank(i, at, ids, x)
        sizes = [len(h[0]) for h in held]
        if any(sizes):
            columns = [np.repeat(own, sizes), np.concatenate([h[1] for h in held]), np.concatenate([h[0] for h in held])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    near = index.mapInArrow(scan, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, shortlist: int = SHORTLIST, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by Euclidean distance for each query row.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite
    components take no part, nor do rows without vec_id. Rows of the query's vec_id are no candidates;
    of queries with equal vec_id the smallest vector by bytes asks. Ties go to the smaller vec_id; a
    table without usable vectors gives an empty result. Queries go through the scan in blocks, so what
    is broadcast is bounded whatever the number of queries. The result is exact; shortlist is how many rows of a
    batch a query ranks before the bounds decide about the rest, which changes the work alone.
    """
    spark = vectors.sparkSession
    index, book, sampled, sample = build_index(vectors.where("vec_id IS NOT NULL"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if book is None:
        return empty
    chosen = index.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-chosen.count() // query_block))
    out = None
    for b in range(blocks):
        mine = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks)).between(2 * b, 2 * b + 1))
        rows = mine.toPandas()
        if len(rows):
            names, q = rows["vec_id"].to_numpy(np.int64), _stack(rows["vector"].tolist(), "<f8")
            near = materialize(_search_block(index, book, names, q, _limits(names, q, sampled, sample, k), k, shortlist), "ann-near")
            out = near if out is None else out.unionByName(near)
    return empty if out is None else out
