"""Ranked lexical search turned round: the items' terms are the index and the documents stream past it.

An inverted index over the terms of a block of items goes to every task. Each document's term counts
run through it and update a bounded heap for each item; the heaps of the tasks are merged at the end.
Texts are read once for a block of items; what they leave is a narrow table of counts of indexed terms.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import given_back, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 20
#: Pairs of an item and a term that one broadcast index holds (an item with more stands alone).
POSTINGS = 500_000
#: Pairs of a document's term and an item that are scored at a time.
SLICE = 1 << 21
SALTS = 64
COUNTS = "doc_id long, n long, terms array<int>, times array<int>"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: the terms of all rows of each item. Null texts have none."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id").alias("item_id"), F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class ItemIndex:
    """Inverted index over a block of items: term -> number; postings of (item number, times) by term."""

    def __init__(self, rows: list):
        self.items = list(dict.fromkeys(r["item_id"] for r in rows))
        number = {item: k for k, item in enumerate(self.items)}
        self.terms = {term: k for k, term in enumerate(dict.fromkeys(r["term"] for r in rows))}
        term = np.array([self.terms[r["term"]] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        self.item = np.array([number[r["item_id"]] for r in rows], np.int64)[order]
        self.times = np.array([r["times"] for r in rows], np.int64)[order]
        self.length = np.bincount(term, minlength=len(self.terms))
        self.start = np.cumsum(self.length) - self.length


def blocks_of(index: DataFrame, postings: int) -> tuple[DataFrame, int]:
    """index with `block`, and the number of blocks: none has over 2 * postings rows unless it is one item's."""
    items = materialize(index.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "lexical-items")
    total, most = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-total // postings))
    place = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    while blocks < most and (items.groupBy(place(blocks).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where(f"k > 1 AND n > {2 * postings}").limit(1).count()):
        blocks *= 2
    return index.withColumn("block", place(blocks)), blocks


def term_counts(docs: DataFrame, index) -> DataFrame:
    """doc_id, n, and the numbers and counts of indexed terms of each document with at least one term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(TERM).findall, index.value.terms
        lower = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
        for batch in given_back(batches):
            rows, sizes, terms, times = [], [], [], []
            for row, text in enumerate(batch.column("text")):
                words = find((text.as_py() or "").translate(lower))
                if words:
                    counts: dict[int, int] = {}
                    for k in map(known.get, words):
                        if k is not None:
                            counts[k] = counts.get(k, 0) + 1
                    rows.append(row)
                    sizes.append(len(words))
                    terms.append(list(counts))
                    times.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n", "terms", "times"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, COUNTS)


def term_weights(counts: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """The weight of each indexed term; at most as many rows as the index has terms are collected."""
    df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(size, np.int64)
    for r in df.select("term", F.floor(F.lit(1000.0) * F.log((F.lit(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long").alias("w")).collect():
        weights[r["term"]] = r["w"]
    return weights


def lengths_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if int(n.max(initial=0)) * 25 * n_docs < 1 << 62:
        return 75 + (25 * n * n_docs) // n_terms
    return np.array([75 + (25 * int(x) * n_docs) // n_terms for x in n], np.int64)


class Heaps:
    """The `top` best documents of each item: highest score, then smallest doc_id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps, self.least = top, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, item: np.ndarray, doc: list, score: np.ndarray) -> None:
        for at in np.flatnonzero(score >= self.least[item]).tolist():
            k, heap = int(item[at]), self.heaps[item[at]]
            entry = (int(score[at]), -(1 << 63) if doc[at] is None else -doc[at])
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.top:
                self.least[k] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for k, heap in enumerate(self.heaps):
            for score, doc in heap:
                yield k, None if doc == -(1 << 63) else -doc, score


def slices(work: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most `most` pairs of work each, or of one row."""
    ends, at = np.cumsum(work), 0
    while at < len(work):
        stop = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + most, "right")))
        yield at, stop
        at = stop


def best_of_tasks(counts: DataFrame, index, weights, n_docs: int, n_terms: int, top: int, item_type) -> DataFrame:
    """item_id, doc_id, score: what the heaps of each task hold at its end."""
    kind = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = index.value, weights.value
        heaps = Heaps(len(own.items), top)
        for batch in given_back(batches):
            lists, times = batch.column("terms"), batch.column("times").flatten().to_numpy().astype(np.int64)
            terms, docs = lists.flatten().to_numpy().astype(np.int64), batch.column("doc_id").to_pylist()
            per_row = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(per_row)), per_row)
            m = lengths_factor(batch.column("n").to_numpy(), n_docs, n_terms)[row]
            part = w[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m))
            reach = own.length[terms]
            pairs = np.bincount(row, weights=reach, minlength=len(per_row)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(per_row)])
            for low, high in slices(pairs, SLICE):
                at = slice(ends[low], ends[high])
                many = reach[at]
                if not many.sum():
                    continue
                posting = np.repeat(own.start[terms[at]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                key = np.repeat(row[at], many) * len(own.items) + own.item[posting]
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                score = np.add.reduceat((np.repeat(part[at], many) * own.times[posting])[order], first)
                doc_row, item = np.divmod(key[first], len(own.items))
                heaps.offer(item, _Picked(docs, doc_row), score)
        found = list(heaps.rows())
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.items[k] for k, _, _ in found], kind), pa.array([d for _, d, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64())],
            ["item_id", "doc_id", "score"],
        )

    return counts.mapInArrow(run, f"item_id {item_type.simpleString()}, doc_id long, score long")


class _Picked:
    """values[places[k]] without a list of its own."""

    def __init__(self, values: list, places: np.ndarray):
        self.values, self.places = values, places

    def __getitem__(self, k: int):
        return self.values[self.places[k]]


def merged(found: DataFrame, top: int) -> DataFrame:
    """The `top` best rows of each item with their rank, by salt first, so that no item's heaps of all tasks meet in one."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place: Column = F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))
    few = found.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("rank", place).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast("int")).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def lexical_ranking(docs: DataFrame, items: DataFrame, top: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` best documents of each item, scores above 0 only.

    Terms are the maximal runs of ASCII digits and letters and of all signs beyond ASCII; only A-Z are
    lower-cased. Null texts have no terms, and items or documents without terms have no rows. Equal
    scores go by doc_id, rows without doc_id last. Every row of docs is a document of its own, also
    if its doc_id repeats; rows of one item_id (null too) are one item. Empty tables give an empty
    result; only doc_id and text, and item_id and text, are read.
    """
    spark = docs.sparkSession
    index, blocks = blocks_of(materialize(item_terms(items), "lexical-terms"), postings)
    out, kind = None, items.schema["item_id"].dataType
    for block in range(blocks):
        rows = index.where(F.col("block") == block).collect()
        if not rows:
            continue
        own = ItemIndex(rows)
        sent = spark.sparkContext.broadcast(own)
        counts = materialize(term_counts(docs, sent), "lexical-counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = spark.sparkContext.broadcast(term_weights(counts, n_docs, len(own.terms)))
        best = best_of_tasks(counts, sent, weights, n_docs, n_terms, top, kind)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return merged(out, top)
