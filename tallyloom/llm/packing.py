"""Best-fit packing of documents into sequences, with certified bin counts.

Pieces are dealt over partitions and each runs best-fit decreasing. Dual-feasible functions give a
lower bound for each partition: a partition that meets it is certified. Partitions with a gap release
their emptier bins, certified ones their emptiest; what is released is exchanged and packed again, as
long as that saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .tokens import encoded

CAPACITY = 2048
GROUP_PIECES = 1 << 15
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, lot long, bins int, bound int, released boolean"


def cut_all(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start in the document, length) of the pieces of documents of these lengths: only
    the first piece of a longer document may be shorter than capacity."""
    counts = np.maximum(1, -(-lengths // capacity))
    doc = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
    first = lengths - (counts - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row's ids (with the end id); a null text counts as empty, of one id. doc_id
    passes as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, lengths in encoded(batches, vocabulary):
            doc, piece, start, length = cut_all(lengths, capacity)
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            names = part.column("doc_id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")).mapInArrow(run, PIECE_SCHEMA)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest bound of several dual-feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    # threshold functions: sizes over capacity - e count as full, those under e not at all
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    for e in range(1, capacity // 2 + 1):
        full = int(number[-1] - number[capacity - e])
        rest = int(volume[capacity - e] - volume[e - 1])
        best = max(best, full - (-rest // capacity))
    # rounding functions: floor((k + 1) x) / k, and x itself where (k + 1) x is whole
    for k in range(1, 12):
        whole = (sizes * (k + 1)) % capacity == 0
        steps = int((counts * (sizes * (k + 1) // capacity))[~whole].sum())
        kept = int((counts * sizes)[whole].sum())
        best = max(best, -(-(steps * capacity + kept * k) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, in any order, and the free room of each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = room - size
        if free[b]:
            with_room[free[b]].append(b)
            rooms |= 1 << free[b]
    return bins, offsets, free


def _released(free: list[int], bound: int) -> np.ndarray:
    """Marks bins to exchange: those with room among the emptiest quarter where a gap is left, else the emptiest."""
    room = np.array(free)
    count = max(1, len(free) // 4) if len(free) > bound else 1
    marks = np.zeros(len(free), bool)
    marks[np.argsort(-room, kind="stable")[:count]] = True
    return marks & (room > 0)


def _pack_groups(pieces: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("deal").take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")]))
        lengths = rows.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        marks = _released(free, lower_bound(lengths, capacity))
        out = marks[bins]
        count, bound = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
        for part in (out, ~out):
            count[part], bound[part] = len(np.unique(bins[part])), lower_bound(lengths[part], capacity)
        lot = (turn << 56) + (int(key[0].as_py()) << 24)
        columns = (lot + bins, offsets, (lot >> 23) + out, count, bound, out)
        for name, column in zip(("sequence_id", "offset", "lot", "bins", "bound", "released"), columns, strict=True):
            rows = rows.append_column(name, pa.array(column))
        return rows

    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() % groups).alias("deal"))
    return dealt.groupBy("deal").applyInArrow(run, PLACED_SCHEMA)


def _bins(placed: DataFrame) -> int:
    return placed.where("offset = 0").count()


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Places every piece: the piece's columns, sequence_id, offset, lot, bins and bound.

    A lot is a set of bins that left the exchange together; bins is their final number and bound what
    any packing of the lot's pieces needs, so the sum of bins over lots is the number of sequences and
    a lot with bins = bound is certified. Ties in length are placed by doc_id and piece; repeated rows
    are pieces of their own; an empty table gives an empty result.
    """
    rows = pieces.count()
    groups = max(1, -(-rows // group_pieces))
    at, turn, done = materialize(_pack_groups(pieces, groups, 0, capacity), "pack"), 0, []
    while True:
        gap = at.where("bins > bound").limit(1).count() > 0
        done.append(at.where("NOT released"))
        at = at.where("released")
        if groups == 1 and (turn or not gap):
            break
        turn += 1
        before, groups = _bins(at), max(1, -(-at.count() // group_pieces))
        again = materialize(_pack_groups(at, groups, turn, capacity), "pack")
        if _bins(again) >= before:
            break
        at = again
    done.append(at)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("released")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents with their places. Other columns than doc_id and text are not read.

    A null or empty text is one piece, of its end id alone; repeated rows and rows without doc_id are
    pieces of their own; texts longer than a sequence are cut; an empty table gives an empty result.
    """
    return pack_pieces(materialize(pieces_of(docs, vocabulary, capacity), "pieces"), capacity, group_pieces)
