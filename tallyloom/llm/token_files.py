"""Token files: patched frame-of-reference blocks of ids, in ascending doc_id order.

A file is a folder of Parquet parts that Spark writes and commits. Its rows are frames of consecutive
documents: part, frame, start (ids before the frame within its part), n_ids, doc_ids, lengths and
payload. A payload is
    u32 ids, u32 blocks, u32 start of each block, then the blocks of up to 128 ids each:
    u32 minimum, u8 width, u8 exceptions, u8 bytes per exception,
    (id - minimum) modulo 2^width packed in width bits each, low bit first,
    u8 position of each exception, and its remaining high bits, little-endian.
The width is that of the percentile of the block's differences that makes the block smallest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty
from .tokens import encoded

BLOCK = 128
PERCENTILES = (50, 75, 85, 90, 95, 98, 100)
FRAME_IDS = 1 << 17
FRAME_SCHEMA = "part int, frame int, start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
FRAME_TYPES = pa.schema(
    [("part", pa.int32()), ("frame", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]
)


#: Bits of each number below 2^16.
BIT_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _low_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK unsigned 32-bit values as rows of bytes, width bits for each, low bit first."""
    if width > 16:
        bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(*values.shape, 4), axis=2, count=width, bitorder="little")
        return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")
    # eight values take width bytes: two halves of four values, each in one 64-bit word
    w = np.uint64(width)
    four = (values.astype("<u8") & np.uint64((1 << width) - 1)).reshape(len(values), -1, 2, 4)
    half = four[..., 0] | four[..., 1] << w | four[..., 2] << (w + w) | four[..., 3] << (w + w + w)
    if width < 16:
        high = half[..., 1]
        half = np.stack([half[..., 0] | high << (4 * w), high >> (64 - 4 * w)], axis=-1)
    return np.ascontiguousarray(half, "<u8").view(np.uint8).reshape(len(values), -1, 16)[:, :, :width].reshape(len(values), -1)


def _from_bits(lines: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _low_bits."""
    if width > 16:
        bits = np.zeros((len(lines), BLOCK, 32), np.uint8)
        bits[:, :, :width] = np.unpackbits(lines, axis=1, bitorder="little").reshape(len(lines), BLOCK, width)
        return np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    w, raw = np.uint64(width), np.zeros((len(lines), BLOCK // 8, 16), np.uint8)
    raw[:, :, :width] = lines.reshape(len(lines), -1, width)
    half = raw.view("<u8")
    if width < 16:
        half = np.stack([half[..., 0], half[..., 0] >> (4 * w) | half[..., 1] << (64 - 4 * w)], axis=-1)
    out = np.empty((*half.shape, 4), "<u4")
    for k in range(4):
        out[..., k] = half >> (k * w) & np.uint64((1 << width) - 1)
    return out.reshape(len(lines), BLOCK)


def _widths(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(width, most): the bits of each block's packed values, and those of its largest."""
    needed = BIT_LENGTHS[table & 0xFFFF]
    if (table >> 16).any():
        needed = np.where(table >> 16, BIT_LENGTHS[table >> 16] + 16, needed)
    blocks = len(table)
    at = needed + (np.arange(blocks, dtype=np.int32) * 33)[:, None]
    below = np.cumsum(np.bincount(at.ravel(), minlength=33 * blocks).reshape(blocks, 33), axis=1)
    most = (below < BLOCK).sum(axis=1)
    width, least = most, most * BLOCK
    for p in PERCENTILES[:-1]:
        w = (below < p * BLOCK // 100).sum(axis=1)
        cost = w * BLOCK + (BLOCK - below[np.arange(blocks), w]) * 8 * (1 + (most - w + 7) // 8)
        width, least = np.where(cost < least, w, width), np.minimum(cost, least)
    return width, most


def pack(ids: np.ndarray) -> bytes:
    """The payload of a sequence of unsigned 32-bit ids."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return struct.pack("<II", 0, 0)
    table = np.full(blocks * BLOCK, ids[-1], "<u4")
    table[:n] = ids
    table = table.reshape(blocks, BLOCK)
    least = table.min(axis=1)
    table = table - least[:, None]
    width, most = _widths(table)
    high = (most - width + 7) // 8
    shift = width[:, None].astype(np.uint32)
    outlier = np.where(shift < 32, table >> np.minimum(shift, 31), 0).astype("<u4", copy=False)
    row, column = np.nonzero(outlier)
    count = np.bincount(row, minlength=blocks)
    sizes = 7 + BLOCK // 8 * width + count * (1 + high)
    first = 8 + 4 * blocks
    starts = first + np.cumsum(sizes) - sizes
    out = np.zeros(first + int(sizes.sum()), np.uint8)
    out[:8] = np.frombuffer(struct.pack("<II", n, blocks), np.uint8)
    out[8:first] = starts.astype("<u4").view(np.uint8)
    heads = np.column_stack([least.astype("<u4").view(np.uint8).reshape(-1, 4), width, count, high])
    out[starts[:, None] + np.arange(7)] = heads
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        out[(starts[rows] + 7)[:, None] + np.arange(BLOCK // 8 * w)] = _low_bits(table[rows], w)
    order = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    base = starts[row] + 7 + BLOCK // 8 * width[row]
    out[base + order] = column
    for byte in range(4):
        has = high[row] > byte
        out[(base + count[row] + order * high[row] + byte)[has]] = (outlier[row, column][has] >> (8 * byte)) & 255
    return out.tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload, as little-endian unsigned 32-bit integers."""
    n, blocks = struct.unpack_from("<II", payload)
    if not n:
        return np.zeros(0, "<u4")
    raw = np.frombuffer(payload, np.uint8)
    starts = np.frombuffer(payload, "<u4", blocks, 8).astype(np.int64)
    heads = raw[starts[:, None] + np.arange(7)]
    least = np.ascontiguousarray(heads[:, :4]).view("<u4").ravel()
    width, count, high = (heads[:, k].astype(np.int64) for k in (4, 5, 6))
    table = np.zeros((blocks, BLOCK), "<u4")
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        lines = raw[(starts[rows] + 7)[:, None] + np.arange(BLOCK // 8 * w)]
        table[rows] = _from_bits(lines, w)
    row = np.repeat(np.arange(blocks), count)
    order = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    base = starts[row] + 7 + BLOCK // 8 * width[row]
    extra = np.zeros(len(row), np.uint64)
    for byte in range(4):
        has = high[row] > byte
        extra[has] |= raw[(base + count[row] + order * high[row] + byte)[has]].astype(np.uint64) << np.uint64(8 * byte)
    table[row, raw[base + order]] += (extra << width[row].astype(np.uint64)).astype("<u4")
    return (table + least[:, None]).ravel()[:n]


def write_token_file(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Writes the ids of every whole text, each with the end id, in ascending doc_id order.

    Null texts count as empty; rows without doc_id come first; rows of equal doc_id stand in the order
    of a hash of their texts, then of the texts, so that any number of them spreads over tasks. An empty
    table gives an empty file. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, frame, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            row = {"part": part, "frame": frame, "start": start, "n_ids": size, "doc_ids": names, "lengths": sizes, "payload": pack(np.concatenate(held))}
            return pa.RecordBatch.from_pylist([row], FRAME_TYPES)

        for rows, ids, lengths in encoded(batches, vocabulary):
            ends, at = np.cumsum(lengths), 0
            all_names = rows.column("name").to_pylist()
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                stop = min(len(ends), int(np.searchsorted(ends, before + FRAME_IDS - size)) + 1)
                names, sizes = names + all_names[at:stop], sizes + lengths[at:stop].tolist()
                held.append(ids[before : ends[stop - 1]])
                size, at = size + len(held[-1]), stop
                if size >= FRAME_IDS:
                    yield close()
                    frame, start, names, sizes, held, size = frame + 1, start + size, [], [], [], 0
        if held:
            yield close()

    body = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("name"), F.xxhash64(body).alias("mark"), body.alias("body"))
    ordered = rows.repartitionByRange("name", "mark").sortWithinPartitions("name", "mark", "body").select("name", "body")
    ordered.mapInArrow(run, FRAME_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens and ids_crc32, from the payloads."""
    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)
    sizes = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each part that was written
    before, offsets = 0, []
    for row in sorted(sizes):
        offsets.append((row["part"], before))
        before += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, names, lengths, payload = (batch.column(k)[row] for k in range(5))
                ids, sizes = unpack(payload.as_buffer()), lengths.values.to_numpy()
                begins = np.cumsum(sizes) - sizes
                sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(np.full(len(sizes), part.as_py(), np.int32)), pa.array(start.as_py() + begins), pa.array(sizes), pa.array(sums, pa.int64())],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                )

    found = frames.select("part", "start", "doc_ids", "lengths", "payload").mapInArrow(
        run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long"
    )
    before_part = spark.createDataFrame(offsets, "part int, ahead long")
    return found.join(F.broadcast(before_part), "part").select(
        "doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes docs to a token file in the shared folder and describes it from what is read back."""
    path = scratch_path(docs.sparkSession, "token-file")
    write_token_file(docs, path, vocabulary)
    return read_token_file(docs.sparkSession, path)
