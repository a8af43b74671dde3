"""WARC archives written by Spark, and captures assembled from their records.

Each page gives three WARC/1.1 records: a request and a metadata record, which name the response in
WARC-Concurrent-To, and the response itself, or a revisit that names the response of an equal payload
in WARC-Refers-To. Reading joins the records through these identifiers alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_BASE32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CRLF = "\r\n"
WARC_DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 3000
RECORD_SCHEMA = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "claimed_digest string, payload_bytes long, payload_digest string, page_id long, block string"
)
RECORD_TYPES = [*[pa.string()] * 6, pa.int64(), pa.string(), pa.int64(), pa.string()]


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1: ten hexadecimal digits are eight base32 digits."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), HEX_BASE32, BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the last line end, which the text writer adds. Headers of null value are left out."""
    lines = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {WARC_DATE}{CRLF}WARC-Record-ID: "), record_id, F.lit(CRLF)]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    length = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), length, F.lit(CRLF + CRLF), block, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Writes gzip WARC files of the pages' records.

    Null html counts as empty. Of equal payloads of at least min_revisit_bytes, the row of the
    largest page_id is the response, one of them if rows repeat; the others are revisits. Line ends
    in a url become spaces; a null url gives no target. Other columns are not read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    stored = materialize(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.regexp_replace("url", r"[\r\n]", " ").alias("url"),
            html.alias("payload"),
            F.sha2(html, 256).alias("content"),
            sha1_base32(html).alias("sha1"),
            F.octet_length(html).cast("long").alias("bytes"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "warc-pages",
        compression="zstd",
    )
    # equal payloads meet by narrow rows; the payloads themselves move by their own row numbers, which no page shares
    narrow = stored.select("content", "bytes", "page_id", "row_no")
    first = narrow.groupBy("content", "bytes").agg(F.coalesce(F.max_by("row_no", "page_id"), F.min("row_no")).alias("response_row"))
    answer_rows = materialize(narrow.join(first, ["content", "bytes"]).select("row_no", "response_row"), "warc-answers")
    rows = stored.join(answer_rows.hint("merge"), "row_no")
    answers = (F.col("row_no") == F.col("response_row")) | (F.col("bytes") < min_revisit_bytes)
    response_id = _urn(F.lit("response"), F.col("response_row").cast("string"))
    own_id = F.when(answers, _urn(F.lit("response"), F.col("row_no").cast("string"))).otherwise(_urn(F.lit("revisit"), F.col("row_no").cast("string")))
    uri = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    http = ("Content-Type", F.lit("application/http;msgtype=response"))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    response = _record("response", own_id, [uri, digest, http], F.concat(head, F.col("payload")))
    revisit = _record("revisit", own_id, [uri, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", response_id), digest, http], head)
    host = F.coalesce(F.regexp_extract("url", r"^\w+://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract("url", r"^\w+://[^/?#]*([^#]*)", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    together = ("WARC-Concurrent-To", own_id)
    row_no = F.col("row_no").cast("string")
    request = _record("request", _urn(F.lit("request"), row_no), [uri, together, ("Content-Type", F.lit("application/http;msgtype=request"))], ask)
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", _urn(F.lit("metadata"), row_no), [uri, together, ("Content-Type", F.lit("application/warc-fields"))], about)
    records = rows.select(F.explode(F.array(request, F.when(answers, response).otherwise(revisit), metadata)).alias("value"))
    records.write.options(lineSep=CRLF, compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE).text(path)


def parse_records(lines: Iterable[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(header, block) of the records that lines, without their line ends, hold one after the other.

    A block's bounds are its Content-Length alone. No more than one record is held.
    """
    head: dict = {}
    parts: list[bytes] = []
    size = left = -1  # left: bytes of the block and its line ends still to come
    for line in lines:
        if left < 0:
            if line:
                if not head and line != VERSION.encode():
                    if parts or line.strip():
                        raise ValueError(f"no {VERSION} record at {line[:40]!r}")
                elif not head:
                    head = {"": VERSION}
                else:
                    name, value = line.decode().split(": ", 1)
                    head[name] = value
            elif head:
                size = int(head["Content-Length"])
                left = size
                parts = []
            continue
        parts.append(line)
        left -= len(line) + 2
        if left <= -2:  # the line end behind the block was this line's
            block = b"\r\n".join(parts)
            yield head, block[:size]
            head, parts, left = {}, [], -1


def read_archive(spark: SparkSession, path: str, with_blocks: bool = False) -> DataFrame:
    """One row per record. Lengths and digests are taken from the payload bytes; block holds the text of a
    record's block if with_blocks is set.

    Files are read as streams of lines: what a task holds is a batch of them and one record, whatever
    the size of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0
        lines = (line for batch in batches for line in batch.column("value").cast(pa.binary()).to_pylist())
        for head, block in parse_records(lines):
            kind, page, size, digest = head["WARC-Type"], None, None, None
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            elif kind == "metadata":
                name = dict(x.split(": ", 1) for x in block.decode().splitlines()).get("pageId")
                page = int(name) if name else None
            claimed = head.get("WARC-Payload-Digest", ":").split(":", 1)[1] or None
            text = block.decode() if with_blocks else None
            ids = (head.get(x) for x in ("WARC-Record-ID", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Target-URI"))
            rows.append((kind, *ids, claimed, size, digest, page, text))
            held += len(text or "")
            if len(rows) >= 4096 or held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_TYPES, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_TYPES, strict=True)], names)

    return spark.read.option("lineSep", CRLF).option("pathGlobFilter", "*.gz").text(path).mapInArrow(run, RECORD_SCHEMA)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, page_id, answer, request, metadata, original.

    Requests and metadata meet their response or revisit through concurrent-to; a revisit meets the
    response it refers to, `original`, which is the answer itself otherwise. Captures without request
    or metadata have nulls there; requests and metadata of no capture are left out. Records without id
    are in no capture; no records give no captures; columns beyond those of the archives are not read.
    """

    def of(kind: str, name: str) -> DataFrame:
        return records.where(F.col("warc_type") == kind).select(
            F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri", "block").alias(name), F.col("page_id").alias(f"{name}_page")
        )

    kept = F.struct("record_id", "target_uri", "claimed_digest", "payload_bytes", "payload_digest", "block")
    answers = records.where(F.col("warc_type").isin("response", "revisit")).select(
        "record_id", F.col("warc_type").alias("record_type"), F.coalesce("refers_to", "record_id").alias("original_id"), kept.alias("answer")
    )
    captures = (
        answers.join(of("request", "request"), "record_id", "left")
        .join(of("metadata", "metadata"), "record_id", "left")
        .withColumnRenamed("metadata_page", "page_id")
        .drop("request_page")
    )
    captures = materialize(captures, "warc-captures", compression="zstd")
    originals = captures.where("record_type = 'response'").select(
        F.col("record_id").alias("original_id"), F.struct(F.col("page_id"), F.col("answer.payload_bytes"), F.col("answer.payload_digest")).alias("original")
    )
    return captures.join(originals, "original_id", "left")


def archive_digest(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives, reads them back and describes each capture.

    Null html counts as empty, repeated rows are captures of their own, rows without page_id keep none; an
    empty table gives an empty result. Other columns than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, min_revisit_bytes)
    records = read_archive(spark, path).withColumn("target_uri", F.lit(None).cast("string"))  # not part of the digest
    captures = assemble_captures(materialize(records, "warc-records", compression="zstd"))
    return captures.select(
        "page_id",
        F.col("original.payload_bytes").alias("payload_bytes"),
        F.col("original.payload_digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("original.page_id")).alias("refers_to"),
    )
