"""WARC archives by way of a table of chunks.

Spark hands a cell of the input over whole. From there on a payload is rows of
(record, chunk number, bytes), each with the SHA-1 of the payload so far, cut at
character boundaries about every ``CHUNK_BYTES``: what is shuffled, sorted, written
and read back are chunks. The digest of a whole payload and the record that it may
refer to come from a light table of last chunks. Records of more than one chunk are
written as WARC segments (a response and its continuations). Spark's text writer
makes the files, one WARC record to a row; they are compressed, so a file is read
by one task, in order, which checks the running digests chunk by chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import bound_batches, require, stored
from flowgauge.session import scratch_path

CHUNK_BYTES = 64 << 10
LEAST_REVISIT = 1000
OUT_BYTES = 4 << 20
CHUNKS = "page_id long, url string, html_hash long, record long, chunk_no long, data binary, sha1 string, n_bytes long, last boolean"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def cut(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Slices of about ``size`` bytes that end between characters; one empty slice for an empty payload."""
    at, n = 0, len(payload)
    while True:
        end = min(at + size, n)
        while at < end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield payload[at:end]
        at = end
        if at >= n:
            return


def _chunker(size: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            texts = batch.column(4).cast(pa.binary())
            for key, text in zip(keys, texts):
                buffer = text.as_buffer()
                payload = memoryview(buffer) if buffer is not None else memoryview(b"")
                sha, done = hashlib.sha1(), 0
                for k, piece in enumerate(cut(payload, size)):
                    sha.update(piece)
                    done += len(piece)
                    last = done == len(payload)
                    if with_data or last:
                        rows.append((*key, k, bytes(piece) if with_data else None, sha.hexdigest(), done, last))
                        held += len(piece) + 100
                    if held > OUT_BYTES or len(rows) > 5000:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return run


def chunk_table(pages: DataFrame, size: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Rows (page_id, url, html_hash, record, chunk_no, data, sha1, n_bytes, last) of every payload.

    ``record`` tells the rows of one page from those of another that is alike. ``sha1`` and ``n_bytes`` run over the payload up to and including the chunk. A
    null html is an empty payload of one empty chunk. Without data only last chunks
    come, as a table of digests.
    """
    require(pages, "page_id", "url", "html")
    bound_batches(pages.sparkSession)
    page, url = F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")
    # a task that runs again makes all chunks of its pages anew, so a record's number is the same in all of them
    light = pages.select(page, url, F.xxhash64("html").alias("html_hash"), F.monotonically_increasing_id().alias("record"), "html")
    return light.mapInArrow(_chunker(size, with_data), CHUNKS)


def record_types(digests: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, html_hash, sha1, n_bytes, keeper): one row for each page id and payload.

    ``keeper`` is the largest page id with this payload, or null for a payload that
    is too short to be revisited.
    """
    rows = digests.select("page_id", "html_hash", "sha1", "n_bytes").distinct()
    keepers = rows.filter(F.col("n_bytes") >= least).groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("keeper"))
    return rows.join(keepers, ["sha1", "n_bytes"], "left")


def _record(fields: list[tuple[str, str]], block: list[bytes], token: str) -> bytes:
    """One WARC record without its last line feed, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    size = sum(map(len, block))
    return b"".join([f"WARC/1.1\r\nX-Archive: {token}\r\n{head}Content-Length: {size}\r\n\r\n".encode(), *block, b"\r\n\r"])


def _is_revisit() -> Column:
    return F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))


def _segment(row: dict, token: str) -> bytes:
    """The WARC record of one chunk: a response, a revisit or a continuation."""
    page = "" if row["page_id"] is None else str(row["page_id"])
    origin = uuid.uuid5(uuid.NAMESPACE_URL, f"{page}:{row['whole']}")
    running = ("X-Running-Digest", f"sha1:{row['sha1']}")
    if row["chunk_no"]:
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(origin, str(row['chunk_no']))}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Segment-Number", str(row["chunk_no"] + 1)),
            ("WARC-Segment-Origin-ID", f"<urn:uuid:{origin}>"),
            running,
        ]
        if row["last"]:
            fields.append(("WARC-Segment-Total-Length", str(row["total"] + len(HTTP_HEAD))))
        return _record(fields, [row["data"]], token)
    common = [
        ("WARC-Record-ID", f"<urn:uuid:{origin}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", row["url"] or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(row['whole'])).decode()}"),
        ("X-Page", page),
        ("X-Payload-Length", str(row["total"])),
    ]
    if row["revisit"]:
        fields = [("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        target = uuid.uuid5(uuid.NAMESPACE_URL, f"{row['keeper']}:{row['whole']}")
        return _record([*fields, ("WARC-Refers-To", f"<urn:uuid:{target}>"), ("X-Refers-To-Page", str(row["keeper"]))], [HTTP_HEAD], token)
    fields = [("WARC-Type", "response"), *common, ("Content-Type", "application/http;msgtype=response"), running]
    if not row["last"]:
        fields.append(("WARC-Segment-Number", "1"))
    return _record(fields, [HTTP_HEAD, row["data"]], token)


def write_archives(pages: DataFrame, path: str, size: int = CHUNK_BYTES, least: int = LEAST_REVISIT) -> str:
    """Write every row as a WARC record; returns the token that marks this archive's records.

    Of equal payloads of at least ``least`` bytes the row with the largest page id
    is a response and the others revisit it; rows that repeat page id and payload
    are alike, a null page id is smaller than any other, and if no row of a group
    has an id all are responses. A null html is an empty payload.
    """
    require(pages, "page_id", "url", "html")
    types = record_types(stored(chunk_table(pages, size, with_data=False), "digests"), least)
    kinds = types.select(
        F.col("page_id").alias("__page"), F.col("html_hash").alias("__hash"), F.col("sha1").alias("whole"), F.col("n_bytes").alias("total"), "keeper"
    )
    chunks = chunk_table(pages, size)
    same = chunks["page_id"].eqNullSafe(kinds["__page"]) & (chunks["html_hash"] == kinds["__hash"])
    joined = chunks.join(kinds.hint("shuffle_hash"), same).withColumn("revisit", _is_revisit())
    # a revisit is one record without its payload; the join has brought all chunks of a page into one partition
    kept = joined.where("not revisit or chunk_no = 0").withColumn("data", F.when(~F.col("revisit"), F.col("data")))
    rows = kept.select("page_id", "url", "html_hash", "record", "chunk_no", "data", "sha1", "last", "whole", "total", "keeper", "revisit")
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [_segment(row, token) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()).view(pa.string())], names=["value"])

    ordered = rows.sortWithinPartitions("page_id", "html_hash", "record", "chunk_no")
    ordered.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return token


class _Reader:
    """Follows the records of a file in order; holds one chunk at a time."""

    def __init__(self):
        self.head: dict[str, str] | None = None

    def feed(self, record: bytes) -> Iterator[tuple]:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
        block = memoryview(rest)[: int(fields["Content-Length"])]
        kind = fields["WARC-Type"]
        if kind == "revisit":
            yield self._row(fields, "revisit", int(fields["X-Payload-Length"]), None)
            return
        if kind == "response":
            if self.head is not None:
                raise ValueError("a record misses segments")
            self.head, self.sha, self.done = fields, hashlib.sha1(), 0
            block = block[len(HTTP_HEAD) :]
        elif self.head is None or fields["WARC-Segment-Origin-ID"] != self.head["WARC-Record-ID"]:
            raise ValueError("a segment without its record")
        self.sha.update(block)
        self.done += len(block)
        if fields["X-Running-Digest"] != f"sha1:{self.sha.hexdigest()}":
            raise ValueError("a chunk differs from its digest")
        if self.done >= int(self.head["X-Payload-Length"]):
            yield self._row(self.head, "response", self.done, self.sha.hexdigest())
            self.head = None

    @staticmethod
    def _row(fields: dict[str, str], kind: str, size: int, sha: str | None) -> tuple:
        named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if sha is not None and sha != named:
            raise ValueError("a payload differs from its digest")
        refers = fields.get("X-Refers-To-Page")
        return int(fields["X-Page"]) if fields["X-Page"] else None, size, named, kind, int(refers) if refers else None


def read_archives(spark: SparkSession, path: str, token: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archive.

    Digests of responses are computed from the chunks read and checked against
    those written; a difference or a missing segment raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            rows = [row for record in batch.column(0).cast(pa.binary()).to_pylist() if record for row in reader.feed(record)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        if reader.head is not None:
            raise ValueError("a record misses segments")

    bound_batches(spark)
    # the token is drawn after the payloads were made, so none of them holds it
    lines = spark.read.option("lineSep", f"WARC/1.1\r\nX-Archive: {token}\r\n").schema("value string").text(path)
    return lines.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages under the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    return read_archives(spark, path, write_archives(pages, path))
