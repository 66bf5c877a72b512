"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put together again in another order.

A rolling hash over 32 bytes cuts every text into chunks whose ends follow from
the content around them, so copies and texts that share passages share chunks.
A worker remembers a chunk's summary: its line ends, its code points, whether it
holds a marker, and the bytes at both edges. A remembered summary is taken only if
the whole content is equal. Summaries are combined from left to right: line ends
and code points add up, and a marker over an edge shows in the bytes beside it.
The running counts then tell in which chunk a cut lies; only that one is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import append, bound_batches, grown, require, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
EDGE = len(PREFIX) - 1
WINDOW = 32
#: A chunk's least and greatest size, and the bits of the hash that are zero at an end: 2 KB in the mean.
LEAST, MOST = 256, 16_384
END_BITS = np.uint32(0xFFE00000)
#: Bytes hashed at a time, and bytes of chunks that a worker's younger half remembers.
BLOCK = 1 << 20
KEPT_BYTES = 16 << 20


def _byte_numbers() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _byte_numbers()


def possible_ends(text: bytes) -> np.ndarray:
    """Places after which the hash of the last 32 bytes allows an end, in order."""
    found = []
    for at in range(0, len(text), BLOCK):
        before = min(at, WINDOW - 1)
        h = GEAR[np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at) + before, at - before)]
        width = 1
        while width < WINDOW:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
            width *= 2
        found.append(np.flatnonzero((h[before:] & END_BITS) == 0) + at + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(text: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    possible = possible_ends(text)
    ends, start = [], 0
    while n - start > LEAST:
        k = int(np.searchsorted(possible, start + LEAST))
        end = min(int(possible[k]) if k < len(possible) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


@dataclass(slots=True)
class Summary:
    """What a chunk adds to the counts of its text."""

    content: bytes
    lines: np.ndarray  # places just after a line end
    points: int
    marked: bool

    @classmethod
    def of(cls, content: bytes) -> Summary:
        lines = np.flatnonzero(np.frombuffer(content, np.uint8) == 10).astype(np.int32) + 1
        return cls(content, lines, code_points(content), any(m in content for m in MARKERS))


def code_points(data: bytes) -> int:
    if data.isascii():
        return len(data)
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


class Chunks:
    """A worker's bounded table of summaries by hash of the content; the older half goes first."""

    def __init__(self, kept_bytes: int = KEPT_BYTES):
        self.kept_bytes = kept_bytes
        self.young: dict[int, Summary] = {}
        self.old: dict[int, Summary] = {}
        self.size = 0
        self.shared = 0

    def summary(self, content: bytes) -> Summary:
        key = hash(content)
        known = self.young.get(key) or self.old.get(key)
        if known is not None and known.content == content:
            self.shared += 1
        else:
            known = Summary.of(content)
        if self.young.get(key) is not known:
            if self.size > self.kept_bytes:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[key] = known
            self.size += len(content) + known.lines.nbytes
        return known


class Counts:
    """Running counts of a text's chunks."""

    def __init__(self, text: bytes, chunks: Chunks):
        self.text = text
        self.parts: list[Summary] = []
        starts, lines, points = [0], [0], [0]
        edge, self.marked = b"", False
        for end in chunk_ends(text):
            part = chunks.summary(text[starts[-1] : end])
            self.parts.append(part)
            over = edge + part.content[:EDGE]
            self.marked = self.marked or part.marked or any(m in over for m in MARKERS)
            edge = (edge + part.content[-EDGE:])[-EDGE:]
            starts.append(end)
            lines.append(lines[-1] + len(part.lines))
            points.append(points[-1] + part.points)
        self.starts, self.lines, self.points = starts, np.array(lines, np.int64), points
        self.units = lines[-1] + (text[-1:] not in (b"", b"\n"))

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) up to the end of a unit, counted from 1; nothing for unit 0."""
        if not unit:
            return 0, 0
        if unit > self.lines[-1]:
            return len(self.text), self.points[-1]
        k = int(np.searchsorted(self.lines, unit)) - 1
        at = int(self.parts[k].lines[unit - int(self.lines[k]) - 1])
        return self.starts[k] + at, self.points[k] + code_points(self.parts[k].content[:at])


def transformed(text: bytes, key: bytes, rate: int, spm: int, chunks: Chunks) -> tuple[int, str, bytes, int | None, int | None]:
    """(units, form, output, code points of prefix and of middle) of one text."""
    counts = Counts(text, chunks)
    n = counts.units
    digest = sha256(key).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))
    if not text or counts.marked or h3 % 100 >= rate:
        return n, "plain", text, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, until) = counts.cut(first), counts.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), before, until - before
    return n, "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), before, until - before


_CHUNKS: list[Chunks] = []


def worker_chunks() -> Chunks:
    """A worker's table outlives its tasks."""
    if not _CHUNKS:
        _CHUNKS.append(Chunks())
    return _CHUNKS[0]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, out: str = "output"
) -> DataFrame:
    """Add ``n``, ``form`` (plain, psm or spm), the output text, and ``prefix_chars`` and ``middle_chars``.

    The four draws of a row come from sha256 of ``seed:id`` (an empty id for null),
    so they follow from the id alone. ``rate`` percent of the texts are cut, ``spm``
    percent of these get the suffix first. A null text is read as an empty one; empty
    texts and texts that hold a marker stay plain, with null counts of characters.
    Rows that repeat stay; columns named like the new ones are replaced. No row is
    shuffled; a batch of texts is bounded by bytes.
    """
    require(docs, id_col, text)
    bound_batches(docs.sparkSession)
    added = ("n", "form", out, "prefix_chars", "middle_chars")
    kept = [c for c in docs.columns if c not in added]
    # the id and the text may themselves be replaced
    work = docs.select(*kept, F.col(id_col).cast("string").alias("__id"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = worker_chunks()
        for batch in batches:
            ids, texts = utf8(batch.column(len(kept))), utf8(batch.column(len(kept) + 1))
            rows = [transformed(t or b"", b"%d:%s" % (seed, i or b""), rate, spm, chunks) for i, t in zip(ids, texts)]
            n, form, output, before, middle = zip(*rows) if rows else ((),) * 5
            columns = (
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(output, pa.binary()).cast(pa.string()),
                pa.array(before, pa.int64()),
                pa.array(middle, pa.int64()),
            )
            yield append(pa.RecordBatch.from_arrays(batch.columns[: len(kept)], names=kept), **dict(zip(added, columns)))

    schema = grown(docs.select(*kept), f"n long, form string, `{out}` string, prefix_chars long, middle_chars long")
    return work.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone. Cut texts hold no marker of their own."""

    def between(start: str, end: str | None) -> Column:
        at = F.instr(output, start) + 3
        return F.substr(output, at, F.instr(output, end) - at) if end else F.substr(output, at)

    psm = F.concat(between("<P>", "<S>"), between("<M>", None), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), between("<M>", None), between("<S>", "<P>"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
