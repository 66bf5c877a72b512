"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

Documents are dealt to chunks of about ``CHUNK_BYTES`` by a hash. Each chunk
explodes its texts into n-grams of all orders, counts each distinct one once and
sends (hash, count) to the hash partition that the n-gram belongs to. There the
parts of all chunks add up to the count table, and every chunk's n-grams are
joined to it and go back with their corpus counts. The chunk then scores its texts
and sums per document. As a chunk sends an n-gram once, however often it occurs, a
very common n-gram weighs no more than any other; nothing reaches the driver.

Between tasks n-grams travel packed: sorted 64-bit hashes as differences, cut into
byte planes, which the shuffle's compression shrinks well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import bound_batches, require

ALPHA = 0.4
CHUNK_BYTES = 8 << 20
BUCKETS_PER_CHUNK = 1
EMPTY = np.uint64(0x5851F42D4C957F2D)  # hash of the n-gram of no words, whose count is the corpus size
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(text: bytes, seen: dict[bytes, int]) -> np.ndarray:
    """One hash per word: runs of non-white ASCII, A-Z lower-cased."""
    words = text.lower().split()
    for w in set(words):
        if w not in seen:
            seen[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the n-grams that end at each place from the order-th on."""
    if len(words) < order:
        return np.zeros(0, np.uint64)
    n = len(words) - order + 1
    h = np.full(n, EMPTY)
    for j in range(order):
        h = (h ^ words[j : j + n]) * STEP
        h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table["text"].combine_chunks().cast(pa.binary()).to_pylist()]


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each comes."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[first], np.diff(np.append(first, len(sorted_values)))


def _distinct(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct n-grams of a chunk (sorted), their counts, and the word hashes of each text."""
    seen: dict[bytes, int] = {}
    words = [word_hashes(t, seen) for t in texts]
    del seen
    grams, counts = np.array([EMPTY]), np.array([sum(map(len, words))], np.int64)
    for n in range(1, order + 1):
        found = np.concatenate([np.zeros(0, np.uint64), *(gram_hashes(w, n) for w in words)])
        found.sort()
        found, times = _runs(found)
        grams, counts = np.concatenate([grams, found]), np.concatenate([counts, times])
    at = np.argsort(grams, kind="stable")
    return grams[at], counts[at], words


def _ask(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        grams, counts, _ = _distinct(_texts(table), order)
        width = (1 << 64) // buckets + 1
        cuts = np.searchsorted(grams, np.array([b * width for b in range(1, buckets)], np.uint64))
        edges = [0, *cuts.tolist(), len(grams)]
        rows = []
        for b, (i, j) in enumerate(zip(edges, edges[1:])):
            if j > i:
                steps = np.diff(grams[i:j], prepend=np.uint64(0))
                rows.append((table["chunk"][0].as_py(), b, planes(steps), planes(counts[i:j])))
        columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
        return pa.Table.from_arrays(columns, names=["chunk", "bucket", "grams", "counts"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """The count table of one hash partition, joined back to what each chunk sent."""
    table = table.combine_chunks()
    grams = np.concatenate([np.cumsum(unplanes(g, np.uint64), dtype=np.uint64) for g in table["grams"].to_pylist()])
    counts = [unplanes(c, np.int64) for c in table["counts"].to_pylist()]
    ends = np.cumsum([len(c) for c in counts]).tolist()
    counts = np.concatenate(counts)
    at = np.argsort(grams, kind="stable")
    _, times = _runs(grams[at])
    del grams
    starts = np.cumsum(times) - times
    total = np.empty(len(counts), np.int64)
    total[at] = np.repeat(np.add.reduceat(counts[at], starts), times)
    back = [planes(total[i:j]) for i, j in zip([0, *ends], ends)]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "totals": pa.array(back, pa.binary())})


def log_scores(words: np.ndarray, order: int, count_of, alpha: float, min_count: int) -> tuple[float, int]:
    """Sum of log scores of a text and the number of words that backed off."""
    n = len(words)
    if not n:
        return 0.0, 0
    corpus = count_of(np.array([EMPTY]))[0]
    counts = [None, *(count_of(gram_hashes(words, k)) for k in range(1, order + 1))]
    score = np.zeros(n)
    open_ = np.ones(n, bool)
    backed = np.zeros(n, bool)
    for k in range(min(order, n), 1, -1):
        ends = np.arange(k - 1, n)
        take = open_[ends] & (counts[k] >= min_count)
        score[ends[take]] += np.log(counts[k][take] / counts[k - 1][: n - k + 1][take])
        miss = open_[ends] & ~take
        score[ends[miss]] += math.log(alpha)
        backed[ends[miss]] = True
        open_[ends[take]] = False
    score[open_] += np.log(counts[1][open_] / corpus)
    return float(score.sum()), int(backed.sum())


def _score(order: int, alpha: float, min_count: int):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in (texts.schema.field("id").type, pa.int64(), pa.float64(), pa.int64())], names=["id", "n_tokens", "log_score", "n_backoff"])
        grams, _, words = _distinct(_texts(texts), order)
        ordered = replies.sort_by("bucket")
        totals = np.concatenate([unplanes(t, np.int64) for t in ordered["totals"].to_pylist()])

        def count_of(h: np.ndarray) -> np.ndarray:
            return totals[np.searchsorted(grams, h)]

        found = [log_scores(w, order, count_of, alpha, min_count) for w in words]
        return pa.Table.from_arrays(
            [texts["id"].combine_chunks(), pa.array(map(len, words), pa.int64()), pa.array([s for s, _ in found], pa.float64()), pa.array([b for _, b in found], pa.int64())],
            names=["id", "n_tokens", "log_score", "n_backoff"],
        )

    return run


def backoff_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    order: int = 2,
    alpha: float = ALPHA,
    min_count: int = 2,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(id, n_tokens, log_score, n_backoff) of every row, scored by counts over all rows.

    The score of a word is count(n-gram) / count(its context) for the longest
    n-gram up to ``order`` that occurs at least ``min_count`` times in the corpus,
    times ``alpha`` for each order given up; single words use their share of the
    corpus. ``log_score`` sums natural logarithms over the text. Null, empty and
    blank texts have no tokens and score 0. Repeated rows count and score each;
    null ids are kept; an empty table gives none. N-grams are told apart by 64-bit
    hashes.
    """
    require(docs, id_col, text)
    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    light = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    dealt = light.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks).cast("long")))
    asked = dealt.groupBy("chunk").applyInArrow(_ask(order, chunks * BUCKETS_PER_CHUNK), "chunk long, bucket long, grams binary, counts binary")
    replies = asked.groupBy("bucket").applyInArrow(_count, "chunk long, bucket long, totals binary")
    kind = dict(light.dtypes)["id"]
    scored = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _score(order, alpha, min_count), f"id {kind}, n_tokens long, log_score double, n_backoff long"
    )
    return scored.withColumnRenamed("id", id_col)
