"""Benchmark decontamination by suffix arrays of the training texts.

Documents are cut into shards of about ``SHARD_WORDS`` words as they stream by (a
document is never cut). Each shard's word suffix array is sorted to the depth of
a window, every benchmark suffix is looked up in it by binary search, and the
positions found are extended to the longest verbatim matches. Shards are
independent, so nothing is shuffled. The benchmark is sent to the tasks in
blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark takes one pass per
block over the rows, in a chain.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import append, bound_batches, grown, require, runs, utf8

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 8 << 20
#: A-Z lower-cased; what is neither a digit, a letter nor above ASCII becomes a blank.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
SPAN = "array<struct<item:string,words:int,doc_start:int,item_start:int>>"
SPAN_TYPE = pa.list_(pa.struct([("item", pa.string()), ("words", pa.int32()), ("doc_start", pa.int32()), ("item_start", pa.int32())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class SuffixArray:
    """Word suffixes of a shard, ordered by their first ``depth`` words; 0 ends every document."""

    def __init__(self, ids: np.ndarray, top: int, depth: int):
        bits = max(1, int(top).bit_length())
        self.bits, self.per = bits, max(1, 63 // bits)
        padded = np.concatenate([ids, np.zeros(self.per + depth, np.int64)])
        key = np.zeros(len(ids) + depth, np.int64)
        for j in range(self.per):
            key = (key << bits) | padded[j : j + len(key)]
        self.key = key  # several words in one number
        order = np.argsort(key[: len(ids)], kind="stable")
        part = key[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = part[1:] != part[:-1]
        for at in range(self.per, depth, self.per):
            same = ~fresh
            same[:-1] |= ~fresh[1:]
            open_ = np.flatnonzero(same)
            if not len(open_):
                break
            group = np.cumsum(fresh)[open_]
            part = key[np.minimum(order[open_] + at, len(key) - 1)]
            again = np.lexsort((part, group))
            order[open_] = order[open_][again]
            part = part[again]
            new = np.ones(len(open_), bool)
            new[1:] = (part[1:] != part[:-1]) | (group[1:] != group[:-1])
            fresh[open_] |= new
        self.order = order

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) in the order of suffixes that begin with each window."""
        width = windows.shape[1]
        wanted = []
        for at in range(0, width, self.per):
            take = min(self.per, width - at)
            k = np.zeros(len(windows), np.int64)
            for j in range(take):
                k = (k << self.bits) | windows[:, at + j]
            wanted.append((at, self.bits * (self.per - take), k))

        def bound(right: bool) -> np.ndarray:
            low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.order), np.int64)
            while (open_ := low < high).any():
                mid = (low + high) >> 1
                place = self.order[np.minimum(mid, len(self.order) - 1)]
                less = np.zeros(len(windows), bool)
                equal = np.ones(len(windows), bool)
                for at, drop, k in wanted:
                    here = self.key[np.minimum(place + at, len(self.key) - 1)] >> drop
                    less |= equal & (here < k)
                    equal &= here == k
                go = less | equal if right else less
                low = np.where(open_ & go, mid + 1, low)
                high = np.where(open_ & ~go, mid, high)
            return low

        return bound(False), bound(True)


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) for each place of ranges of n places."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]


class Benchmark:
    """Windows of the items, grouped by width: (item, start, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        self.words = sorted({w for _, ws in items for w in ws})
        number = {w: i for i, w in enumerate(self.words)}
        by_width: dict[int, list[tuple[int, int, list[int]]]] = defaultdict(list)
        for i, (_, ws) in enumerate(items):
            ids = [number[w] for w in ws]
            width = min(window, len(ids))
            for at in range(len(ids) - width + 1 if ids else 0):
                by_width[width].append((i, at, ids[at : at + width]))
        self.windows = {}
        for width, found in by_width.items():
            table = np.array([w for _, _, w in found], np.int64).reshape(len(found), width)
            unique, group = np.unique(table, axis=0, return_inverse=True)
            group = group.reshape(-1)
            order = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[order], np.arange(len(unique) + 1))
            owner = np.array([i for i, _, _ in found], np.int64)[order]
            at = np.array([a for _, a, _ in found], np.int64)[order]
            self.windows[width] = (unique, starts, owner, at)


def scan_shard(texts: list[list[bytes]], bench: Benchmark, window: int) -> tuple[np.ndarray, list[list[tuple]]]:
    """Per document: words, maximal matches (item, words, start in document, start in item)."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum()) + len(texts)
    ids = np.zeros(total, np.int64)
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    for begin, words in zip(begins.tolist(), texts):
        ids[begin : begin + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    here = np.array([number.get(w, 0) for w in bench.words], np.int64)
    matches: list[list[tuple]] = [[] for _ in texts]
    array = None
    for width, (table, starts, owner, at) in bench.windows.items():
        windows = here[table]
        alive = np.flatnonzero((windows > 0).all(axis=1))
        if not len(alive):
            continue
        if array is None:
            array = SuffixArray(ids, len(number), window)
        low, high = array.find(windows[alive])
        hit, place = spread(low, high - low)
        if not len(hit):
            continue
        place = array.order[place]
        hit = alive[hit]
        doc = np.searchsorted(ends, place, "right")
        # every item that has the window; places on one diagonal make one match
        source, use = spread(starts[hit], starts[hit + 1] - starts[hit])
        item, start, spot, doc = owner[use], at[use], place[source], doc[source]
        order = np.lexsort((spot, spot - start, item, doc))
        item, start, spot, doc = item[order], start[order], spot[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (item[1:] != item[:-1]) | (spot[1:] != spot[:-1] + 1) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order))) + width - 1
        for k, size in zip(first.tolist(), n.tolist()):
            d = int(doc[k])
            matches[d].append((bench.names[item[k]], size, int(spot[k] - begins[d]), int(start[k])))
    return lengths, matches


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).toArrow()
        yield [(i, words_of(t)) for i, t in zip(part["item"].to_pylist(), utf8(part["text"]))]


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_words`` and ``matches`` to every document.

    A match is a longest verbatim run of at least ``window`` words shared with an
    item (of all its words, for a shorter item): item, words, first word in the
    document and in the item; `covered_words` counts what they cover. Null and empty texts have no words and no match;
    items without words never match, a null item id is named ``null``, repeated
    items report once each. Documents may repeat; their other columns stay, apart
    from any named like the new ones.
    """
    require(docs, text)
    require(benchmark, item_id, item_text)
    spark = docs.sparkSession
    bound_batches(spark)
    work = docs.select(*[c for c in docs.columns if c not in ("n_words", "matches")])
    at = work.columns.index(text)

    def scanner(sent, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(sent.value, window)
            for batch in batches:
                texts = [words_of(t) for t in utf8(batch.column(at))]
                for a, b in runs([len(t) + 1 for t in texts], shard_words):
                    n, found = scan_shard(texts[a:b], bench, window)
                    part = batch.slice(a, b - a)
                    if not first:
                        old = part.column(part.schema.get_field_index("matches")).to_pylist()
                        found = [[*map(lambda m: tuple(m.values()), x), *y] for x, y in zip(old, found)]
                        part = part.select(part.schema.names[:-2])
                    spans = [[dict(zip(("item", "words", "doc_start", "item_start"), m)) for m in sorted(set(f))] for f in found]
                    yield append(part, n_words=pa.array(n), matches=pa.array(spans, SPAN_TYPE))

        return run

    schema = grown(work, f"n_words long, matches {SPAN}")
    out = work
    for k, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        out = out.mapInArrow(scanner(spark.sparkContext.broadcast(block), k == 0), schema)
    return out


def covered_words(matches: str = "matches"):
    """Words covered by at least one match: a sweep over matches in order of their start."""
    m = F.col(matches)
    ordered = F.sort_array(F.transform(m, lambda x: F.struct(x["doc_start"].alias("a"), (x["doc_start"] + x["words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(s["end"], x["b"]).alias("end"),
    )
    return F.aggregate(ordered, start, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Only documents that share no window with any item; columns stay as they are."""
    found = find_matches(docs, benchmark, **options)
    return found.filter(F.size("matches") == 0).select(*docs.columns)

