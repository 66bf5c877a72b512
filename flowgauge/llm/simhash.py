"""Near-duplicate groups: SimHash fingerprints linked by anchor-point covering.

Anchors are the words of a covering code: a direct sum of perfect cyclic codes,
each on a block of fingerprint bits. Every fingerprint goes to all anchors whose
distance is at most the covering radius plus the threshold, counted block by
block: what a block's distance exceeds its radius by adds up to at most the
threshold. The anchor nearest to one fingerprint of a close pair is thus among
the anchors of the other, so the pair meets there and is compared on all bits.

A run of rows at one anchor is compared as it streams by, up to ``ANCHOR_ROWS``
members. Fingerprints of fuller anchors (dense groups of near copies) are linked
exactly by one-bit neighbourhoods instead: two fingerprints within two bits
share a word at one bit from both, and such a word has at most 65 neighbours.
Either way only spanning links leave a task, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import bound_batches, grown, require, segment_sums, stored, utf8
from flowgauge.llm.components import components

BITS = 64
THRESHOLD = 2
ANCHOR_ROWS = 512
LANES = np.uint64(0x0101010101010101)
#: Fixed values: (bits, generator polynomial, covering radius) of the perfect codes
#: used, the binary Golay code twice and then a Hamming code.
CODES = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1))


# --- fingerprints -------------------------------------------------------------------


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per segment: bits set in more than half of its hashes.

    Bits are summed in byte lanes of at most 255 rows, then over the lanes.
    """
    pieces = -(-counts // 255)
    lanes = np.full(int(pieces.sum()), 255, np.int64)
    full = np.flatnonzero(counts)
    lanes[np.cumsum(pieces)[full] - 1] = counts[full] - 255 * (pieces[full] - 1)
    prints = np.zeros(len(counts), np.uint64)
    for k in range(8):
        sums = segment_sums((hashes >> np.uint64(k)) & LANES, lanes)
        bits = segment_sums(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), pieces)
        on = 2 * bits > counts[:, None]
        for byte in range(8):
            prints |= on[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return prints


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42, out: str = "fingerprint") -> DataFrame:
    """Add a LONG fingerprint of the whole text.

    Words are runs of non-white ASCII, A-Z lower-cased; a text shorter than the
    shingle width is one shingle; a null, empty or blank text has fingerprint 0.
    Repeated rows keep their own row each.
    """
    require(docs, text)
    bound_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != out]
    work = docs.select(*rest)
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t or b"", width, seed) for t in utf8(batch.column(at))]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            prints = majority_bits(np.concatenate([*hashes, np.zeros(0, np.uint64)]), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*rest, out])

    return work.mapInArrow(run, grown(work, f"`{out}` long"))


# --- anchors ------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _errors(bits: int, generator: int, radius: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error words by syndrome: start of each syndrome's part, words, and by how much each exceeds the radius."""
    degree = generator.bit_length() - 1
    unit = []
    for i in range(bits):
        r = 1 << i
        while r.bit_length() > degree:
            r ^= generator << (r.bit_length() - 1 - degree)
        unit.append(r)
    found = []
    for weight in range(radius + threshold + 1):
        for places in combinations(range(bits), weight):
            word = syndrome = 0
            for i in places:
                word |= 1 << i
                syndrome ^= unit[i]
            found.append((syndrome, max(0, weight - radius), word))
    table = np.array(sorted(found), np.int64)
    return np.searchsorted(table[:, 0], np.arange((1 << degree) + 1)), table[:, 2], table[:, 1]


@lru_cache(maxsize=None)
def _syndromes(bits: int, generator: int) -> np.ndarray:
    degree = generator.bit_length() - 1
    out = np.zeros(1 << bits, np.uint16)
    for i in range(bits):
        r = 1 << i
        while r.bit_length() > degree:
            r ^= generator << (r.bit_length() - 1 - degree)
        out[1 << i : 2 << i] = out[: 1 << i] ^ np.uint16(r)
    return out


def anchors_of(prints: np.ndarray, blocks: int = 2, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(index into prints, anchor) of every replica."""
    rows = np.arange(len(prints))
    anchor = np.zeros(len(prints), np.int64)
    excess = np.zeros(len(prints), np.int64)
    shift = 0
    for bits, generator, radius in CODES[:blocks]:
        degree = generator.bit_length() - 1
        part = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        starts, words, over = _errors(bits, generator, radius, threshold)
        syndrome = _syndromes(bits, generator)[part][rows].astype(np.int64)
        first, n = starts[syndrome], starts[syndrome + 1] - starts[syndrome]
        source = np.repeat(np.arange(len(rows)), n)
        pick = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + first[source]
        excess = excess[source] + over[pick]
        keep = excess <= threshold
        source, pick, excess = source[keep], pick[keep], excess[keep]
        # the high bits of a code word name it
        anchor = (anchor[source] << (bits - degree)) | ((part[rows[source]] ^ words[pick]) >> degree)
        rows = rows[source]
        shift += bits
    return rows, anchor


def _replicate(blocks: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(whole), 2000):
                prints = whole[at : at + 2000]
                rows, anchor = anchors_of(prints.view(np.uint64), blocks, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[rows])], names=["anchor", "fp"])

    return run


def spanning_links(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links, without the roots themselves."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def close_links(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the close pairs within runs of equal anchors."""
    left, right = [], []
    waiting = 0
    here = np.arange(len(fp))
    step = 1
    while True:
        here = here[here + step < len(fp)]
        here = here[anchor[here] == anchor[here + step]]
        if not len(here):
            break
        near = here[np.bitwise_count((fp[here] ^ fp[here + step]).view(np.uint64)) <= threshold]
        left.append(fp[near])
        right.append(fp[near + step])
        waiting += len(near)
        if waiting > 1_000_000:
            kept = spanning_links(np.concatenate(left), np.concatenate(right))
            left, right, waiting = [kept[0]], [kept[1]], 0
        step += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning_links(np.concatenate(left), np.concatenate(right))


def _compare(threshold: int, most: int):
    """Stream rows sorted by anchor; rows of the last anchor of a batch wait for the next batch."""

    def out(u, v, full):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(u), full))], names=["u", "v", "full"])

    def ready(anchor, fp):
        _, first, n = np.unique(anchor, return_index=True, return_counts=True)
        size = np.repeat(n, n)
        fit = size <= most
        if not fit.all():
            yield out(fp[~fit], fp[~fit], True)
        links = close_links(anchor[fit], fp[fit], threshold)
        if len(links[0]):
            yield out(*links, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = fp = np.zeros(0, np.int64)
        flowing = None  # a full anchor whose rows pass straight through
        for batch in batches:
            a, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if flowing is not None:
                n = int(np.searchsorted(a, flowing, "right"))
                yield out(f[:n], f[:n], True)
                a, f = a[n:], f[n:]
                if not len(a):
                    continue
                flowing = None
            anchor, fp = np.concatenate([anchor, a]), np.concatenate([fp, f])
            if not len(anchor):
                continue
            last = int(np.searchsorted(anchor, anchor[-1], "left"))
            yield from ready(anchor[:last], fp[:last])
            anchor, fp = anchor[last:], fp[last:]
            if len(anchor) > most:
                yield out(fp, fp, True)
                flowing, anchor, fp = int(anchor[0]), anchor[:0], fp[:0]
        if len(anchor):
            yield from ready(anchor, fp)

    return run


def _neighbourhood_links(prints: DataFrame) -> DataFrame:
    """Links among ``fp`` within two bits by shared one-bit neighbours; a group has at most 65 members."""
    words = F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)]))
    near = prints.select("fp", F.explode(words).alias("word"))
    groups = near.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return groups.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u != v")


def link_fingerprints(prints: DataFrame, blocks: int = 2, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(fp, root) of each distinct fingerprint that has a neighbour within two bits.

    ``prints`` has one LONG column ``fp`` without repeats or nulls. ``blocks=3``
    gives 2**35 anchors instead of 2**24 at two and a half times the replicas,
    for more than about a hundred million distinct fingerprints; the result is
    the same.
    """
    spark = prints.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    replicas = prints.repartition(parts, "fp").mapInArrow(_replicate(blocks, THRESHOLD), "anchor long, fp long")
    sorted_rows = replicas.repartition(parts, "anchor").sortWithinPartitions("anchor")
    found = stored(sorted_rows.mapInArrow(_compare(THRESHOLD, anchor_rows), "u long, v long, full boolean").distinct(), "pairs")
    dense = found.filter("full").select(F.col("u").alias("fp")).distinct()
    edges = found.filter("not full").select("u", "v").union(_neighbourhood_links(dense))
    return components(edges).select(F.col("node").alias("fp"), "root")


# --- documents ----------------------------------------------------------------------


def _rows(docs: DataFrame, id_col: str, text: str, width: int, seed: int) -> DataFrame:
    """Light stored rows: id, a hash of the text, fingerprint."""
    light = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return stored(with_fingerprint(light, "text", width, seed, "fp").select("id", "text_hash", "fp"), "prints")


def _roots(rows: DataFrame, blocks: int) -> DataFrame:
    """(fp, root) of all distinct fingerprints."""
    prints = stored(rows.select("fp").distinct(), "distinct")
    linked = link_fingerprints(prints, blocks)
    return prints.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, blocks: int = 2
) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the least id that can be
    reached over links of at most two differing bits, nulls ignored (null if a
    group has no other id). Repeated rows appear as often as they come; other
    columns are not looked at; an empty table gives an empty result.
    """
    require(docs, id_col, text)
    rows = _rows(docs, id_col, text, width, seed)
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = stored(_roots(rows, blocks).join(least, "fp"), "roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(roots.join(ids, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, blocks: int = 2
) -> DataFrame:
    """Keep one document of each group, that with the least id (null ids last).

    Of rows that repeat both id and text one is kept. Columns are unchanged.
    """
    require(docs, id_col, text)
    rows = _rows(docs, id_col, text, width, seed)
    pick = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    least = rows.groupBy("fp").agg(pick.alias("best"))
    best = _roots(rows, blocks).join(least, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = stored(best.select(F.col("best.id").alias("__id"), F.col("best.text_hash").alias("__hash")), "kept")
    keyed = docs.withColumn("__th", F.xxhash64(text))
    joined = keyed.join(kept, keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__th"] == kept["__hash"]), "left_semi")
    return joined.dropDuplicates([id_col, "__th"]).select(*docs.columns)
