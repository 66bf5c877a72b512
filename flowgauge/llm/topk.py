"""Exact top-k by inner product with the threshold algorithm over sorted lists.

Vectors are cut into blocks of about ``BLOCK_ROWS``. A block keeps, for every
dimension, the list of its rows sorted by that component. A query walks all lists
of a block from their better ends, scores the rows it meets, and stops as soon as
the best score that an unseen row could have (the sum over dimensions of query
component times the value reached) is below its kth result. Queries whose lists
must be read as far as the block has rows score the rows of the block together.

Blocks are dealt into slabs. A task holds the blocks of one slab, then reads all
queries block by block; it carries the results of a query from block to block of
the slab, so later blocks stop sooner, and hands them out before the next queries.
Every query meets every block once. Blocks and queries are only shuffled: copies
of the queries for each slab are many times the table of queries that Spark knows
the size of, so they must never be broadcast by that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import bound_batches, require, stored

BLOCK_ROWS = 4096
QUERY_ROWS = 256
STEP = 16
#: A table with fewer blocks than this has a block in each slab; others have at least so many slabs.
SLABS = 24
#: Bytes of the blocks of a slab, at the widest numbers.
SLAB_BYTES = 128 << 20


def whole_vectors(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of usable vectors, in tasks as packed LONGs; repeated rows count once."""
    usable = (
        F.col(vector).isNotNull()
        & F.col(id_col).isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    )
    v = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct()


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them all."""
    for kind in (np.int16, np.int32):
        if not x.size or np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _wide(data: bytes, n: int, width: int) -> np.ndarray:
    """What ``_narrow`` made, from its bytes."""
    return np.frombuffer(data, f"i{len(data) // (n * width) if width else 8}").reshape(n, width)


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row per vector; shorter vectors are filled with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy()
    x = np.zeros((len(vectors), width), np.int64)
    x[np.arange(width) < lengths[:, None]] = pc.list_flatten(vectors).to_numpy()
    return x


def _pack(ids: np.ndarray, x: np.ndarray, lists: bool) -> dict:
    """A block as bytes: rows in order of their ids."""
    order = np.argsort(ids, kind="stable")
    x, ids = _narrow(x[order]), ids[order]
    out = {"ids": ids.tobytes(), "x": x.tobytes(), "n": len(ids), "lists": None}
    if lists:
        kind = np.uint16 if len(ids) <= 1 << 16 else np.uint32
        out["lists"] = np.argsort(np.ascontiguousarray(x.T), axis=1, kind="stable").astype(kind).tobytes()
    return out


def _blocks(rows: DataFrame, n_blocks: int, salt: str, width: int, lists: bool) -> DataFrame:
    names = ["block", "ids", "x", "n", "lists"]

    def pack(group: pa.Table) -> pa.Table:
        part = group.combine_chunks()
        packed = _pack(part["id"].to_numpy(), _matrix(part["v"], width), lists)
        columns = {"block": pa.array([part["block"][0].as_py()], pa.int64()), "n": pa.array([packed["n"]], pa.int64())}
        return pa.table({k: columns[k] if k in columns else pa.array([packed[k]], pa.binary()) for k in names})

    schema = "block long, ids binary, x binary, n long, lists binary"
    keyed = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(n_blocks)))
    return keyed.groupBy("block").applyInArrow(pack, schema)


class Query:
    """The best rows of one query so far."""

    def __init__(self, own: int, vector: np.ndarray, k: int):
        self.own, self.vector, self.k = own, vector, k
        self.dims = np.flatnonzero(vector)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.int64)

    def bound(self):
        """The score that an unseen row must reach, or None while there is room."""
        return self.scores[self.k - 1] if len(self.scores) == self.k else None

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = ids != self.own
        if (least := self.bound()) is not None:
            keep &= scores >= least
        # DOUBLEs here are exact whole numbers; Python integers stay, as some may be beyond a LONG until better ones come
        scores = scores[keep] if scores.dtype == object else scores[keep].astype(np.int64)
        ids, scores = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]

    def walk(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, step: int = STEP, most: int | None = None) -> int:
        """Look through a block, no deeper than ``most`` rows of a list; returns the number of rows scored."""
        n = len(ids)
        if not len(self.dims):
            self.offer(ids[: self.k + 1], np.zeros(min(n, self.k + 1), np.int64))
            return min(n, self.k + 1)
        vector = self.vector.astype(x.dtype)
        q = vector[self.dims]
        falling = q > 0
        unseen = np.ones(n, bool)
        depth, scored = 0, 0
        while depth < min(n, most or n):
            upto = min(depth + step, n)
            ahead = np.zeros(n, bool)
            ahead[lists[self.dims[falling], n - upto : n - depth]] = True
            ahead[lists[self.dims[~falling], depth:upto]] = True
            fresh = np.flatnonzero(ahead & unseen)
            if len(fresh):
                unseen[fresh] = False
                scored += len(fresh)
                self.offer(ids[fresh], x[fresh] @ vector)
            reached = np.where(falling, lists[self.dims, n - upto], lists[self.dims, upto - 1])
            least = self.bound()
            # a row that is not seen yet has at most this; an equal score may still win by its id
            if scored == n or least is not None and (q * x[reached, self.dims]).sum() < least:
                break
            depth, step = upto, 2 * step
        return scored


def _number_kind(x: np.ndarray, q: np.ndarray) -> type:
    """DOUBLE where every sum of products is exact, else Python integers."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, x.shape[1])
    return np.float64 if most < 2**53 else object


def _far(queries: list[Query], q: np.ndarray, x: np.ndarray, lists: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which queries have a bound no less than their kth score where their lists have as many entries as the block rows."""
    n = len(x)
    dims = np.array([len(query.dims) for query in queries])
    far = np.zeros(len(queries), bool)
    for k in np.unique(dims[dims > 0]):
        # walks read on only where the bound at this depth allows for better rows
        depth = min(n, -(-n // k))
        every = np.arange(x.shape[1])
        high, low = x[lists[:, n - depth], every], x[lists[:, depth - 1], every]
        some = dims == k
        far[some] = np.maximum(q[some], 0) @ high + np.minimum(q[some], 0) @ low >= least[some]
    return far


def _look_through(queries: list[Query], q: np.ndarray, ids: np.ndarray, x: np.ndarray, lists: np.ndarray) -> None:
    """All queries of a block through a block of vectors, both in DOUBLEs."""
    least = np.full(len(queries), -np.inf)
    for i, query in enumerate(queries):
        known = query
        if query.bound() is None and len(query.dims):
            # the first rows of the lists, some 16 k, bound the kth score from below
            known, few = Query(query.own, query.vector, query.k), min(STEP, -(-16 * query.k // len(query.dims)))
            known.walk(ids, x, lists, few, few)
        if known.bound() is not None:
            least[i] = known.bound()
    far = _far(queries, q, x, lists, least)
    for i in np.flatnonzero(~far):
        queries[i].walk(ids, x, lists)
    at = np.flatnonzero(far)
    if len(at):
        scores = q[at] @ x.T
        which, rows = np.nonzero(scores >= least[at, None])
        edges = np.searchsorted(which, np.arange(len(at) + 1))
        for j, i in enumerate(at):
            if edges[j] < edges[j + 1]:
                found = rows[edges[j] : edges[j + 1]]
                queries[i].offer(ids[found], scores[j, found])


def _search(k: int, width: int):
    """Rows come sorted by slab, the vectors of a slab before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                n, ids, x = row["n"], np.frombuffer(row["ids"], np.int64), _wide(row["x"], row["n"], width)
                if row["slab"] != slab:
                    slab, blocks = row["slab"], []
                if not row["asked"]:
                    lists = np.frombuffer(row["lists"], np.uint16 if n <= 1 << 16 else np.uint32).reshape(width, n)
                    blocks.append((ids, x, lists))
                    continue
                queries = [Query(int(i), v, k) for i, v in zip(ids, x.astype(np.int64))]
                for own, values, lists in blocks:
                    kind = _number_kind(values, x)
                    values = values.astype(kind)
                    if kind is object:
                        for query in queries:
                            query.walk(own, values, lists)
                    else:
                        _look_through(queries, x.astype(kind), own, values, lists)
                found = [(np.full(len(q.ids), q.own), q.ids, q.scores) for q in queries]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    return run


def slabs(n_blocks: int, block_rows: int, width: int, tasks: int) -> int:
    """How many slabs a table has: enough for the tasks, and none beyond ``SLAB_BYTES``."""
    held = max(1, SLAB_BYTES // (block_rows * max(1, width) * 10))
    return min(n_blocks, max(SLABS, tasks, -(-n_blocks // held)))


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query, ties to the smaller id.

    ``queries`` tells, by the column ``id``, which rows are queries. Components become floor(scale * x) and
    scores are exact integers (they must fit a LONG). Rows with a null id, a null
    vector or a null or non-finite component take no part; shorter vectors count as
    filled with zeros; rows that repeat id and vector count once, other rows of the
    query's own id never. An empty table gives none.
    """
    require(vectors, id_col, vector)
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stored(whole_vectors(vectors, id_col, vector, scale), "vectors")
    asked = rows.filter(F.coalesce(queries, F.lit(False)))
    n, width, n_asked = rows.agg(F.count("id"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(F.coalesce(queries, F.lit(False)))).first()
    n_blocks, q_blocks = -(-n // block_rows) or 1, -(-n_asked // QUERY_ROWS) or 1
    n_slabs = slabs(n_blocks, block_rows, width, 3 * spark.sparkContext.defaultParallelism)
    left = _blocks(rows, n_blocks, "rows", width, True).withColumns({"slab": F.col("block") % n_slabs, "asked": F.lit(False)})
    right = _blocks(asked, q_blocks, "queries", width, False).withColumns({"slab": F.explode(F.sequence(F.lit(0), F.lit(n_slabs - 1)).cast("array<long>")), "asked": F.lit(True)})
    dealt = left.unionByName(right).repartitionById(n_slabs, F.col("slab").cast("int")).sortWithinPartitions("slab", "asked", "block")
    found = dealt.mapInArrow(_search(k, width), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
