"""Sharding along a Hilbert curve over several metadata columns.

Each column is quantised to 2**bits levels at exact quantiles of all rows, or at
all its values if they are few. Rows are sorted by their index on the curve, ties
by a hash of the id, and the order is cut into runs of equal length, so that a
shard covers a compact region and the least and greatest values of its files
prune in every dimension.

The order comes from a range shuffle: keys hold the id, so that a hot cell is
split like any other, and each partition numbers its own rows. Only one count per
partition reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import append, bound_batches, grown, require, stored

BITS = 8


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of points with whole coordinates below 2**bits (rows: dimensions)."""
    x = levels.astype(np.uint64).copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("dimensions times bits must stay below 64")
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(dims):
            on = (x[i] >> np.uint64(b)) & np.uint64(1) == 1
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        on = (x[dims - 1] >> np.uint64(b)) & np.uint64(1) == 1
        turn = np.where(on, turn ^ np.uint64((1 << b) - 1), turn)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return place.astype(np.int64)


def _plain(df: DataFrame, name: str):
    kind = dict(df.dtypes)[name]
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "boolean") or kind.startswith("decimal")
    if kind in ("date", "timestamp"):
        return F.unix_timestamp(F.col(name)).cast("double")
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) if numeric else F.col(name).cast("string")


def level_cuts(docs: DataFrame, dims: list[str], bits: int) -> list[list]:
    """At most 2**bits - 2 increasing cut values per column: all its values, or those at even ranks of all rows.

    Rows are counted by value before a shuffle by value ranges; each part runs up
    its counts, so only sums of parts and the cuts reach the driver.
    """
    spark = docs.sparkSession
    most = (1 << bits) - 2
    sides = []
    for i, d in enumerate(dims):
        value = _plain(docs, d)
        text = dict(docs.select(value.alias("v")).dtypes)["v"] == "string"
        none = F.lit(None)
        sides.append(
            F.struct(
                F.lit(i).alias("dim"),
                (none.cast("double") if text else value).alias("number"),
                (value if text else none.cast("string")).alias("text"),
            )
        )
    each = docs.select(F.inline(F.array(*sides))).filter("number is not null or text is not null")
    keys = ["dim", "number", "text"]
    values = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = values.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def run_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for batch in batches:
            dim, n = batch.column("dim").to_numpy(), batch.column("n").to_numpy()
            upto = np.zeros(len(n), np.int64)
            for d in np.unique(dim).tolist():
                here = dim == d
                upto[here] = totals.get(d, 0) + np.cumsum(n[here])
                totals[d] = int(upto[here][-1])
            yield append(batch, upto=pa.array(upto))

    counted = stored(ordered.mapInArrow(run_up, grown(ordered, "upto long")).withColumn("part", F.spark_partition_id()), "values")
    sums = sorted(tuple(r) for r in counted.groupBy("dim", "part").agg(F.sum("n"), F.count(F.lit(1))).collect())
    if not sums:
        return [[] for _ in dims]
    total, kinds, shift = [0] * len(dims), [0] * len(dims), []
    for dim, part, n, k in sums:
        shift.append({"dim": dim, "part": part, "before": total[dim]})
        total[dim] += n
        kinds[dim] += k
    shift = [x | {"total": total[x["dim"]], "few": kinds[x["dim"]] <= most} for x in shift]
    # one row per column and partition of the shuffle above
    joined = counted.join(F.broadcast(spark.createDataFrame(pa.Table.from_pylist(shift))), ["dim", "part"])
    # a value is a cut if one of the ranks k * total div most, k below most, lies among its rows
    first, last = (F.expr(f"(({at}) * {most}L + total - 1) div total") for at in ("before + upto - n", "before + upto"))
    cuts: list[list] = [[] for _ in dims]
    for r in joined.filter(F.col("few") | (first < last)).select(*keys).collect():
        cuts[r["dim"]].append(r["text"] if r["number"] is None else r["number"])
    return [sorted(c) for c in cuts]


def hilbert_shards(
    docs: DataFrame,
    dims: list[str],
    shards: int,
    id_col: str = "doc_id",
    bits: int = BITS,
) -> DataFrame:
    """Add ``curve``, ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Shard sizes in rows differ by one at most. Null and NaN values share the
    lowest level of their column; null ids sort first; repeated rows get slots of
    their own in any order; an empty table stays empty. Columns named like the new
    ones are replaced. Give only the columns that must travel: the rows are
    shuffled and stored once.
    """
    require(docs, id_col, *dims)
    spark = docs.sparkSession
    bound_batches(spark)
    kept = docs.select(*[c for c in docs.columns if c not in ("curve", "shard", "slot")])
    cuts = level_cuts(kept, dims, bits)
    work = kept.select("*", *[_plain(kept, d).alias(f"__d{i}") for i, d in enumerate(dims)])
    n, top = len(kept.columns), (1 << bits) - 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = np.zeros((len(dims), batch.num_rows), np.int64)
            for i, cut in enumerate(cuts):
                for j, v in enumerate(batch.column(n + i).to_pylist()):
                    if v is not None:
                        # few values are spread over all levels, so that every column counts alike
                        levels[i, j] = 1 + bisect_right(cut, v) * top // max(1, len(cut))
            yield append(batch.select(batch.schema.names[:n]), curve=pa.array(hilbert_index(levels, bits)))

    placed = work.mapInArrow(place, grown(kept, "curve long")).withColumn("__tie", F.xxhash64(id_col))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["curve", "__tie", id_col]
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    ordered = stored(ordered.drop("__tie"), "curve")
    part = F.shiftright("__m", 33)
    counts = sorted(ordered.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for p, c in counts:
        offsets.append((p, total))
        total += c
    if not total:
        return ordered.drop("__m").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    # one row per partition of the shuffle above
    shift = F.broadcast(spark.createDataFrame(pa.table({"__p": [p for p, _ in offsets], "__o": [o for _, o in offsets]})))
    joined = ordered.withColumn("__p", part).join(shift, "__p")
    rank = F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    # shard s begins at rank ceil(s * total / shards)
    begins = F.array(*[F.lit(-(-s * total // shards)) for s in range(shards)])
    placed = joined.withColumn("__r", rank)
    shard = F.expr(f"int(__r * {shards}L div {total}L)")
    placed = placed.withColumn("shard", shard)
    return placed.withColumn("slot", F.col("__r") - F.get(begins, F.col("shard"))).drop("__p", "__o", "__m", "__r")


def write_shards(sharded: DataFrame, path: str, shards: int, files_per_shard: int = 1) -> None:
    """Parquet files by shard, each a run of slots in curve order with tight value ranges."""
    by = sharded.repartitionByRange(shards * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot")
    by.write.partitionBy("shard").parquet(path)
