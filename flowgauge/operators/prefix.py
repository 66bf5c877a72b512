"""Running sums in two levels, so that no window runs over a whole table.

Rows are put into range buckets of the order column, of about ``BUCKET_ROWS`` rows
each. Bucket edges come from exact counts of equal parts of the range, of which
those with too many rows are counted again in finer parts: they only balance the
work and never change a result. Running sums are taken inside a bucket and shifted
by bucket totals.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 500_000
#: Parts of the range counted at least, and rounds of finer counts at most.
CELLS = 1024
ROUNDS = 5


Part = tuple[float, float, int]  # least and greatest value of some neighbouring rows, and their number


def _counted(rows: DataFrame, place: Column, low: Column, high: Column, cells: int, *by: Column) -> list:
    """Rows per equal cell between two places, with the values they span."""
    at = F.least(F.greatest(F.floor((place - low) / (high - low) * cells), F.lit(0)), F.lit(cells - 1))
    counts = rows.groupBy(*by, at.alias("cell")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    return sorted(counts.collect())


def _magnitude(v: Column) -> Column:
    """Grows with the value, evenly over powers of two of either sign."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def _finer(rows: DataFrame, parts: list[Part], cells: int) -> dict[Part, list[Part]]:
    """The same for each of some disjoint parts, even over the values that it spans."""
    lows, highs = (F.array(*[F.lit(p[k]) for p in parts]) for k in (0, 1))
    part = F.size(F.filter(lows, lambda x: x <= F.col("v"))) - 1
    placed = rows.withColumn("part", part).where((F.col("part") >= 0) & (F.col("v") <= F.get(highs, F.col("part"))))
    # halves, as a part may be wider than the greatest double
    low, high = F.get(lows, F.col("part")) / 2, F.get(highs, F.col("part")) / 2
    out: dict[Part, list[Part]] = {p: [] for p in parts}
    for r in _counted(placed, F.col("v") / 2, low, high, cells, F.col("part")):
        out[parts[r["part"]]].append((r["low"], r["high"], r["n"]))
    return out


def range_edges(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Strictly increasing inner edges, at most ``buckets - 1`` of them; by default as many buckets as the rows need.

    Counts of cells by magnitude come first, then of finer cells within those that
    hold more rows than a bucket. The driver holds a few counts per bucket.
    """
    if buckets is not None and buckets <= 1:
        return []
    value = F.col(column).cast("double")
    rows = df.select(value.alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    place = _magnitude(F.col("v"))
    row = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.min(place).alias("a"), F.max(place).alias("b"), F.count("v").alias("n")).first()
    buckets = -(-row["n"] // BUCKET_ROWS) if buckets is None else buckets
    if buckets <= 1 or not row["low"] < row["high"]:
        return []
    most = row["n"] / buckets
    found: list[Part] = [(row["low"], row["high"], row["n"])]
    if row["a"] < row["b"]:
        found = [(r["low"], r["high"], r["n"]) for r in _counted(rows, place, F.lit(row["a"]), F.lit(row["b"]), max(CELLS, 4 * buckets))]
    for _ in range(ROUNDS):
        heavy = [p for p in found if p[2] > most and p[0] < p[1]]
        if not heavy:
            break
        inner = _finer(rows, heavy, max(16, min(CELLS, 64 * CELLS // len(heavy))))
        found = [q for p in found for q in inner.get(p, [p])]
    edges, held = [], 0
    for low, _, n in found:
        # an edge below what would fill the bucket over
        if held and held + n > most:
            edges.append(low)
            held = 0
        held += n
    return edges[: buckets - 1]


def with_range_bucket(
    df: DataFrame, column: str, buckets: int | None = None, edges: list[float] | None = None, name: str = "bucket"
) -> DataFrame:
    """Add an INT bucket that never decreases with ``column`` (binary search in the JVM)."""
    if edges is None:
        edges = range_edges(df, column, buckets)
    if not edges:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    numeric = df.withColumn("__bv", F.col(column).cast("double"))
    out = Bucketizer(splits=splits, inputCol="__bv", outputCol="__b", handleInvalid="keep").transform(numeric)
    # never NULL, so joins on the bucket add no filter and both sides can share one shuffle
    return out.withColumn(name, F.coalesce(F.col("__b").cast("int"), F.lit(len(edges) + 1))).drop("__bv", "__b")


def bucket_offsets(df: DataFrame, groups: list[str], sums: list[str], descending: bool = False) -> DataFrame:
    """Totals of all earlier buckets, per (groups, bucket); one small row per bucket."""
    totals = df.groupBy(*groups, "bucket").agg(*[F.sum(s).alias(f"__tot_{s}") for s in sums])
    order = F.col("bucket").desc() if descending else F.col("bucket").asc()
    upto = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*groups)
    return totals.select(
        *groups,
        "bucket",
        *[(F.sum(f"__tot_{s}").over(upto) - F.col(f"__tot_{s}")).alias(f"off_{s}") for s in sums],
        *[F.sum(f"__tot_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )


def running_sums(
    df: DataFrame,
    groups: list[str],
    order: str,
    sums: list[str],
    descending: bool = False,
    edges: list[float] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive) and ``total_<s>``; (groups, order) must be unique."""
    edges = range_edges(df, order, buckets) if edges is None else edges
    if not edges:
        # one bucket: its own sums are the running sums
        along = Window.partitionBy(*groups).orderBy(F.col(order).desc() if descending else F.col(order).asc())
        upto, whole = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*groups)
        return df.select("*", *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums], *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums])
    bucketed = with_range_bucket(df, order, buckets, edges)
    offsets = bucket_offsets(bucketed, groups, sums, descending)
    col = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy(*groups, "bucket").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.select("*", *[F.sum(s).over(w).alias(f"__loc_{s}") for s in sums])
    joined = local.join(offsets, [*groups, "bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"__loc_{s}") + F.col(f"off_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
    )
