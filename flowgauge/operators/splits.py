"""Exact, repeatable train/test splits.

Each split asks for the sort key at a few ranks (``select_ranks``) and then
labels rows by comparing keys: two or three narrow column-pruned passes, no
shuffle or sort of the table, and the same rows for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.functions.hashing import hash_order
from flowgauge.functions.scalars import finite_or_null, is_numeric, quote
from flowgauge.operators.ranking import BINS, SORT_ROWS, beyond, group_ranges, select_ranks
from flowgauge.operators.small import attach


Pinned = tuple[DataFrame, bool]


def _cut_lists(
    df: DataFrame, groups: list[str], key: Column, tie: Column, ranges: Pinned, targets: DataFrame, **limits: int
) -> Pinned:
    """Per group the ordered list of cuts; a rank of 0 gives a cut before every row."""
    targets = targets.withColumn("rank", F.col("rank").cast("bigint"))
    cuts, small = select_ranks(df, groups, key, tie, ranges, targets, **limits)
    item = F.struct("target", "cut_key", "cut_tie")
    return cuts.groupBy(*groups).agg(F.sort_array(F.collect_list(item)).alias("__cuts")), small


def stratified_quotas(counts: DataFrame, strata: list[str], target: str, test_size: float) -> DataFrame:
    """Test rows per class by largest remainder, from (strata..., target, n); ties go to the smaller class."""
    whole = Window.partitionBy(*strata)
    n_all = F.sum("n").over(whole)
    n_test = F.ceil(F.lit(test_size) * n_all.cast("double"))
    # n * n_test passes 2^63 on large tables
    product = F.col("n").cast("decimal(19,0)") * n_test.cast("decimal(18,0)")
    share = counts.withColumn("__num", product).withColumn("__all", n_all).withColumn("__test", n_test)
    base = share.withColumn("__floor", F.expr("__num div __all")).withColumn("__rest", F.col("__num") % F.col("__all"))
    left = F.col("__test") - F.sum("__floor").over(whole)
    order = Window.partitionBy(*strata).orderBy(F.col("__rest").desc(), F.col(target))
    quota = F.col("__floor") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    return base.select(*strata, target, "n", quota.cast("bigint").alias("quota"))


def split_stratified(
    df: DataFrame,
    target: str,
    test_size: float,
    seed: int,
    row_id: str = "row_id",
    within: list[str] | None = None,
    sort_rows: int = SORT_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """Add ``split``: a seeded random test share of each class, exact in size.

    ``within`` splits several datasets of one table at once.
    """
    strata = within or []
    key, tie = hash_order(seed, F.col(row_id)), F.col(row_id)
    groups = [*strata, target]
    ranges = group_ranges(df, groups, key, tie)
    lonely = ranges[0].where(F.col("__n") < 2).limit(1).collect()
    if lonely:
        raise ValueError(f"class {lonely[0][target]!r} has fewer than 2 rows")
    quotas = stratified_quotas(ranges[0].withColumnRenamed("__n", "n"), strata, target, test_size)
    targets = quotas.select(*groups, F.lit(0).alias("target"), F.col("quota").alias("rank"))
    out = attach(df, _cut_lists(df, groups, key, tie, ranges, targets, sort_rows=sort_rows, bins=bins), groups)
    is_train = beyond(key, tie, F.col("__cuts")[0])
    return out.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("__cuts")


def split_kfold(
    df: DataFrame, target: str, n_splits: int, row_id: str = "row_id", sort_rows: int = SORT_ROWS, bins: int = BINS
) -> DataFrame:
    """Add ``fold``: contiguous blocks per class in row order, balanced over folds.

    The fold is the one that tests the row; it trains in all others.
    """
    if n_splits < 2:
        raise ValueError("k-fold needs at least 2 splits")
    key, tie = F.col(row_id), F.lit(0)
    ranges = group_ranges(df, [target], key, tie)
    classes = ranges[0].select(target, F.col("__n").alias("n"), F.col("__klo").alias("first"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    # one row per class: a single-partition window over class counts only
    placed = classes.withColumn("s", F.coalesce(F.sum("n").over(before), F.lit(0)))
    k = F.lit(float(n_splits))
    upto = F.floor((F.col("s") + F.col("n") - 1 - F.col("i")) / k) - F.floor((F.col("s") - 1 - F.col("i")) / k)
    sizes = placed.select(target, "s", "n", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 2))).alias("i"))
    run = Window.partitionBy(target).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    targets = sizes.select(target, F.col("i").alias("target"), F.sum(upto).over(run).alias("rank"))
    out = attach(df, _cut_lists(df, [target], key, tie, ranges, targets, sort_rows=sort_rows, bins=bins), [target])
    passed = F.size(F.filter("__cuts", lambda c: beyond(key, tie, c)))
    return out.withColumn("fold", passed.cast("int")).drop("__cuts")


def time_key(df: DataFrame, column: str) -> Column:
    """Sortable time of a row: microseconds for timestamps, else a finite number; NULL if neither.

    Text is read as a number first and as a timestamp second.
    """
    kind, c = df.schema[column].dataType, F.col(quote(column))
    if is_numeric(kind):
        return finite_or_null(c.cast("double"))
    if isinstance(kind, T.StringType):
        return F.coalesce(finite_or_null(c.try_cast("double")), F.unix_micros(c.try_cast("timestamp")).cast("double"))
    return F.unix_micros(c.cast("timestamp"))


def split_timestamp(
    df: DataFrame, column: str, test_size: float, row_id: str = "row_id", sort_rows: int = SORT_ROWS, bins: int = BINS
) -> DataFrame:
    """Add ``split``: the earliest rows train, the latest test; rows without a time are dropped."""
    timed = df.withColumn("__time", time_key(df, column)).where("__time is not null")
    keyed = timed.withColumn("__all", F.lit(0))
    groups, key, tie = ["__all"], F.col("__time"), F.col(row_id)
    ranges = group_ranges(keyed, groups, key, tie)
    n = sum(r["__n"] for r in ranges[0].collect())
    quota = int((1 - test_size) * n)
    targets = ranges[0].select("__all", F.lit(0).alias("target"), F.lit(quota).cast("bigint").alias("rank"))
    cut = select_ranks(keyed, groups, key, tie, ranges, targets, sort_rows, bins)[0].collect()
    if not cut or cut[0]["cut_key"] is None:
        return timed.withColumn("split", F.lit("test")).drop("__time")
    at, tie = F.lit(cut[0]["cut_key"]), F.lit(cut[0]["cut_tie"])
    late = (F.col("__time") > at) | ((F.col("__time") == at) & (F.col(row_id) > tie))
    return timed.withColumn("split", F.when(late, "test").otherwise("train")).drop("__time")


def split_benign_train(
    df: DataFrame,
    target: str,
    benign,
    test_size: float,
    seed: int,
    row_id: str = "row_id",
    within: list[str] | None = None,
    sort_rows: int = SORT_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """Add ``split``: train on part of the benign rows; the rest and all attacks test."""
    strata = within or []
    is_benign = F.coalesce(F.col(target) == F.lit(benign), F.lit(False))
    marked = df.withColumn("__benign", is_benign)
    key, tie = hash_order(seed, F.col(row_id)), F.col(row_id)
    groups = [*strata, "__benign"]
    ranges = group_ranges(marked, groups, key, tie)
    none = ranges[0].groupBy(*strata).agg(F.bool_or("__benign").alias("any")).where("not any")
    if ranges[0].isEmpty() or not none.isEmpty():
        raise ValueError(f"a dataset has no rows with benign label {benign!r}")
    quota = F.when(F.col("__n") > 1, F.ceil(F.lit(test_size) * F.col("__n").cast("double"))).otherwise(0)
    targets = ranges[0].where("__benign").select(*groups, F.lit(0).alias("target"), quota.alias("rank"))
    lists = _cut_lists(marked.where("__benign"), groups, key, tie, ranges, targets, sort_rows=sort_rows, bins=bins)
    out = attach(marked, lists, groups)
    is_train = F.col("__benign") & beyond(key, tie, F.col("__cuts")[0])
    return out.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("__cuts", "__benign")


def split_cross_dataset(df: DataFrame, target: str, test_size: float, seed: int, **kw) -> DataFrame:
    """Stratified split of every dataset of an aligned table (see ``align_tables``)."""
    _need_two(df)
    return split_stratified(df, target, test_size, seed, within=["dataset"], **kw)


def split_cross_dataset_benign(df: DataFrame, target: str, benign, test_size: float, seed: int, **kw) -> DataFrame:
    _need_two(df)
    return split_benign_train(df, target, benign, test_size, seed, within=["dataset"], **kw)


def _need_two(df: DataFrame) -> None:
    if len(df.select("dataset").distinct().limit(2).collect()) < 2:
        raise ValueError("a cross-dataset split needs at least two datasets")
