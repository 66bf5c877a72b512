"""Dataset and split statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.functions.scalars import is_floating, is_numeric, quote


def class_distribution(df: DataFrame, target: str, within: list[str] | None = None) -> DataFrame:
    """Rows and percent (5 decimals) per class."""
    keys = within or []
    counts = df.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, target, "n", F.round(F.col("n") / total * 100, 5).alias("percent"))


def split_distribution(df: DataFrame, target: str, within: list[str]) -> DataFrame:
    """Percent per class with one decimal, as shown in a report."""
    counts = df.groupBy(*within, target).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*within)) * 100
    return counts.select(*within, target, F.format_string("%.1f%%", share).alias("share"))


def dataset_summary(df: DataFrame, skip: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Rows, columns, numeric and text columns, missing cells."""
    fields = [f for f in df.schema.fields if f.name not in skip]

    def missing(f: T.StructField):
        c = F.col(quote(f.name))
        lost = c.isNull() | F.isnan(c) if is_floating(f.dataType) else c.isNull()
        return F.count_if(lost)

    numeric = sum(is_numeric(f.dataType) for f in fields)
    text = sum(isinstance(f.dataType, T.StringType) for f in fields)
    lost = [missing(f) for f in fields]
    total = lost[0]
    for m in lost[1:]:
        total = total + m
    return df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.lit(len(fields)).alias("features"),
        F.lit(numeric).alias("numeric_features"),
        F.lit(text).alias("categorical_features"),
        total.alias("total_missing"),
    )


def split_metadata(df: DataFrame, target: str, benign, keys: list[str]) -> DataFrame:
    """Rows, benign and attack totals per split."""
    is_benign = F.coalesce(F.col(target) == F.lit(benign), F.lit(False))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_benign).alias("n_benign"),
        F.count_if(~is_benign).alias("n_attack"),
    )


def kfold_stats(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Train and test rows per fold with integer averages."""
    sizes = df.groupBy(fold).agg(F.count(F.lit(1)).alias("test_samples"))
    # one row per fold
    whole = Window.partitionBy(F.lit(0))
    train = F.sum("test_samples").over(whole) - F.col("test_samples")
    with_train = sizes.withColumn("train_samples", train)
    return with_train.select(
        fold,
        "train_samples",
        "test_samples",
        F.floor(F.avg("train_samples").over(whole)).alias("avg_train_samples"),
        F.floor(F.avg("test_samples").over(whole)).alias("avg_test_samples"),
    )
