"""Split tables and reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_path(root: str, config_hash: str) -> str:
    return f"{root.rstrip('/')}/{config_hash}"


def write_splits(df: DataFrame, root: str, config_hash: str) -> str:
    """Write a split table partitioned by dataset and split (or fold); returns the path.

    Rows go straight from the tasks that computed them to their partition files,
    so there is no shuffle and no hot partition.
    """
    path = split_path(root, config_hash)
    part = [c for c in ("dataset", "split", "fold") if c in df.columns]
    df.write.mode("overwrite").partitionBy(*part).parquet(path)
    return path


def read_splits(spark: SparkSession, root: str, config_hash: str) -> DataFrame:
    """Read it back; filters on dataset, split and fold prune partitions. Fails when it was never written."""
    return spark.read.parquet(split_path(root, config_hash))


def train_rows(df: DataFrame, fold: int | None = None) -> DataFrame:
    return df.where(F.col("split") == "train") if fold is None else df.where(F.col("fold") != fold)


def test_rows(df: DataFrame, fold: int | None = None) -> DataFrame:
    return df.where(F.col("split") == "test") if fold is None else df.where(F.col("fold") == fold)


def write_report(df: DataFrame, path: str) -> None:
    """Report tables are small; one JSON file each."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report_path(root: str, config_hash: str, name: str) -> str:
    return f"{root.rstrip('/')}/reports/{config_hash}/{name}"


def read_report(spark: SparkSession, root: str, config_hash: str, name: str) -> DataFrame:
    """A written report; fails when it was never written."""
    return spark.read.json(report_path(root, config_hash, name))
