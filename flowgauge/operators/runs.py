"""Run ids, evaluation plans, the ledger of finished steps, the model store and run times."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import fields, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowgauge.functions.hashing import short_hash

STAGES = ("in_progress", "evaluation_complete", "metrics_complete", "complete")
CLEARED = "cleared"


def config_hash(config: dict) -> str:
    """First 8 hex digits of the sha-256 of the canonical configuration."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]


def describe(value):
    """Plain data that tells two settings apart, the same in every process."""
    if is_dataclass(value) and not isinstance(value, type):
        return {"kind": type(value).__name__, **{f.name: describe(getattr(value, f.name)) for f in fields(value)}}
    if isinstance(value, dict):
        return {str(k): describe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [describe(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    if callable(value):
        return f"{getattr(value, '__module__', '')}.{getattr(value, '__qualname__', type(value).__name__)}"
    return {"kind": type(value).__name__, **{k: describe(v) for k, v in vars(value).items()}} if hasattr(value, "__dict__") else str(value)


def store_config(spark: SparkSession, path: str, config: dict) -> None:
    """The configuration as one JSON row beside the results it led to."""
    row = spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def config_hash_column(config_json: Column) -> Column:
    return short_hash(config_json)


def run_id(scope: Column, model: Column, train: Column, test: Column | None = None, fold: Column | None = None) -> Column:
    """scope_model_train-i[_fold k]_test-j."""
    fold_part = F.lit("") if fold is None else F.coalesce(F.concat(F.lit("_fold "), fold.cast("string")), F.lit(""))
    parts = [scope, F.lit("_"), model, F.lit("_train-"), train.cast("string"), fold_part]
    if test is not None:
        parts += [F.lit("_test-"), test.cast("string")]
    return F.concat(*parts)


def attack_run_id(base: Column, position: Column, attack: Column) -> Column:
    return F.concat(base, F.lit("|attack"), position.cast("string"), F.lit("_"), F.lower(F.replace(attack, F.lit(" "), F.lit("_"))))


def evaluation_plan(datasets: DataFrame, models: list[str], cross: bool, folds: int = 0, train_only: bool = False) -> DataFrame:
    """All (train, model, test) steps: the full matrix when cross, else the diagonal.

    ``datasets`` holds one ``dataset`` name per row. Folds are only valid for the diagonal.
    """
    if cross and folds:
        raise ValueError("cross-dataset evaluation takes no folds")
    names = datasets.agg(F.sort_array(F.collect_set("dataset")).alias("names"))
    rows = names.select("names", F.posexplode("names").alias("train_index", "train_dataset"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    if train_only:
        return rows.select(
            "train_dataset", "model", run_id(F.lit("cross" if cross else "intra"), F.col("model"), F.col("train_index")).alias("run_id")
        )
    if cross:
        rows = rows.select("*", F.posexplode("names").alias("test_index", "test_dataset"))
    else:
        rows = rows.withColumn("test_index", F.col("train_index")).withColumn("test_dataset", F.col("train_dataset"))
    fold = None
    if folds:
        rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        fold = F.col("fold")
    scope = F.lit("cross" if cross else "kfold" if folds else "intra")
    train_id = run_id(scope, F.col("model"), F.col("train_index"), fold=fold)
    full_id = run_id(scope, F.col("model"), F.col("train_index"), F.col("test_index"), fold)
    cols = ["train_dataset", "model", "test_dataset", *(["fold"] if folds else [])]
    return rows.select(*cols, train_id.alias("train_run_id"), full_id.alias("run_id"))


def pending_runs(plan: DataFrame, completed: DataFrame) -> DataFrame:
    return plan.join(completed.select("run_id"), "run_id", "left_anti").select(*plan.columns)


class Ledger:
    """Finished steps and the stage of each configuration, appended as Parquet."""

    SCHEMA = "config_hash string, run_id string, stage string, at double"

    def __init__(self, spark: SparkSession, path: str, config: str):
        self.spark, self.path, self.config = spark, path, config

    def _all(self) -> DataFrame:
        """Entries since the ledger was last cleared."""
        try:
            own = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("config_hash") == self.config)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)
        since = own.agg(F.max(F.when(F.col("stage") == CLEARED, F.col("at")))).collect()[0][0]
        return own if since is None else own.where(F.col("at") > F.lit(since))

    def clear(self) -> None:
        """Forget all finished steps of this configuration."""
        self._append((None, CLEARED))

    def completed(self) -> DataFrame:
        return self._all().where("run_id is not null").select("run_id").distinct()

    def add(self, *finished: str) -> None:
        self._append(*[(run, None) for run in finished])

    def stage(self) -> str | None:
        row = self._all().where("stage is not null").agg(F.max_by("stage", "at").alias("s")).collect()[0]
        return row["s"]

    def set_stage(self, stage: str) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        self._append((None, stage))

    def _append(self, *entries: tuple[str | None, str | None]) -> None:
        rows = [(self.config, run, stage, time.time()) for run, stage in entries]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


class ModelStore:
    """Fitted detectors keyed by configuration hash, model and dataset; a changed hash means retrain."""

    SCHEMA = "config_hash string, kind string"

    def __init__(self, spark: SparkSession, root: str, config: str):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config

    def path(self, model: str, dataset: str, fold: int | None = None) -> str:
        leaf = dataset if fold is None else f"{dataset}_fold{fold}"
        return f"{self.root}/{model}/{leaf}"

    def save(self, fitted, model: str, dataset: str, fold: int | None = None) -> None:
        path = self.path(model, dataset, fold)
        fitted.save(path)
        row = self.spark.createDataFrame([(self.config, type(fitted).__name__)], self.SCHEMA)
        row.coalesce(1).write.mode("overwrite").json(f"{path}/hash")

    def load(self, loaders: dict[str, Callable], model: str, dataset: str, fold: int | None = None, force: bool = False):
        """The stored detector, or None when absent or from another configuration (unless forced)."""
        path = self.path(model, dataset, fold)
        try:
            found = self.spark.read.schema(self.SCHEMA).json(f"{path}/hash").collect()
        except AnalysisException:
            return None
        if not found or not (force or found[0]["config_hash"] == self.config):
            return None
        return loaders[found[0]["kind"]](self.spark, path)

    def size_mb(self, model: str, dataset: str, fold: int | None = None) -> float:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(model, dataset, fold))
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(target).getLength() / (1024.0 * 1024.0) if fs.exists(target) else 0.0


@contextmanager
def timed(times: list[tuple[str, str, float]], run: str, phase: str):
    """Record the wall-clock seconds of the actions inside the block."""
    start = time.perf_counter()
    try:
        yield
    finally:
        times.append((run, phase, time.perf_counter() - start))
