"""Load -> preprocess -> select -> split -> store, as one lazy table per dataset."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators import profile, select, splits
from flowgauge.operators.clean import align_tables
from flowgauge.operators.fitted import ROW_STEPS, FittedChain, Step, fit_next
from flowgauge.session import apart
from flowgauge.sources.readers import SubFile, land, load_dataset
from flowgauge.sources.sinks import read_splits, report_path, write_report, write_splits


@dataclass
class Prepared:
    """A preprocessed table, its fitted steps and a log of what each step did.

    Rows left by a step that removes some are observed by the job that writes the
    table. ``unwritten`` is the table with its observations if nothing wrote it.
    """

    table: DataFrame
    chain: FittedChain
    log: list[tuple[int, str, dict[str, str], Observation | None]] = field(default_factory=list)
    unwritten: DataFrame | None = None

    def step_table(self, run_id: str) -> DataFrame:
        """(run_id, ord, action, detail); no job, or one pass for all steps of a table that was never written."""
        if self.unwritten is not None and any(seen for *_, seen in self.log):
            self.unwritten.write.format("noop").mode("overwrite").save()
        self.unwritten = None
        rows = []
        for ord_, action, detail, seen in self.log:
            extra = {"rows_after": str(seen.get["rows"])} if seen is not None else {}
            rows.append((run_id, ord_, action, {**detail, **extra}))
        spark = self.table.sparkSession
        return spark.createDataFrame(rows, "run_id string, ord int, action string, detail map<string,string>")


def preprocess(df: DataFrame, steps: list[Step], row_id: str = "row_id", path: str | None = None) -> Prepared:
    """Fit and apply steps in order.

    Given a path, the table is written there after each step that removes copies
    and once at the end, so that later fits and the split read it instead of
    computing all that came before again. Fits read the plain table; only what is
    written is observed, so a fit that stops early never tells a wrong count.
    """
    done, log, ready = [], [], []
    watched = df
    for i, step in enumerate(steps):
        before = set(df.columns)
        if not ready:
            ready = fit_next(df, steps[i:], row_id)
        fitted = ready.pop(0)
        df, watched = fitted.transform(df), fitted.transform(watched)
        seen = None
        if step.method in ROW_STEPS:
            seen = Observation(f"{i}-{step.method}")
            watched = apart(watched) if watched.sparkSession is df.sparkSession else watched
            watched = watched.observe(seen, F.count(F.lit(1)).alias("rows"))
        if path is not None and (step.method == "remove_duplicate_rows" or i == len(steps) - 1):
            spark = df.sparkSession
            watched.write.mode("overwrite").parquet(f"{path}/{i}")
            df = watched = spark.read.schema(df.schema).parquet(f"{path}/{i}")
        touched = fitted.params.get("columns") or fitted.params.get("classes") or list(fitted.params)
        detail = {
            "columns": ",".join(map(str, touched)) if isinstance(touched, list) else str(touched),
            "added": ",".join(sorted(set(df.columns) - before)),
            "dropped": ",".join(sorted(before - set(df.columns))),
        }
        log.append((i, step.method, detail, seen))
        done.append(fitted)
    return Prepared(df, FittedChain(done), log, watched if path is None else None)


@dataclass(frozen=True)
class SplitPlan:
    method: str = "intra"
    target: str = "target_label"
    test_size: float = 0.3
    seed: int = 42
    n_splits: int = 5
    timestamp_column: str | None = None
    benign: object = 0


def split(tables: dict[str, DataFrame], plan: SplitPlan) -> DataFrame:
    """Split datasets into one long table with ``dataset`` and ``split`` (or ``fold``) columns."""
    if plan.method in ("cross_dataset", "cross_dataset_benign"):
        aligned = align_tables(tables, ("row_id", plan.target))
        if plan.method == "cross_dataset":
            return splits.split_cross_dataset(aligned, plan.target, plan.test_size, plan.seed)
        return splits.split_cross_dataset_benign(aligned, plan.target, plan.benign, plan.test_size, plan.seed)

    def one(df: DataFrame) -> DataFrame:
        if plan.method == "intra":
            return splits.split_stratified(df, plan.target, plan.test_size, plan.seed)
        if plan.method == "k_fold":
            return splits.split_kfold(df, plan.target, plan.n_splits)
        if plan.method == "timestamp":
            return splits.split_timestamp(df, plan.timestamp_column, plan.test_size)
        if plan.method == "benign_train":
            return splits.split_benign_train(df, plan.target, plan.benign, plan.test_size, plan.seed)
        raise ValueError(f"unknown split method {plan.method!r}")

    parts = [one(df).withColumn("dataset", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def prepare(
    spark: SparkSession,
    tables: dict[str, DataFrame | list[SubFile]],
    steps: dict[str, list[Step]],
    plan: SplitPlan,
    root: str,
    config_hash: str,
    selection: str = "none",
    selection_params: dict | None = None,
    reports: bool = True,
) -> tuple[str, dict[str, Prepared]]:
    """Preprocess, select, split and store labelled tables; returns the path and the prepared datasets.

    A dataset is a table with a ``row_id``, or a list of input files, which are
    loaded, labelled and landed as Parquet first. Reports of the stored split and
    the log of all steps are written under ``root/reports/config_hash``.
    """
    base = f"{root}/prepared/{config_hash}"
    ready = {
        name: t if isinstance(t, DataFrame) else land(load_dataset(spark, t), f"{base}/{name}/landed")
        for name, t in tables.items()
    }
    prepared = {name: preprocess(df, steps.get(name, []), path=f"{base}/{name}") for name, df in ready.items()}
    choose = select.FEATURE_SELECTION[selection]
    chosen = {name: choose(p.table, **(selection_params or {})) for name, p in prepared.items()}
    path = write_splits(split(chosen, plan), root, config_hash)
    if reports:
        steps_done = reduce(DataFrame.unionByName, [p.step_table(name) for name, p in prepared.items()])
        tables_of = dataset_report(read_splits(spark, root, config_hash), plan.target, plan.benign)
        for name, table in {**tables_of, "steps": steps_done}.items():
            write_report(table, report_path(root, config_hash, name))
    return path, prepared


def dataset_report(stored: DataFrame, target: str, benign: object = 0) -> dict[str, DataFrame]:
    """Class, split and summary tables of a stored split."""
    key = "fold" if "fold" in stored.columns else "split"
    out = {
        "summary": profile.dataset_summary(stored, ("row_id", "dataset", key)),
        "classes": profile.class_distribution(stored, target, ["dataset"]),
        "splits": profile.split_distribution(stored, target, ["dataset", key]),
        "metadata": profile.split_metadata(stored, target, benign, ["dataset", key]),
    }
    if key == "fold":
        out["folds"] = profile.kfold_stats(stored)
    return out
