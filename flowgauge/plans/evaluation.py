"""Train, perturb, score and measure every planned run.

Predictions of a training run are one table with all its test sets and attacks;
they are stored, and all metrics are then a few jobs over that table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions.scalars import BENIGN_NAME
from flowgauge.operators import metrics, perturb, report, runs
from flowgauge.operators.collect import Resources
from flowgauge.operators.detectors import LOADERS, Detector, network_of
from flowgauge.sources.sinks import report_path, test_rows, train_rows, write_report


@dataclass(frozen=True)
class Attack:
    """A named perturbation; ``gradient`` follows the detector's own network, or a linear stand-in where it has none."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)


# what a gradient is taken of: the detector's network, or weights and bias of a linear stand-in
Slope = perturb.Network | tuple[dict[str, float], float]
# (table, features, parameters, slope or None) -> changed cells
Maker = Callable[[DataFrame, list[str], dict, Slope | None], perturb.Cells]


def _gradient(df, features, params, surrogate) -> perturb.Cells:
    if surrogate is None:
        raise ValueError("a gradient attack needs a network or a surrogate")
    if isinstance(surrogate, perturb.Network):
        return perturb.fgsm_network(features, surrogate, **params)
    return perturb.fgsm_linear(*surrogate, **params)


# Perturbations by kind; user code adds its own.
ATTACKS: dict[str, Maker] = {
    "noise": lambda df, features, params, surrogate: perturb.noise(features, **params),
    "junk": lambda df, features, params, surrogate: perturb.junk(df, **{"features": features, **params}),
    "gradient": _gradient,
}


def attack_cells(df: DataFrame, features: list[str], attack: Attack, surrogate=None, **override) -> perturb.Cells:
    if attack.kind not in ATTACKS:
        raise ValueError(f"unknown attack {attack.kind!r}; known: {sorted(ATTACKS)}")
    return ATTACKS[attack.kind](df, features, {**attack.params, **override}, surrogate)


# The parameter a robustness sweep varies; kinds not listed do not follow the strength.
STRENGTH = {"noise": "std", "gradient": "eps"}


DONE = ("evaluation_complete", "metrics_complete", "complete")


@dataclass
class Evaluation:
    """Evaluate detectors on a stored split table.

    Results are kept under two names, both derived from the settings below and
    from ``config_hash``, which stands for the data: models by what they are
    trained with, predictions, curves and metrics by everything. Changed attacks
    are therefore scored anew with the models there are.
    """

    spark: SparkSession
    stored: DataFrame
    features: list[str]
    target: str
    detectors: dict[str, Detector]
    root: str
    config_hash: str
    cross: bool = False
    attacks: list[Attack] = field(default_factory=list)
    allow_surrogate: bool = True
    epsilons: list[float] | None = None
    train_only: bool = False
    force_train: bool = False
    force_model: bool = False
    benign: str = BENIGN_NAME
    times: list[tuple[str, str, float]] = field(default_factory=list)
    collectors: tuple[str, ...] = ("wall", "tasks")

    def __post_init__(self) -> None:
        self.resources = Resources(self.spark, self.collectors)
        self.train_config = {
            "data": self.config_hash,
            "features": self.features,
            "target": self.target,
            "detectors": runs.describe(self.detectors),
        }
        scoring = ("cross", "attacks", "allow_surrogate", "epsilons", "benign")
        self.run_config = {**self.train_config, **{k: runs.describe(getattr(self, k)) for k in scoring}}
        self.train_key, self.key = runs.config_hash(self.train_config), runs.config_hash(self.run_config)
        self.ledger = runs.Ledger(self.spark, f"{self.root}/ledger", self.key)
        self._surrogates: dict[tuple, tuple] = {}

    def _folds(self) -> list[int | None]:
        if "fold" not in self.stored.columns:
            return [None]
        return sorted(r["fold"] for r in self.stored.select("fold").distinct().collect())

    def _pending(self) -> dict[tuple, list[str]]:
        """Training runs (id, dataset, fold, model) of the plan with test runs that are not finished, and all their test runs."""
        folds = self._folds()
        names = self.stored.select("dataset").distinct()
        plan = runs.evaluation_plan(names, list(self.detectors), self.cross, 0 if folds == [None] else len(folds))
        if folds == [None]:
            plan = plan.withColumn("fold", F.lit(None).cast("int"))
        # one row per train and test pair
        todo = plan if self.force_train else runs.pending_runs(plan, self.ledger.completed())
        open_ = {r["train_run_id"] for r in todo.collect()}
        out: dict[tuple, list[str]] = {}
        for r in plan.orderBy("train_dataset", "fold", "model", "run_id").collect():
            if r["train_run_id"] in open_:
                fold = None if r["fold"] is None else folds[r["fold"]]
                out.setdefault((r["train_run_id"], r["train_dataset"], fold, r["model"]), []).append(r["run_id"])
        return out

    def run(self) -> DataFrame | None:
        """Write the predictions of all pending training runs; returns the predictions of every run.

        With ``train_only`` detectors are trained and stored, and nothing is returned.
        """
        if self.epsilons is not None and not self.attacks:
            raise ValueError("a robustness sweep needs at least one attack")
        if self.cross and "fold" in self.stored.columns:
            raise ValueError("cross-dataset evaluation takes no folds")
        out = f"{self.root}/predictions/{self.key}"
        if self.ledger.stage() in DONE and not self.force_train and not self.train_only:
            return self.spark.read.parquet(out)
        runs.store_config(self.spark, f"{self.root}/config/{self.key}", self.run_config)
        self.ledger.set_stage("in_progress")
        names = sorted(r["dataset"] for r in self.stored.select("dataset").distinct().collect())
        for (run, name, fold, model), tests in self._pending().items():
            self._train_and_score(run, name, fold, model, self.detectors[model], out, names)
            if not self.train_only:
                self.ledger.add(*tests)
        if self.train_only:
            return None
        self.ledger.set_stage("evaluation_complete")
        return self.spark.read.parquet(out)

    def results(self, user_metrics: dict[str, metrics.Metric] | None = None, names: list[str] | None = None) -> DataFrame:
        """The metrics table of all runs; without user metrics or names it is stored and read again."""
        preds = self.run()
        curves = self.curves()
        if user_metrics is not None or names is not None:
            return results_of(preds, user_metrics, self.benign, names, curves)
        path = f"{self.root}/metrics/{self.key}"
        if self.ledger.stage() not in ("metrics_complete", "complete"):
            results_of(preds, None, self.benign, None, curves).write.mode("overwrite").parquet(path)
            self.ledger.set_stage("metrics_complete")
            self.write_reports(self.spark.read.parquet(path))
            self.ledger.set_stage("complete")
        return self.spark.read.parquet(path)

    def write_reports(self, results: DataFrame) -> None:
        """Tables of the report of this run, and what its phases cost if any was measured now, under ``root/reports``."""
        tables = {
            "overview": report.run_overview(results),
            "nested": report.nested_report(results),
            "performance_drop": report.performance_drop(results),
            "comparison": report.comparison_series(results),
        }
        if self.resources.rows:
            tables["resources"] = self.resources.table()
            if "tasks" in self.collectors:
                tables["resource_summary"] = metrics.resource_summary(self.resources.samples(), ["run_id", "phase"], "cpu", "ram")
        for name, table in tables.items():
            write_report(table, report_path(self.root, self.key, name))

    def curves(self) -> DataFrame | None:
        """Accuracy by strength of every train and test pair, if a sweep was asked for."""
        return None if self.epsilons is None else self.spark.read.parquet(f"{self.root}/curves/{self.key}")

    def clear(self) -> None:
        """Forget which runs are finished; the next run scores them anew."""
        self.ledger.clear()

    def _train_and_score(self, run, name, fold, model, detector, out, names) -> None:
        own = self.stored.where(F.col("dataset") == name)
        train = train_rows(own, fold)
        fitted = self._fitted(run, name, fold, model, detector, train)
        if self.train_only:
            return
        leaf = f"train_run={run.replace(' ', '')}"

        def predictions(scored: DataFrame) -> DataFrame:
            return scored.select(
                "row_id",
                F.lit(name).alias("train_dataset"),
                F.lit(model).alias("model"),
                F.col("dataset").alias("test_dataset"),
                F.lit(-1 if fold is None else fold).alias("fold"),
                F.nullif("attack", F.lit("")).alias("attack"),
                F.col(self.target).alias("y_true"),
                "y_pred",
                "score",
                F.lit(run).alias("train_run_id"),
            )

        # clean detection is timed for each test set by itself, without attacks
        for k, test_name in enumerate(names if self.cross else [name]):
            tests = test_rows(self.stored.where(F.col("dataset") == test_name), fold).withColumn("attack", F.lit(""))
            with runs.timed(self.times, f"{run}|{test_name}", "test"), self.resources.phase(f"{run}|{test_name}", "test"):
                predictions(fitted.transform(tests)).write.mode("append" if k else "overwrite").parquet(f"{out}/{leaf}")
        attacks = [a for a in self.attacks if a.kind != "gradient" or self.allow_surrogate]
        surrogate = self._slope(name, fold, train, fitted) if any(a.kind == "gradient" for a in attacks) else None
        tests = test_rows(self.stored if self.cross else own, fold)
        if attacks:
            cells = {a.name: attack_cells(tests, self.features, a, surrogate) for a in attacks}
            copies = perturb.stack_attacks(tests, self.features, cells)
            predictions(fitted.transform(copies)).write.mode("append").parquet(f"{out}/{leaf}")
        if self.epsilons is not None:
            self._sweep(run, name, model, tests, fold, train, fitted)

    def _slope(self, name, fold, train, fitted) -> Slope:
        """The detector's own network, or the linear stand-in where there is none."""
        return network_of(fitted) or self._surrogate(name, fold, train)

    def _surrogate(self, name, fold, train):
        """The linear stand-in of a training set, fitted once for all models."""
        if (name, fold) not in self._surrogates:
            self._surrogates[name, fold] = perturb.fit_surrogate(train, self.features, self.target, benign=self.benign)
        return self._surrogates[name, fold]

    def _fitted(self, run, name, fold, model, detector, train):
        """The stored detector of this configuration, or a newly trained and stored one."""
        store = runs.ModelStore(self.spark, f"{self.root}/models/{self.train_key}", self.train_key)
        if not self.force_train:
            found = store.load(LOADERS, model, name, fold, force=self.force_model)
            if found is not None:
                return found
        with runs.timed(self.times, run, "train"), self.resources.phase(run, "train"):
            fitted = detector.fit(train, self.features, self.target)
        store.save(fitted, model, name, fold)
        return fitted

    def _sweep(self, run, name, model, tests, fold, train, fitted) -> None:
        """Accuracy of the first attack at every strength and on every test set, scored in one job."""
        first = self.attacks[0]
        rows = perturb.sweep(tests, self.epsilons)
        eps = F.col("epsilon")
        varied = {STRENGTH[first.kind]: eps} if first.kind in STRENGTH else {}
        if first.kind == "junk" and first.params.get("strength") is not None:
            varied = {"strength": eps}
        surrogate = self._slope(name, fold, train, fitted) if first.kind == "gradient" else None
        cells = attack_cells(rows, self.features, first, surrogate, **varied)
        moved = rows.select(
            *[F.when(eps > 0, cells[c]).otherwise(F.col(c)).alias(c) if c in cells else F.col(c) for c in rows.columns]
        )
        scored = fitted.transform(moved).withColumn("y_true", F.col(self.target)).withColumns(
            {"train_dataset": F.lit(name), "model": F.lit(model), "test_dataset": F.col("dataset"), "fold": F.lit(-1 if fold is None else fold)}
        )
        curve = perturb.robustness_curve(scored, ["train_dataset", "model", "test_dataset", "fold"])
        curve.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/curves/{self.key}/train_run={run.replace(' ', '')}")


KEYS = ["train_dataset", "model", "test_dataset", "fold", "attack"]


def results_of(
    preds: DataFrame,
    user_metrics: dict[str, metrics.Metric] | None = None,
    benign: str = BENIGN_NAME,
    names: list[str] | None = None,
    curves: DataFrame | None = None,
) -> DataFrame:
    """Long metrics table of stored predictions, keyed as the report operators expect.

    ``curves`` (accuracy by epsilon) adds the robustness index of each pair.
    """
    run = F.concat_ws("|", "train_dataset", "model", "test_dataset", F.col("fold").cast("string"), "attack")
    keyed = preds.withColumn("run_id", run)
    long = metrics.metrics_long(keyed, user_metrics, benign, names)
    of_run = keyed.groupBy("run_id").agg(*[F.first(k).alias(k) for k in KEYS])
    out = long.join(of_run, "run_id").select(*KEYS, "metric_key", "value")
    if curves is None or names is not None and not {"robustness_index", "test_robustness_index"} & set(names):
        return out
    pair = KEYS[:-1]
    index = metrics.to_long(metrics.robustness_index(curves, pair), pair)
    return out.unionByName(index.select(*pair, F.lit(None).cast("string").alias("attack"), "metric_key", "value"))


def runtime_results(preds: DataFrame, times: list[tuple[str, str, float]]) -> DataFrame:
    """Seconds, time per row and throughput of clean detection per test run, training seconds and cost per
    training run, as (run_id, metric_key, value). A test run is named ``training run|test dataset``."""
    spark = preds.sparkSession
    spent = spark.createDataFrame(times, "run_id string, phase string, seconds double")
    seconds = spent.groupBy("run_id").pivot("phase", ["train", "test"]).agg(F.sum("seconds"))
    tested = F.concat_ws("|", "train_run_id", "test_dataset").alias("run_id")
    rows = preds.where("attack is null").groupBy(tested).agg(F.count(F.lit(1)).alias("n"))
    joined = seconds.join(rows, "run_id", "left")
    rates = metrics.time_per_sample(joined.where("test is not null"), F.col("test"), F.col("n"))
    trained = joined.where("train is not null")
    cost = metrics.retrain_cost(trained, F.col("train"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    plain = joined.select(
        "run_id",
        F.inline(
            F.array(
                F.struct(F.lit("train_runtime_s").alias("metric_key"), F.col("train").alias("value")),
                F.struct(F.lit("test_runtime_s").alias("metric_key"), F.col("test").alias("value")),
            )
        ),
    )
    out = metrics.to_long(rates).unionByName(metrics.to_long(cost, prefix="train_")).unionByName(plain)
    return out.where("value is not null")
