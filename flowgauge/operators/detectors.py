"""Detectors: fit on a training table, then add ``y_pred``, ``score`` and ``proba``.

Learners are Spark ML estimators, so training is distributed and a fitted
detector is a ``PipelineModel`` that also scores streams. Where a learner of the
usual single-machine stacks has no Spark counterpart (boosted meta-learners with
other losses, randomised trees, dropout networks), a near relative takes its
place in the same dataflow; scores differ, inputs and outputs do not.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCAModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions.hashing import hash_uniform
from flowgauge.functions.scalars import BENIGN_NAME, attack_score, is_numeric, quote, resolve_benign
from flowgauge.operators import anomaly, perturb
from flowgauge.operators.fitted import Fitted, fit_min_max

# class names are held on the driver and in every model; more than this is taken for a wrong column
MAX_CLASSES = 1000
KEPT = StorageLevel.MEMORY_AND_DISK


class FittedDetector(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...

    def save(self, path: str) -> None: ...


class Detector(Protocol):
    def fit(self, df: DataFrame, features: list[str], target: str) -> FittedDetector: ...


def _write_meta(path: str, meta: dict) -> None:
    row = SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema("meta string").json(f"{path}/meta").collect()[0]["meta"])


def _assembled(features: list[str], out: str = "__features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error")


def _doubles(df: DataFrame, features: list[str]) -> DataFrame:
    """Plain numbered DOUBLE copies, so that odd column names never reach ML stages."""
    return df.select("*", *[F.col(quote(c)).cast("double").alias(f"__f{i}") for i, c in enumerate(features)])


def _names(features: list[str]) -> list[str]:
    return [f"__f{i}" for i in range(len(features))]


@dataclass
class PipelineDetector:
    """A fitted pipeline with class names; the last stage gives prediction and probability."""

    model: PipelineModel
    features: list[str]
    classes: list[str]
    numeric_target: bool
    benign: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(_doubles(df, self.features))
        names = F.array(*[F.lit(c) for c in self.classes])
        label = names[F.col("prediction").cast("int")]
        y_pred = label.cast("int") if self.numeric_target else label
        proba = F.map_from_arrays(names, vector_to_array(F.col("probability")))
        benign = None if set(self.classes) <= {"0", "1"} else self.benign
        out = scored.withColumn("y_pred", y_pred).withColumn("proba", proba)
        out = out.withColumn("score", attack_score(F.col("proba"), benign))
        return out.select(*[quote(c) for c in df.columns], "y_pred", "score", "proba")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = {
            "features": self.features,
            "classes": self.classes,
            "numeric_target": self.numeric_target,
            "benign": self.benign,
        }
        _write_meta(path, meta)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PipelineDetector":
        return PipelineDetector(PipelineModel.load(f"{path}/model"), **_read_meta(spark, path))


# turns an assembled, labelled training table into fitted stages
Fit = Callable[[DataFrame, int, int], list]


def _fit_pipeline(
    df: DataFrame, features: list[str], target: str, fit: Fit, benign: str | None, max_classes: int = MAX_CLASSES
) -> PipelineDetector:
    """Assemble and index once, keep the training vectors (spilling to disk), and fit the stages on them.

    More than ``max_classes`` classes are refused. Many classes need one named
    benign, in any case, for scores to tell attacks from it.
    """
    label = F.col(quote(target)).cast("string")
    train = _doubles(df, features).withColumn("__y", label).select(*_names(features), "__y")
    indexer = StringIndexer(inputCol="__y", outputCol="__label", stringOrderType="alphabetAsc").fit(train)
    classes = list(indexer.labels)
    if len(classes) > max_classes:
        raise ValueError(f"{len(classes)} classes; is {target!r} a label column?")
    if benign is not None and not set(classes) <= {"0", "1"}:
        benign = resolve_benign(classes, benign)
    assembler = _assembled(_names(features))
    vectors = assembler.transform(indexer.transform(train)).select("__features", "__label").persist(KEPT)
    try:
        fitted = fit(vectors, len(features), len(classes))
    finally:
        vectors.unpersist()
    model = PipelineModel(stages=[assembler, *fitted])
    return PipelineDetector(model, list(features), classes, is_numeric(df.schema[target].dataType), benign)


@dataclass
class EstimatorDetector:
    """Any classifier estimator as a detector; the way user code plugs in."""

    build: Callable[[int, int], Estimator]
    benign: str | None = BENIGN_NAME
    max_classes: int = MAX_CLASSES
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, features: list[str], target: str) -> PipelineDetector:
        def fit(vectors: DataFrame, n: int, k: int) -> list:
            est = self.build(n, k)
            return [est.copy({est.featuresCol: "__features", est.labelCol: "__label"}).fit(vectors)]

        return _fit_pipeline(df, features, target, fit, self.benign, self.max_classes)


def decision_tree(max_depth: int = 10, seed: int = 0, benign: str | None = BENIGN_NAME, **params) -> EstimatorDetector:
    build = lambda n, k: DecisionTreeClassifier(maxDepth=max_depth, seed=seed, **params)
    return EstimatorDetector(build, benign, params={"max_depth": max_depth, "seed": seed, **params})


@dataclass
class TreeStack:
    """Four tree learners and a meta-learner on their predictions for the training rows."""

    max_depth: int = 8
    forest_trees: int = 20
    boost_rounds: int = 10
    stack_rounds: int = 10
    seed: int = 0
    benign: str | None = BENIGN_NAME

    def fit(self, df: DataFrame, features: list[str], target: str) -> PipelineDetector:
        def named(est, name: str):
            """A base learner whose outputs do not clash with the others."""
            return (
                est.setFeaturesCol("__features")
                .setLabelCol("__label")
                .setPredictionCol(f"__p_{name}")
                .setProbabilityCol(f"__q_{name}")
                .setRawPredictionCol(f"__r_{name}")
            )

        def fit(vectors: DataFrame, n: int, k: int) -> list:
            depth, trees, seed = self.max_depth, self.forest_trees, self.seed
            base = {
                "tree": DecisionTreeClassifier(maxDepth=depth, seed=seed),
                "forest": RandomForestClassifier(maxDepth=depth, numTrees=trees, seed=seed),
                "random": RandomForestClassifier(maxDepth=depth, numTrees=trees, featureSubsetStrategy="1", seed=seed + 1),
            }
            if k == 2:
                base["boost"] = GBTClassifier(maxDepth=min(5, depth), maxIter=self.boost_rounds, seed=seed)
                meta = GBTClassifier(maxIter=self.stack_rounds, maxDepth=3, seed=seed)
            else:
                meta = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
            # the base learners do not see each other, so each is fitted on the plain vectors
            learners = [named(est, name).fit(vectors) for name, est in base.items()]
            votes = _assembled([f"__p_{name}" for name in base], "__meta")
            voted = PipelineModel(stages=[*learners, votes]).transform(vectors)
            stacked = meta.setFeaturesCol("__meta").setLabelCol("__label").fit(voted)
            return [*learners, votes, stacked]

        return _fit_pipeline(df, features, target, fit, self.benign)


@dataclass
class ScaledDetector:
    """A detector behind its own min-max scaling."""

    scaler: Fitted
    inner: PipelineDetector

    def transform(self, df: DataFrame) -> DataFrame:
        features = self.inner.features
        kept = df.select("*", *[F.col(quote(c)).alias(f"__o{i}") for i, c in enumerate(features)])
        scored = self.inner.transform(self.scaler.transform(kept))
        back = {c: F.col(f"__o{i}").alias(c) for i, c in enumerate(features)}
        return scored.select(*[back.get(c, F.col(quote(c))) for c in df.columns], "y_pred", "score", "proba")

    def save(self, path: str) -> None:
        self.inner.save(f"{path}/inner")
        _write_meta(path, self.scaler.params)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ScaledDetector":
        scaler = Fitted("min_max", _read_meta(spark, path))
        return ScaledDetector(scaler, PipelineDetector.load(spark, f"{path}/inner"))


@dataclass
class FeedForward:
    """Feed-forward network on min-max scaled features; the first listed layer size is not used."""

    layers: tuple[int, ...] = (64, 32, 16)
    max_iter: int = 60
    seed: int = 0
    benign: str | None = BENIGN_NAME

    def fit(self, df: DataFrame, features: list[str], target: str) -> ScaledDetector:
        scaler = fit_min_max(df, features)

        def fit(vectors: DataFrame, n: int, k: int) -> list:
            net = MultilayerPerceptronClassifier(
                featuresCol="__features",
                labelCol="__label",
                layers=[n, *self.layers[1:], k],
                maxIter=self.max_iter,
                seed=self.seed,
            )
            return [net.fit(vectors)]

        return ScaledDetector(scaler, _fit_pipeline(scaler.transform(df), features, target, fit, self.benign))


def network_of(fitted: FittedDetector) -> perturb.Network | None:
    """Weights of a detector that is a feed-forward network, with the scaling before it; None for any other."""
    scaler, inner = (fitted.scaler, fitted.inner) if isinstance(fitted, ScaledDetector) else (None, fitted)
    net = inner.model.stages[-1] if isinstance(inner, PipelineDetector) else None
    if not isinstance(net, MultilayerPerceptronClassificationModel):
        return None
    sizes, flat, at, layers = net.getLayers(), net.weights.toArray(), 0, []
    for n_in, n_out in zip(sizes, sizes[1:]):
        # a layer's matrix lies column by column, its biases follow
        w = flat[at : at + n_in * n_out].reshape(n_in, n_out).T
        b = flat[at + n_in * n_out : at + n_in * n_out + n_out]
        layers.append((w.copy(), b.copy()))
        at += (n_in + 1) * n_out
    low = {c: (lo, hi) for c, (lo, hi) in scaler.params.items()} if scaler else {}
    return perturb.Network(list(inner.features), layers, low)


@dataclass
class AnomalyDetector:
    """Learns benign rows only; alarms on large standardised or reconstruction errors."""

    method: str = "sigma"
    sigma: float = 3.0
    percentile: float = 95.0
    components: int | None = None
    benign: object = 0

    def fit(self, df: DataFrame, features: list[str], target: str) -> "FittedAnomaly":
        benign = df.where(F.col(quote(target)) == F.lit(self.benign))
        if self.components is None:
            errors = anomaly.ZScores.fit(benign, features)
        else:
            errors = anomaly.PcaReconstruction.fit(benign, features, self.components)
        model = anomaly.fit_error_model(errors.add_rmse(benign), self.method, self.sigma, self.percentile)
        return FittedAnomaly(errors, model)


@dataclass
class FittedAnomaly:
    errors: anomaly.ZScores | anomaly.PcaReconstruction
    model: anomaly.ErrorModel

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.score(self.errors.add_rmse(df))
        return scored.withColumn("proba", _two_classes()).select(
            *[quote(c) for c in df.columns], "y_pred", "score", "proba"
        )

    def save(self, path: str) -> None:
        meta = {"model": asdict(self.model)}
        if isinstance(self.errors, anomaly.ZScores):
            meta["z"] = self.errors.params
        else:
            e = self.errors
            meta["pca"] = {"features": e.features, "means": e.means, "scales": e.scales}
            e.model.write().overwrite().save(f"{path}/model")
        _write_meta(path, meta)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedAnomaly":
        meta = _read_meta(spark, path)
        if "z" in meta:
            errors = anomaly.ZScores({c: tuple(p) for c, p in meta["z"].items()})
        else:
            errors = anomaly.PcaReconstruction(**meta["pca"], model=PCAModel.load(f"{path}/model"))
        return FittedAnomaly(errors, anomaly.ErrorModel(**meta["model"]))


def _two_classes() -> Column:
    return F.map_from_arrays(F.array(F.lit("0"), F.lit("1")), F.array(1.0 - F.col("score"), F.col("score")))


# ---- cluster-routed ensemble ---------------------------------------------


def nearest_center(vector: Column, centers: list[list[float]]) -> Column:
    """Index of the centre closest to an array column by squared distance; ties go to the lower index."""

    def distance(center: list[float]) -> Column:
        gaps = F.zip_with(vector, F.array(*[F.lit(float(c)) for c in center]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g)

    ranked = F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)])
    return F.array_min(ranked)["i"]


def cluster_arm_rewards(df: DataFrame, cluster: str, label: Column, arm_predictions: list[Column]) -> DataFrame:
    """Per cluster and arm: accuracy of the arm on the rows whose class equals the arm's index, 0 if none."""
    rewards = [
        F.coalesce(F.avg(F.when(label == a, (p == label).cast("double"))), F.lit(0.0)).alias(f"arm_{a}")
        for a, p in enumerate(arm_predictions)
    ]
    return df.groupBy(cluster).agg(*rewards)


def beta_quantiles(a: float, b: float, points: int = 2049) -> np.ndarray:
    """Quantile table of Beta(a, b) for a, b in [1, 2] on an even grid of probabilities."""
    x = np.linspace(0.0, 1.0, 16385)
    pdf = x ** (a - 1.0) * (1.0 - x) ** (b - 1.0)
    cdf = np.concatenate([[0.0], np.cumsum((pdf[1:] + pdf[:-1]) / 2.0)])
    return np.interp(np.linspace(0.0, 1.0, points), cdf / cdf[-1], x)


def route(cluster: Column, rewards: list[list[float]], seed: int, row_id: Column, greedy: bool = False) -> Column:
    """Arm of each row: the largest draw from Beta(1 + r, 2 - r), or the best mean reward."""
    arms = len(rewards[0])
    if greedy:
        best = [int(np.argmax(r)) for r in rewards]
        return F.array(*[F.lit(b) for b in best])[cluster]
    tables = np.stack([[beta_quantiles(1.0 + r, 2.0 - r) for r in rs] for rs in rewards])
    grid = np.linspace(0.0, 1.0, tables.shape[2])

    @F.pandas_udf("int")
    def pick(c: pd.Series, u: pd.Series) -> pd.Series:
        ids = c.to_numpy()
        draws = np.stack(u.to_numpy())
        out = np.zeros(len(ids), dtype=np.int32)
        for k in np.unique(ids):
            at = ids == k
            theta = np.stack([np.interp(draws[at, j], grid, tables[k, j]) for j in range(arms)], axis=1)
            out[at] = theta.argmax(axis=1)
        return pd.Series(out)

    uniforms = F.array(*[hash_uniform(seed, F.lit(f"arm{j}"), row_id) for j in range(arms)])
    return pick(cluster, uniforms)


@dataclass
class ClusterRouted:
    """k-means clusters, five learners on all rows, and a learner drawn per row from its cluster's rewards."""

    clusters: int = 10
    seed: int = 0
    greedy: bool = False
    row_id: str = "row_id"
    forest_trees: int = 20
    layers: tuple[int, ...] = field(default=(16,))
    n_arms: int = 5
    benign: str | None = BENIGN_NAME

    def fit(self, df: DataFrame, features: list[str], target: str) -> "FittedClusterRouted":
        if not 1 <= self.n_arms <= 5:
            raise ValueError("there are one to five arms")
        numeric = is_numeric(df.schema[target].dataType)
        label, classes, benign = F.col(quote(target)), None, None
        if not numeric:
            indexer = StringIndexer(inputCol="__y", outputCol="__label", stringOrderType="alphabetAsc")
            classes = list(indexer.fit(df.select(label.cast("string").alias("__y"))).labels)
            benign = resolve_benign(classes, self.benign or BENIGN_NAME)
            # the benign class is number 0, as among numeric labels
            classes = [benign, *[c for c in classes if c != benign]]
            label = F.array_position(F.array(*map(F.lit, classes)), label.cast("string")) - 1
        train = df.select(label.cast("double").alias("__label"), *[F.col(quote(c)) for c in features])
        # naive Bayes and the network want scaled features, so all learners see them
        scaler = fit_min_max(train, features)
        assembler = _assembled(_names(features))
        scaled = _doubles(scaler.transform(train), features)
        vectors = assembler.transform(scaled).select("__features", "__label").persist(KEPT)
        try:
            k = int(vectors.agg(F.max("__label")).collect()[0][0]) + 1
            learners = [
                RandomForestClassifier(numTrees=self.forest_trees, seed=self.seed),
                DecisionTreeClassifier(seed=self.seed),
                MultilayerPerceptronClassifier(layers=[len(features), *self.layers, max(2, k)], maxIter=40, seed=self.seed),
                LogisticRegression(maxIter=40),
                NaiveBayes(modelType="gaussian"),
            ][: self.n_arms]
            arms = [
                est.setFeaturesCol("__features")
                .setLabelCol("__label")
                .setPredictionCol(f"__arm{i}")
                .setProbabilityCol(f"__q{i}")
                .setRawPredictionCol(f"__r{i}")
                .fit(vectors)
                for i, est in enumerate(learners)
            ]
            clusters = KMeans(featuresCol="__features", predictionCol="__cluster", k=self.clusters, seed=self.seed)
            routed = [clusters.fit(vectors), *arms]
            picks = [F.col(f"__arm{i}") for i in range(len(arms))]
            scored = PipelineModel(stages=routed).transform(vectors)
            table = cluster_arm_rewards(scored, "__cluster", F.col("__label"), picks).collect()
        finally:
            vectors.unpersist()
        rewards = [[0.0] * len(arms) for _ in range(self.clusters)]
        for r in table:
            rewards[r["__cluster"]] = [r[f"arm_{i}"] for i in range(len(arms))]
        model = PipelineModel(stages=[assembler, *routed])
        return FittedClusterRouted(model, scaler, list(features), rewards, self.seed, self.greedy, self.row_id, classes)


@dataclass
class FittedClusterRouted:
    model: PipelineModel
    scaler: Fitted
    features: list[str]
    rewards: list[list[float]]
    seed: int
    greedy: bool
    row_id: str
    classes: list[str] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.select("*", *[F.col(quote(c)).alias(f"__o{i}") for i, c in enumerate(self.features)])
        scored = self.model.transform(_doubles(self.scaler.transform(kept), self.features))
        arm = route(F.col("__cluster"), self.rewards, self.seed, F.col(self.row_id), self.greedy)
        preds = F.array(*[F.col(f"__arm{i}") for i in range(len(self.rewards[0]))])
        # the arm that decides a row also gives its probabilities
        chances = F.array(*[vector_to_array(F.col(f"__q{i}")) for i in range(len(self.rewards[0]))])
        out = scored.withColumn("arm", arm).withColumn("__k", preds[F.col("arm")].cast("int"))
        out = out.withColumn("__c", chances[F.col("arm")])
        # class 0 is benign; an arm may know fewer classes than there are
        numbers = F.sequence(F.lit(0), F.size("__c") - 1)
        names = numbers if self.classes is None else F.slice(F.array(*map(F.lit, self.classes)), F.lit(1), F.size("__c"))
        y_pred = F.col("__k") if self.classes is None else F.array(*map(F.lit, self.classes))[F.col("__k")]
        out = out.withColumn("y_pred", y_pred).withColumn("score", F.lit(1.0) - F.col("__c")[0])
        back = {c: F.col(f"__o{i}").alias(c) for i, c in enumerate(self.features)}
        proba = F.map_from_arrays(names.cast("array<string>"), F.col("__c"))
        return out.withColumn("proba", proba).select(
            *[back.get(c, F.col(quote(c))) for c in df.columns], "arm", "y_pred", "score", "proba"
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = {
            "scaler": self.scaler.params,
            "features": self.features,
            "rewards": self.rewards,
            "seed": self.seed,
            "greedy": self.greedy,
            "row_id": self.row_id,
            "classes": self.classes,
        }
        _write_meta(path, meta)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedClusterRouted":
        meta = _read_meta(spark, path)
        scaler = Fitted("min_max", meta.pop("scaler"))
        return FittedClusterRouted(PipelineModel.load(f"{path}/model"), scaler, **meta)


# Detectors by name; user code adds its own factories.
REGISTRY: dict[str, Callable[..., Detector]] = {
    "decisiontree": decision_tree,
    "treestack": TreeStack,
    "feedforward": FeedForward,
    "anomaly": AnomalyDetector,
    "clusterrouted": ClusterRouted,
}


def detector(name: str, **params) -> Detector:
    """Look a detector up by name; case and underscores do not matter."""
    key = name.lower().replace("_", "")
    if key not in REGISTRY:
        raise KeyError(f"unknown detector {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[key](**params)


# How each kind of fitted detector is read back.
LOADERS: dict[str, Callable[[SparkSession, str], FittedDetector]] = {
    c.__name__: c.load for c in (PipelineDetector, ScaledDetector, FittedAnomaly, FittedClusterRouted)
}
