"""Reconstruction-error detectors fitted on benign rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import normal_cdf, quote
from flowgauge.operators.ranking import percentiles

LOG_FLOOR = 1e-10


@dataclass(frozen=True)
class ErrorModel:
    """Log-normal fit of the error on benign rows and the alarm threshold."""

    mean: float
    std: float
    threshold: float

    def score(self, df: DataFrame, rmse: str = "rmse") -> DataFrame:
        """Add ``score`` (probability of a smaller error) and ``y_pred``."""
        r = F.col(rmse)
        z = (F.ln(F.when(r > 0, r)) - F.lit(self.mean)) / F.lit(self.std)
        return df.withColumn("score", F.when(r > 0, normal_cdf(z)).otherwise(F.lit(0.0))).withColumn(
            "y_pred", F.when(r > self.threshold, 1).otherwise(0)
        )


def fit_error_model(
    errors: DataFrame, method: str = "sigma", sigma: float = 3.0, percentile: float = 95.0, rmse: str = "rmse"
) -> ErrorModel:
    """``errors`` holds the error of benign training rows; zero errors do not count."""
    if method not in ("sigma", "percentile"):
        raise ValueError(f"unknown threshold method {method!r}")
    used = errors.where(F.col(rmse) > 0)
    log_r = F.ln(F.col(rmse) + F.lit(LOG_FLOOR))
    row = used.agg(F.avg(log_r).alias("m"), F.stddev_pop(log_r).alias("s")).collect()[0]
    if row["m"] is None:
        raise ValueError("no training row has an error above 0")
    std = row["s"] if row["s"] >= 1e-10 else 1.0
    if method == "sigma":
        threshold = math.exp(row["m"] + sigma * std)
    else:
        threshold = percentiles(used, [rmse], percentile / 100.0)[rmse]
    return ErrorModel(row["m"], std, threshold)


@dataclass(frozen=True)
class ZScores:
    """Per-column mean and population deviation of benign rows; the error is the mean squared z-score."""

    params: dict[str, tuple[float, float]]

    @staticmethod
    def fit(benign: DataFrame, features: list[str]) -> "ZScores":
        pairs = (("m", F.avg), ("s", F.stddev_pop))
        aggs = [f(F.col(quote(c)).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in pairs]
        row = benign.agg(*aggs).collect()[0]
        return ZScores({c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(features)})

    def column(self, c: str) -> Column:
        mean, std = self.params[c]
        return (F.col(quote(c)).cast("double") - F.lit(mean)) / F.lit(std)

    def add_rmse(self, df: DataFrame) -> DataFrame:
        squares = [self.column(c) * self.column(c) for c in self.params]
        return df.withColumn("rmse", F.sqrt(reduce(lambda a, b: a + b, squares) / F.lit(float(len(squares)))))


@dataclass(frozen=True)
class PcaReconstruction:
    """Error of rebuilding a standardised row from its first components.

    Rows are handled as one vector each, so that wide tables keep small plans.
    The components are orthonormal, so the squared error is the squared length of
    a row minus that of its projection.
    """

    features: list[str]
    means: list[float]
    scales: list[float]
    model: PCAModel

    @staticmethod
    def fit(benign: DataFrame, features: list[str], k: int) -> "PcaReconstruction":
        raw = F.array(*[F.col(quote(c)).cast("double") for c in features])
        stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(raw))
        row = benign.select(stats.alias("s")).collect()[0]["s"]
        n = row["count"]
        means = [float(m) for m in row["mean"]]
        scales = [math.sqrt(x * (n - 1) / n) or 1.0 for x in row["variance"]]
        shaped = _standardised(benign, features, means, scales)
        model = PCA(k=k, inputCol="__v", outputCol="__p").fit(shaped.select("__v"))
        return PcaReconstruction(list(features), means, scales, model)

    def add_rmse(self, df: DataFrame) -> DataFrame:
        def squared_length(values: Column) -> Column:
            return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)

        projected = self.model.transform(_standardised(df, self.features, self.means, self.scales))
        coded = squared_length(vector_to_array(F.col("__p")))
        left = F.greatest(F.lit(0.0), squared_length(F.col("__z")) - coded)
        rmse = F.sqrt(left / F.lit(float(len(self.features))))
        return projected.withColumn("rmse", rmse).drop("__z", "__v", "__p")


def _standardised(df: DataFrame, features: list[str], means: list[float], scales: list[float]) -> DataFrame:
    raw = F.array(*[F.col(quote(c)).cast("double") for c in features])
    centered = F.zip_with(raw, F.lit(means), lambda x, m: x - m)
    scaled = F.zip_with(centered, F.lit(scales), lambda x, s: x / s)
    return df.withColumn("__z", scaled).withColumn("__v", array_to_vector("__z"))
