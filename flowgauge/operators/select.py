"""Feature selection from one pass of moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import finite_or_null, is_numeric, quote
from flowgauge.operators.labeling import LABELS


def numeric_features(df: DataFrame, skip: tuple[str, ...] = ("row_id",)) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in LABELS and f.name not in skip]


def _value(c: str):
    return finite_or_null(F.col(quote(c)).cast("double"))


def variances(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.var_pop(_value(c)).alias(f"v{i}") for i, c in enumerate(columns)]).collect()[0]
    return {c: row[f"v{i}"] for i, c in enumerate(columns)}


def variance_threshold(df: DataFrame, threshold: float = 0.0, skip: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Keep numeric columns that vary more than the threshold; text and labels stay."""
    cols = numeric_features(df, skip)
    var = variances(df, cols)
    low = [c for c in cols if var[c] is None or var[c] <= threshold]
    if cols and len(low) == len(cols):
        raise ValueError(f"no feature has a variance above {threshold}")
    return df.drop(*low)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every column pair (feature_a before feature_b), over rows where both are present.

    A column that is constant over these rows gives NULL. Gram matrices are summed
    per batch, so that the work stays one pass for any number of columns.
    """
    shaped = df.select(*[_value(c).alias(f"x{i}") for i, c in enumerate(columns)])
    long = _pair_moments(shaped, len(columns))
    names = F.array(*[F.lit(c) for c in columns])
    return long.select(
        names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"), "i", "j", "r"
    )


def _pair_moments(shaped: DataFrame, p: int) -> DataFrame:
    shift = shaped.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)).alias(f"x{i}") for i in range(p)]).collect()[0]
    center = np.array([shift[f"x{i}"] for i in range(p)])
    ii, jj = np.triu_indices(p, 1)

    def partial(batches):
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - center
            m = (~np.isnan(x)).astype(float)
            z = np.where(m > 0, x, 0.0)
            q = z * z
            part = np.stack([m.T @ m, z.T @ m, m.T @ z, z.T @ z, q.T @ m, m.T @ q])
            total = part if total is None else total + part
        if total is not None:
            t = total[:, ii, jj]
            yield pd.DataFrame({"i": ii, "j": jj, "n": t[0], "sx": t[1], "sy": t[2], "sxy": t[3], "sxx": t[4], "syy": t[5]})

    parts = shaped.mapInPandas(partial, "i int, j int, n double, sx double, sy double, sxy double, sxx double, syy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    tiny = F.lit(1e-12) * F.col("n")
    ok = (vx > tiny * F.col("sxx")) & (vy > tiny * F.col("syy"))
    return s.select("i", "j", F.when(ok, cov / F.sqrt(vx * vy)).alias("r"))


def correlation_threshold(df: DataFrame, threshold: float = 0.95, skip: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Drop a column when any earlier one correlates with it beyond the threshold."""
    cols = numeric_features(df, skip)
    if len(cols) < 2:
        return df
    high = correlations(df, cols).where(F.abs("r") > threshold).select("feature_b").distinct().collect()
    return df.drop(*[r["feature_b"] for r in high])


def parse_threshold(threshold: str | float | None, importances: np.ndarray, l1: bool) -> float:
    """A number, 'mean', 'median' or a multiple such as '1.25*mean'."""
    if threshold is None:
        return 1e-5 if l1 else float(np.mean(importances))
    if isinstance(threshold, (int, float)):
        return float(threshold)
    scale, _, name = threshold.rpartition("*")
    stat = {"mean": np.mean, "median": np.median}[name.strip()](importances)
    return float(scale or 1.0) * float(stat)


def logistic_selection(
    df: DataFrame,
    target: str = "target_label",
    penalty: str = "l2",
    c: float = 1.0,
    l1_ratio: float = 0.5,
    max_iter: int = 100,
    threshold: str | float | None = None,
    skip: tuple[str, ...] = ("row_id",),
) -> tuple[DataFrame, dict[str, float]]:
    """Keep features whose logistic-regression weight is large enough; returns the table and the weights.

    Columns with any missing or infinite cell are left out of the fit and dropped.
    """
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio, "none": 0.0}[penalty]
    cols = numeric_features(df, skip)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_value(x)).alias(f"c{i}") for i, x in enumerate(cols)]).collect()[0]
    full = [x for i, x in enumerate(cols) if row[f"c{i}"] == row["n"]]
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(full))], outputCol="features").transform(
        df.select(F.col(target).cast("double").alias("y"), *[_value(x).alias(f"f{i}") for i, x in enumerate(full)])
    )
    reg = 0.0 if penalty == "none" else 1.0 / (c * row["n"])
    model = LogisticRegression(
        labelCol="y", maxIter=max_iter, regParam=reg, elasticNetParam=mix, standardization=False
    ).fit(vectors)
    weights = np.abs(model.coefficientMatrix.toArray()).sum(axis=0)
    cut = parse_threshold(threshold, weights, penalty == "l1")
    scores = dict(zip(full, weights.tolist()))
    gone = [x for x in cols if x not in scores or scores[x] < cut]
    return df.drop(*gone), scores


FEATURE_SELECTION = {
    "none": lambda df, **params: df,
    "variance": variance_threshold,
    "correlation": correlation_threshold,
    "logistic_regression": lambda df, **params: logistic_selection(df, **params)[0],
}
