"""Perturbed copies of a test table.

A perturbation is a set of column expressions, one per changed feature. Rows,
their ids and all other columns stay; random draws depend on (seed, feature,
row id) only.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.hashing import hash_normal, hash_uniform
from flowgauge.functions.scalars import BENIGN_NAME, attack_flag, quote

log = logging.getLogger(__name__)

Cells = dict[str, Column]

# Default strengths of a robustness sweep.
DEFAULT_EPSILONS = [0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3]


def _x(c: str) -> Column:
    return F.col(quote(c)).cast("double")


def _clip(v: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        v = F.greatest(v, F.lit(float(low)))
    if high is not None:
        v = F.least(v, F.lit(float(high)))
    return v


def noise(
    features: list[str],
    std: float | Column = 0.1,
    seed: int = 0,
    clip: tuple[float | None, float | None] = (0.0, 1.0),
    row_id: str = "row_id",
) -> Cells:
    """x + N(0, std), clipped."""
    s = std if isinstance(std, Column) else F.lit(float(std))
    return {c: _clip(_x(c) + s * hash_normal(seed, F.lit(c), F.col(row_id)), *clip) for c in features}


def junk(
    df: DataFrame,
    features: list[str],
    mode: str = "constant",
    amount: float = 1024.0,
    low: float = 0.0,
    high: float = 1024.0,
    percentage: float = 0.1,
    seed: int = 0,
    clip: tuple[float | None, float | None] = (None, None),
    row_id: str = "row_id",
    strength: float | Column | None = None,
) -> Cells:
    """Add a constant, a random or a proportional amount; unknown modes act as constant.

    ``strength`` scales what is added; without it the amounts stand as given.
    """
    out: Cells = {}

    def scaled(added: Column) -> Column:
        if strength is None:
            return added
        return added * (strength if isinstance(strength, Column) else F.lit(float(strength)))

    for c in features:
        if c not in df.columns:
            log.warning("feature %r not found, skipped", c)
            continue
        if mode == "random":
            v = _x(c) + scaled(F.lit(low) + F.lit(high - low) * hash_uniform(seed, F.lit(c), F.col(row_id)))
        elif mode == "percentage":
            v = _x(c) * (F.lit(1.0) + scaled(F.lit(percentage)))
        else:
            if mode != "constant":
                log.warning("unknown mode %r, using constant", mode)
            v = _x(c) + scaled(F.lit(float(amount)))
        out[c] = _clip(v, *clip)
    return out


def linear_margin(weights: dict[str, float], bias: float) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * _x(c) for c, w in weights.items()], F.lit(float(bias)))


def fgsm_linear(
    weights: dict[str, float],
    bias: float,
    eps: float | Column = 0.1,
    clip: tuple[float | None, float | None] = (0.0, 1.0),
) -> Cells:
    """Step of size eps along the sign of the loss gradient of a linear model, for its own label."""
    if not isinstance(eps, Column):
        if eps <= 0:
            raise ValueError("the gradient step needs eps > 0")
        eps = F.lit(float(eps))
    side = F.when(linear_margin(weights, bias) >= 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return {c: _clip(_x(c) + eps * (F.lit(float((w > 0) - (w < 0))) * side), *clip) for c, w in weights.items()}


@dataclass
class Network:
    """A feed-forward network: matrix (to, from) and biases of each layer, sigmoids between, softmax at the end.

    ``ranges`` holds the (least, greatest) value of each feature that was scaled to
    0..1 before; features without one go in as they are.
    """

    features: list[str]
    layers: list[tuple[np.ndarray, np.ndarray]]
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def _scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the first layer, and by how much each feature moves its own."""
        low, slope = np.zeros(x.shape[1]), np.ones(x.shape[1])
        for i, c in enumerate(self.features):
            if c in self.ranges and self.ranges[c][0] is not None:
                least, most = self.ranges[c]
                low[i], slope[i] = least, 1.0 / ((most - least) or 1.0)
        return (x - low) * slope, slope

    def _forward(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Outputs of each layer but the last, and the chances of the classes."""
        outs = [x]
        for w, b in self.layers[:-1]:
            z = outs[-1] @ w.T + b
            with np.errstate(over="ignore"):
                outs.append(1.0 / (1.0 + np.exp(-z)))
        w, b = self.layers[-1]
        z = outs[-1] @ w.T + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return outs, e / e.sum(axis=1, keepdims=True)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x)[0])[1]

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Signs of the loss gradient by each feature, for the class the network itself gives."""
        scaled, slope = self._scaled(x)
        outs, p = self._forward(scaled)
        rows, own = np.arange(len(x)), p.argmax(axis=1)
        delta = p.copy()
        # what the other classes have: p - 1 would round to nothing
        delta[rows, own] = 0.0
        delta[rows, own] = -delta.sum(axis=1)
        for (w, _), out in zip(self.layers[:0:-1], outs[:0:-1]):
            delta = delta @ w * out * (1.0 - out)
        return np.nan_to_num(np.sign(delta @ self.layers[0][0] * slope))


def fgsm_network(
    features: list[str],
    network: Network,
    eps: float | Column = 0.1,
    clip: tuple[float | None, float | None] = (0.0, 1.0),
) -> Cells:
    """Step of size eps along the sign of the loss gradient of a network, for its own label.

    The backward pass over its weights is array work on batches of rows. A row with
    a missing feature has no gradient and stays as it is.
    """
    if not isinstance(eps, Column):
        if eps <= 0:
            raise ValueError("the gradient step needs eps > 0")
        eps = F.lit(float(eps))

    @F.pandas_udf("array<double>")
    def signs(x: pd.Series) -> pd.Series:
        out = np.zeros((len(x), len(network.features)))
        rows = np.array([r is not None and np.isfinite(np.asarray(r, float)).all() for r in x], bool)
        if rows.any():
            out[rows] = network.steps(np.stack([np.asarray(r, float) for r in x[rows]]))
        return pd.Series(list(out))

    step = signs(F.array(*[_x(c) for c in network.features]))
    return {c: _clip(_x(c) + eps * step[i], *clip) for i, c in enumerate(network.features) if c in features}


def fit_surrogate(
    train: DataFrame,
    features: list[str],
    target: str = "target_label",
    max_iter: int = 50,
    benign: str = BENIGN_NAME,
) -> tuple[dict[str, float], float]:
    """A logistic regression of attack or not stands in for a detector that has no gradient."""
    attack = attack_flag(F.col(quote(target)), train.schema[target].dataType, benign)
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="v").transform(
        train.select(attack.cast("double").alias("y"), *[_x(c).alias(f"f{i}") for i, c in enumerate(features)])
    )
    model = LogisticRegression(featuresCol="v", labelCol="y", maxIter=max_iter, regParam=1e-4).fit(vectors)
    return dict(zip(features, model.coefficients.toArray().tolist())), float(model.intercept)


def perturb(df: DataFrame, cells: Cells, attack: str) -> DataFrame:
    """The table with changed features and an ``attack`` column."""
    cols = [cells[c].alias(c) if c in cells else F.col(quote(c)) for c in df.columns]
    return df.select(*cols, F.lit(attack).alias("attack"))


def stack_attacks(df: DataFrame, features: list[str], attacks: dict[str, Cells], clean: str | None = None) -> DataFrame:
    """All perturbed tables in one, from a single scan; ``clean`` names the unperturbed copy."""

    def version(name: str, cells: Cells) -> Column:
        return F.struct(F.lit(name).alias("attack"), *[cells.get(c, _x(c)).alias(f"__p_{c}") for c in features])

    versions = [version(clean, {})] if clean is not None else []
    versions += [version(n, c) for n, c in attacks.items()]
    rest = [quote(c) for c in df.columns if c not in features]
    wide = df.select(*rest, F.inline(F.array(*versions)))
    return wide.select(*rest, "attack", *[F.col(quote(f"__p_{c}")).alias(c) for c in features])


def sweep(df: DataFrame, epsilons: list[float] | None = None) -> DataFrame:
    """One copy of each row per strength, 0 included (the clean point)."""
    eps = [0.0, *(epsilons or DEFAULT_EPSILONS)]
    return df.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in eps])))


def sweep_linear(df: DataFrame, weights: dict[str, float], bias: float, epsilons: list[float] | None = None) -> DataFrame:
    """Gradient-step copies for every strength; strength 0 stays clean."""
    rows = sweep(df, epsilons)
    cells = fgsm_linear(weights, bias, F.col("epsilon"))
    moved = {c: F.when(F.col("epsilon") > 0, v).otherwise(_x(c)) for c, v in cells.items()}
    return rows.select(*[moved[c].alias(c) if c in moved else F.col(quote(c)) for c in rows.columns])


def robustness_curve(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy per strength (5 decimals), strength with 6 decimals."""
    return scored.groupBy(*keys, F.round("epsilon", 6).alias("epsilon")).agg(
        F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 5).alias("accuracy")
    )
