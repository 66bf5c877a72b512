"""Fit/transform steps.

A fit is one aggregate over all columns; the parameters are few numbers that
are inlined in the transform, so the same transform runs on batch tables and
on streams. Code tables too large to inline stay tables.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.functions.scalars import finite_or_null, is_floating, is_numeric, quote
from flowgauge.operators import clean
from flowgauge.operators.ranking import percentiles
from flowgauge.operators.small import SMALL_ROWS, attach, pin_small
from flowgauge.session import durable

log = logging.getLogger(__name__)

MISSING = "MISSING"
MAX_ONE_HOT = 1000


@dataclass
class Fitted:
    """A fitted step: a method name, JSON parameters and, for long code lists, tables."""

    method: str
    params: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return _TRANSFORMS[self.method](df, self)


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(quote(c)) for c in df.columns])


def _present(df: DataFrame, c: str) -> Column:
    col = F.col(quote(c))
    return finite_or_null(col) if is_floating(df.schema[c].dataType) else col


# ---- scaling -------------------------------------------------------------


# Fits that are aggregates of single columns: (aggregates of a column, parameter from their values).
_AGGREGATES: dict[str, tuple[Callable[[Column], list[Column]], Callable[[list], object]]] = {
    "min_max": (lambda v: [F.min(v).cast("double"), F.max(v).cast("double")], list),
    "standard": (lambda v: [F.avg(v.cast("double")), F.stddev_pop(v.cast("double"))], list),
    "impute_mean": (lambda v: [F.avg(v)], lambda r: r[0]),
}


def fit_together(df: DataFrame, jobs: list[tuple[str, list[str]]]) -> list[Fitted]:
    """Fit several aggregate steps in one pass over the table."""
    aggs = [a for method, columns in jobs for c in columns for a in _AGGREGATES[method][0](_present(df, c))]
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).collect()[0] if aggs else ()
    out, at = [], 0
    for method, columns in jobs:
        params = {}
        size = len(_AGGREGATES[method][0](F.lit(0)))
        for c in columns:
            params[c] = _AGGREGATES[method][1](list(row[at : at + size]))
            at += size
        out.append(Fitted("impute" if method == "impute_mean" else method, params))
    return out


def fit_min_max(df: DataFrame, columns: list[str]) -> Fitted:
    return fit_together(df, [("min_max", columns)])[0]


def _min_max(df: DataFrame, f: Fitted) -> DataFrame:
    new = {}
    for c, (lo, hi) in f.params.items():
        if lo is None:
            new[c] = F.lit(None).cast("double")
            continue
        new[c] = (_present(df, c).cast("double") - F.lit(lo)) / F.lit((hi - lo) or 1.0)
    return _replace(df, new)


def fit_standard(df: DataFrame, columns: list[str]) -> Fitted:
    return fit_together(df, [("standard", columns)])[0]


def _standard(df: DataFrame, f: Fitted) -> DataFrame:
    new = {}
    for c, (mean, std) in f.params.items():
        if mean is None:
            new[c] = F.lit(None).cast("double")
            continue
        new[c] = (_present(df, c).cast("double") - F.lit(mean)) / F.lit(std or 1.0)
    return _replace(df, new)


# ---- encoding ------------------------------------------------------------


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(quote(c)).cast("string"), F.lit(MISSING))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of all text columns in one pass; NULL values are kept."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(quote(c)).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(cells)).distinct()


def dense_codes(values: DataFrame) -> DataFrame:
    """0-based rank of each value inside its column, for lists too long for one task.

    Values are range partitioned and sorted, stored once, and numbered by
    position in the partition plus the sizes of the partitions before it.
    """
    ranged = values.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    stored = durable(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part, idx = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored.select("column", "value", part.alias("__part"), idx.alias("__idx"))
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, offset))
        offset += sizes[p]
    offsets = values.sparkSession.createDataFrame(rows, "__part bigint, __off bigint")
    numbered = placed.join(F.broadcast(offsets), "__part").select("column", "value", (F.col("__idx") + F.col("__off")).alias("pos"))
    first = {r["column"]: r["p"] for r in numbered.groupBy("column").agg(F.min("pos").alias("p")).collect()}
    starts = F.create_map(*[x for k, v in first.items() for x in (F.lit(k), F.lit(v))])
    return numbered.select("column", "value", (F.col("pos") - starts[F.col("column")]).alias("code"))


def fit_label(df: DataFrame, columns: list[str], max_inline: int = SMALL_ROWS) -> Fitted:
    """Codes 0..n-1 in text order per column; a missing value is the text MISSING."""
    values = distinct_values(df, columns).select("column", F.coalesce("value", F.lit(MISSING)).alias("value")).distinct()
    pinned, small = pin_small(values, max_inline)
    if small:
        found: dict[str, list[str]] = {c: [] for c in columns}
        for r in pinned.collect():
            found[r["column"]].append(r["value"])
        return Fitted("label", {c: sorted(v) for c, v in found.items()})
    return Fitted("label", {c: None for c in columns}, {"codes": durable(dense_codes(pinned))})


def _label(df: DataFrame, f: Fitted) -> DataFrame:
    out = df
    for c, values in f.params.items():
        if values is None:
            codes = f.tables["codes"].where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias("__code"))
            pinned = (codes, False)
        else:
            rows = [(v, i) for i, v in enumerate(values)]
            pinned = (df.sparkSession.createDataFrame(rows, "__v string, __code bigint"), True)
        keyed = out.withColumn("__v", _text(df, c))
        out = attach(keyed, pinned, ["__v"]).withColumn(c, F.col("__code")).drop("__v", "__code")
    return out.select(*[quote(c) for c in df.columns])


def _slots(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text keys of one-hot slots: values in text order, then NULL, which no value can spell."""
    return _replace(df, {c: F.coalesce(F.concat(F.lit("v"), F.col(quote(c)).cast("string")), F.lit("x")) for c in columns})


def fit_one_hot(
    df: DataFrame, columns: list[str], output: str = "columns", max_categories: int = MAX_ONE_HOT
) -> Fitted:
    """One 0/1 slot per value of each column, NULL being a value; unseen values are all zeros.

    ``output="columns"`` gives a column per value and refuses columns with more
    than ``max_categories`` values; ``output="vector"`` gives one sparse vector per
    column, ``<column>_onehot``, for lists of any length. The form never depends on
    the data.
    """
    if output == "vector":
        codes = fit_label(_slots(df.select(*[quote(c) for c in columns]), columns), columns)
        sizes = {c: len(v) for c, v in codes.params.items() if v is not None}
        if codes.tables:
            counted = codes.tables["codes"].groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
            sizes = {r["column"]: r["n"] for r in counted}
        return Fitted("one_hot", {"inline": {}, "sparse": sizes, "codes": codes.params}, codes.tables)
    if output != "columns":
        raise ValueError(f"unknown one-hot output {output!r}")
    values = distinct_values(df, columns)
    counts = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    long = sorted(c for c, n in counts.items() if n > max_categories)
    if long:
        raise ValueError(f"more than {max_categories} values in {long}; ask for output='vector'")
    found: dict[str, list] = {c: [] for c in columns}
    for r in values.collect():
        found[r["column"]].append(r["value"])
    inline = {c: sorted(v, key=lambda x: (x is None, x or "")) for c, v in found.items()}
    return Fitted("one_hot", {"inline": inline, "sparse": {}})


def _one_hot(df: DataFrame, f: Fitted) -> DataFrame:
    inline, sparse = f.params["inline"], f.params["sparse"]
    flags = [
        F.coalesce(F.col(quote(c)).cast("string").eqNullSafe(F.lit(v)), F.lit(False)).cast("double").alias(f"{c}_{'nan' if v is None else v}")
        for c, values in inline.items()
        for v in values
    ]
    kept = [F.col(quote(c)) for c in df.columns if c not in inline]
    out = df.select(*kept, *flags)
    if sparse:
        out = _label(_slots(out, list(sparse)), Fitted("label", {c: f.params["codes"][c] for c in sparse}, f.tables))
        for c, n in sparse.items():
            idx = out.withColumn("__i", F.coalesce(F.col(quote(c)).cast("double"), F.lit(float(n))))
            # index n means "unknown"; it is the dropped last slot, so its vector is all zeros
            enc = OneHotEncoder(inputCol="__i", outputCol=f"{c}_onehot", dropLast=True)
            widest = df.sparkSession.range(1).select(F.lit(float(n)).alias("__i"))
            out = enc.fit(widest).transform(idx).drop("__i", c)
    return out


# ---- imputation ----------------------------------------------------------


def fit_impute_mean(df: DataFrame, columns: list[str]) -> Fitted:
    return fit_together(df, [("impute_mean", columns)])[0]


def fit_impute_median(df: DataFrame, columns: list[str], **limits: int) -> Fitted:
    return Fitted("impute", percentiles(df, columns, 0.5, **limits))


def fit_impute_most_frequent(df: DataFrame, columns: list[str]) -> Fitted:
    """Most frequent value, the smallest on ties.

    Values are counted by (column, value), combined before the shuffle; the
    winner per column is then a plain aggregate.
    """
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    whole = [c for c in numeric if isinstance(df.schema[c].dataType, T.IntegralType)]
    rest = [c for c in numeric if c not in whole]
    other = [c for c in columns if c not in numeric]
    out: dict = {}
    # whole numbers stay whole: beyond 2^53 a DOUBLE would change them
    for group, kind in ((whole, "bigint"), (rest, "double"), (other, "string")):
        if not group:
            continue
        cells = F.array(*[F.struct(F.lit(c).alias("c"), _present(df, c).cast(kind).alias("v")) for c in group])
        counted = df.select(F.inline(cells)).where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counted.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b"))
        out.update({r["c"]: r["b"]["v"] for r in best.collect()})
    return Fitted("impute", {c: out.get(c) for c in columns})


def _impute(df: DataFrame, f: Fitted) -> DataFrame:
    new = {}
    for c, v in f.params.items():
        kind = df.schema[c].dataType
        if v is None:
            new[c] = _present(df, c)
        elif is_numeric(kind):
            whole = not is_floating(kind) and (isinstance(v, int) or float(v).is_integer())
            fill = F.lit(int(v) if whole else float(v))
            new[c] = F.coalesce(_present(df, c), fill.cast(kind) if whole else fill)
        else:
            new[c] = F.coalesce(F.col(quote(c)), F.lit(v).cast(kind))
    return _replace(df, new)


_TRANSFORMS: dict[str, Callable[[DataFrame, Fitted], DataFrame]] = {
    "min_max": _min_max,
    "standard": _standard,
    "label": _label,
    "one_hot": _one_hot,
    "impute": _impute,
    "remove_duplicate_rows": lambda df, f: clean.drop_duplicate_rows(df, f.params["row_id"]),
    "remove_nan_rows": lambda df, f: clean.remove_incomplete_rows(df),
    "drop_columns": lambda df, f: clean.drop_columns(df, f.params["columns"]),
    "remove_class": lambda df, f: clean.remove_class(df, f.params["classes"]),
    "cast_numeric": lambda df, f: clean.cast_numeric(df, f.params["columns"]),
    "none": lambda df, f: df,
}

# ---- step lists ----------------------------------------------------------

ROW_STEPS = {"remove_duplicate_rows", "remove_nan_rows", "remove_class"}
NEEDS_COLUMNS = {"min_max", "standard", "label", "one_hot", "one_hot_vector", "impute_mean", "impute_median", "impute_most_frequent"}


@dataclass(frozen=True)
class Step:
    """One preprocessing step; ``columns=None`` chooses columns by type."""

    method: str
    columns: tuple[str, ...] | None = None


_FITS: dict[str, Callable[[DataFrame, list[str]], Fitted]] = {
    "min_max": fit_min_max,
    "standard": fit_standard,
    "label": fit_label,
    "one_hot": fit_one_hot,
    "one_hot_vector": lambda df, cols: fit_one_hot(df, cols, "vector"),
    "impute_mean": fit_impute_mean,
    "impute_median": fit_impute_median,
    "impute_most_frequent": fit_impute_most_frequent,
    "remove_single_value_columns": lambda df, cols: Fitted(
        "drop_columns", {"columns": clean.single_value_columns(df, cols)}
    ),
    "drop_columns": lambda df, cols: Fitted("drop_columns", {"columns": cols}),
    "remove_rows": lambda df, cols: Fitted("drop_columns", {"columns": cols}),
    "remove_class": lambda df, cols: Fitted("remove_class", {"classes": cols}),
    "cast_numeric": lambda df, cols: Fitted("cast_numeric", {"columns": cols}),
    "none": lambda df, cols: Fitted("none", {}),
}


def step_columns(df: DataFrame, step: Step, row_id: str = "row_id") -> list[str]:
    cols = list(step.columns) if step.columns is not None else clean.auto_columns(df, step.method)
    return [c for c in cols if c != row_id and c not in clean.LABELS]


def fit_step(df: DataFrame, step: Step, row_id: str = "row_id") -> Fitted:
    if step.method == "remove_duplicate_rows":
        return Fitted(step.method, {"row_id": row_id})
    if step.method == "remove_nan_rows":
        return Fitted(step.method, {})
    if step.method not in _FITS:
        raise ValueError(f"unknown preprocessing method {step.method!r}")
    cols = step_columns(df, step, row_id)
    if not cols and step.method in NEEDS_COLUMNS:
        log.warning("step %s finds no columns and is skipped", step.method)
        return Fitted("none", {})
    return _FITS[step.method](df, cols)


def fit_next(df: DataFrame, steps: list[Step], row_id: str = "row_id") -> list[Fitted]:
    """Fit the first of the steps, together with those behind it that aggregate other columns of the same table."""
    jobs: list[tuple[str, list[str]]] = []
    touched: set[str] = set()
    for step in steps:
        columns = step_columns(df, step, row_id) if step.method in _AGGREGATES else []
        if not columns or touched & set(columns) or not set(columns) <= set(df.columns):
            break
        jobs.append((step.method, columns))
        touched |= set(columns)
    return fit_together(df, jobs) if len(jobs) > 1 else [fit_step(df, steps[0], row_id)]


@dataclass
class FittedChain:
    steps: list[Fitted]

    def transform(self, df: DataFrame) -> DataFrame:
        for f in self.steps:
            df = f.transform(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, f.method, json.dumps(f.params)) for i, f in enumerate(self.steps)]
        spark.createDataFrame(rows, "ord int, method string, params string").coalesce(1).write.mode("overwrite").json(f"{path}/steps")
        for i, f in enumerate(self.steps):
            for name, table in f.tables.items():
                table.write.mode("overwrite").parquet(f"{path}/table-{i}-{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedChain":
        rows = spark.read.schema("ord int, method string, params string").json(f"{path}/steps").orderBy("ord").collect()
        steps = []
        for r in rows:
            params = json.loads(r["params"])
            long_codes = r["method"] in ("label", "one_hot") and any(
                v is None for v in (params.get("codes") or params).values()
            )
            tables = {"codes": spark.read.parquet(f"{path}/table-{r['ord']}-codes")} if long_codes else {}
            steps.append(Fitted(r["method"], params, tables))
        return FittedChain(steps)


def fit_chain(df: DataFrame, steps: list[Step], row_id: str = "row_id", fit_on: Column | None = None) -> FittedChain:
    """Fit steps in order, each on the output of the ones before.

    ``fit_on`` restricts the rows parameters are learned from (the training
    split); by default all rows count.
    """
    done: list[Fitted] = []
    current = df if fit_on is None else df.where(fit_on)
    while len(done) < len(steps):
        for fitted in fit_next(current, steps[len(done) :], row_id):
            current = fitted.transform(current)
            done.append(fitted)
    return FittedChain(done)
