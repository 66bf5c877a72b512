"""Projection, row removal and type repair."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.functions.scalars import finite_or_null, is_floating, is_numeric, quote
from flowgauge.operators.labeling import CATEGORY, LABELS

log = logging.getLogger(__name__)


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Stack tables by name; missing columns become NULL, int and double widen.

    A column that is text in one table and a number in another is kept as text.
    """
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for f in t.schema.fields:
            kind = "number" if is_numeric(f.dataType) else f.dataType.simpleString()
            kinds.setdefault(f.name, set()).add(kind)
    mixed = {name for name, seen in kinds.items() if len(seen - {"void"}) > 1}
    aligned = [t.select(*[F.col(quote(c)).cast("string").alias(c) if c in mixed else F.col(quote(c)) for c in t.columns]) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def feature_mapping(df: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep the mapped columns that exist, renamed, plus labels and ``keep``."""
    kept = [c for c in (*keep, *LABELS) if c in df.columns]
    picked = [F.col(quote(a)).alias(b) for a, b in mapping.items() if a in df.columns and a not in kept]
    log.info("feature mapping drops %d columns", len(df.columns) - len(picked) - len(kept))
    return df.select(*[quote(c) for c in kept if c not in LABELS], *picked, *[c for c in kept if c in LABELS])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise KeyError(f"columns not found: {unknown}")
    return df.drop(*columns)


def remove_class(df: DataFrame, classes: list[str], column: str = CATEGORY) -> DataFrame:
    """Drop rows of the listed classes; rows without a class stay."""
    if not classes or column not in df.columns:
        log.warning("class removal skipped")
        return df
    return df.where(~F.coalesce(F.col(column).isin(*classes), F.lit(False)))


def remove_incomplete_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a missing or infinite cell in any column, labels included."""

    def present(f: T.StructField):
        c = F.col(quote(f.name))
        return (finite_or_null(c) if is_floating(f.dataType) else c).isNotNull()

    return df.where(reduce(lambda a, b: a & b, [present(f) for f in df.schema.fields]))


def cast_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to DOUBLE; text that is not a number becomes NULL, unknown columns warn."""
    known = [c for c in columns if c in df.columns]
    for c in set(columns) - set(known):
        log.warning("column %r not found for casting to numeric", c)
    return df.select(
        *[F.col(quote(c)).try_cast("double").alias(c) if c in known else F.col(quote(c)) for c in df.columns]
    )


def auto_columns(df: DataFrame, method: str, configured: list[str] | None = None) -> list[str]:
    """Columns a step works on when none are named; labels are never touched."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = {
        "min_max": numeric,
        "standard": numeric,
        "impute_mean": numeric,
        "impute_median": numeric,
        "label": text,
        "one_hot": text,
        "one_hot_vector": text,
        "impute_most_frequent": df.columns,
    }.get(method, configured or [])
    return [c for c in chosen if c not in LABELS]


def single_value_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one distinct present value: min equals max, one pass for all."""
    if not columns:
        return []

    def value(c: str):
        v = F.col(quote(c))
        return F.when(F.isnan(v), None).otherwise(v) if is_floating(df.schema[c].dataType) else v

    row = df.agg(
        *[F.min(value(c)).eqNullSafe(F.max(value(c))).alias(f"c{i}") for i, c in enumerate(columns)]
    ).collect()[0]
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def drop_single_value_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*single_value_columns(df, columns))


def drop_duplicate_rows(df: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Distinct rows over all columns; the copy with the smallest row id survives.

    The aggregate combines copies before the shuffle, so a group of copies that
    holds most of the table reaches the reducer as one row per map task.
    """
    keys = [f for f in df.schema.fields if f.name != row_id]
    cells = [
        F.when(F.isnan(quote(f.name)), None).otherwise(F.col(quote(f.name))).alias(f.name)
        if is_floating(f.dataType)
        else F.col(quote(f.name))
        for f in keys
    ]
    if row_id is None or row_id not in df.columns:
        return df.select(*cells).distinct()
    grouped = df.select(row_id, *cells).groupBy(*[quote(f.name) for f in keys])
    return grouped.agg(F.min(row_id).alias(row_id)).select(*[quote(c) for c in df.columns])


def common_columns(tables: dict[str, DataFrame], extra: tuple[str, ...] = ()) -> list[str]:
    """Sorted features all tables share, followed by labels and target."""
    shared = set.intersection(*[set(t.columns) for t in tables.values()])
    tail = list(dict.fromkeys([c for c in (*LABELS, *extra) if c in shared]))
    return sorted(shared - set(tail)) + tail


def align_tables(tables: dict[str, DataFrame], extra: tuple[str, ...] = ()) -> DataFrame:
    """One long table of all datasets over their common columns, keyed by ``dataset``."""
    cols = common_columns(tables, extra)
    parts = [t.select(F.lit(name).alias("dataset"), *[quote(c) for c in cols]) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
