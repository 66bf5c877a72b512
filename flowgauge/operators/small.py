"""Broadcast only what was counted to be small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.session import durable

SMALL_ROWS = 50_000
SMALL_BYTES = 64 << 20


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a derived table once.

    Up to ``max_rows`` rows and ``SMALL_BYTES`` bytes come back as a local relation
    that is safe to broadcast; a larger table is written to the shared folder instead and must
    be joined by shuffle.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= SMALL_BYTES:
        return df.sparkSession.createDataFrame(head, df.schema), True
    return durable(df), False


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on keys where NULL matches NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def hinted(pinned: tuple[DataFrame, bool]) -> DataFrame:
    frame, small = pinned
    return F.broadcast(frame) if small else frame


def attach(df: DataFrame, small: DataFrame | tuple[DataFrame, bool], keys: list[str], how: str = "left") -> DataFrame:
    """Join a lookup table on null-safe keys; broadcast only if its size was checked."""
    pinned = small if isinstance(small, tuple) else pin_small(small)
    frame, ok = pinned
    renamed = frame.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in frame.columns])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = df.join(F.broadcast(renamed) if ok else renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys])
