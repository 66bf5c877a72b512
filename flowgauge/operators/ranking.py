"""Exact order statistics without a global sort.

``select_ranks`` finds the key at given ranks per group. It narrows the key
range with histograms (map-side combined, a few thousand bins) until the rows
around each rank fit one sort, then ranks only those. Groups that hold most of
the rows, repeated keys and uneven key ranges all take more passes, never a
bigger task. The caller compares rows with the found keys, so the table itself
is never shuffled or sorted. Rows whose key is NULL, NaN or infinite have no
rank and are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.scalars import finite_or_null, is_floating, quote
from flowgauge.operators.small import hinted, pin_small

BINS = 4096
SORT_ROWS = 1_000_000
_BOUNDS = ["__klo", "__khi", "__tlo", "__thi"]


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _inside(base: DataFrame, cells: DataFrame, groups: list[str]) -> Column:
    conds = [_same(base[g], cells[f"__g_{g}"]) for g in groups]
    conds += [
        base["__k"].between(cells["__klo"], cells["__khi"]),
        base["__t"].between(cells["__tlo"], cells["__thi"]),
    ]
    return reduce(lambda a, b: a & b, conds)


def _prefixed(df: DataFrame, groups: list[str]) -> DataFrame:
    return df.select(*[F.col(g).alias(f"__g_{g}") for g in groups], *[c for c in df.columns if c not in groups])


def _range_aggs() -> list[Column]:
    return [
        F.min("__k").alias("__klo"),
        F.max("__k").alias("__khi"),
        F.min("__t").alias("__tlo"),
        F.max("__t").alias("__thi"),
        F.count(F.lit(1)).alias("__n"),
    ]


def _base(df: DataFrame, groups: list[str], key: Column, tie: Column) -> DataFrame:
    base = df.select(*groups, key.alias("__k"), tie.alias("__t"))
    if is_floating(base.schema["__k"].dataType):
        base = base.withColumn("__k", finite_or_null(F.col("__k")))
    return base.where("__k is not null")


def group_ranges(df: DataFrame, groups: list[str], key: Column, tie: Column) -> tuple[DataFrame, bool]:
    """Rows per group (``__n``) and the ranges of key and tie-breaker, pinned."""
    base = _base(df, groups, key, tie)
    return pin_small(base.groupBy(*groups).agg(*_range_aggs()))


def select_ranks(
    df: DataFrame,
    groups: list[str],
    key: Column,
    tie: Column,
    ranges: tuple[DataFrame, bool],
    targets: DataFrame,
    sort_rows: int = SORT_ROWS,
    bins: int = BINS,
) -> tuple[DataFrame, bool]:
    """Key and tie-breaker at each requested 1-based rank.

    ``ranges`` comes from ``group_ranges``; ``targets``, a few rows per group,
    holds (groups..., target, rank). The result, pinned, holds (groups...,
    target, cut_key, cut_tie) for every target of a known group; the cut is
    NULL where the rank is outside the group.
    """
    base = _base(df, groups, key, tie)
    t = hinted((_prefixed(targets.select(*groups, "target", "rank"), groups), ranges[1]))
    spans = ranges[0]
    cond = reduce(lambda a, b: a & b, [_same(spans[g], t[f"__g_{g}"]) for g in groups])
    cols = [*groups, "target", "rank", *_BOUNDS, "__n"]
    state = pin_small(spans.join(t, cond).select(*cols))

    inside = F.col("rank").between(1, F.col("__n"))
    flat = (F.col("__klo") == F.col("__khi")) & (F.col("__tlo") == F.col("__thi"))
    wide = inside & (F.col("__n") > sort_rows) & ~flat
    before = None
    while (left := _progress(state[0], wide, cols))[0]:
        # every pass parts the least key of a cell from the greatest one
        if left == before:
            raise RuntimeError("rank search makes no progress")
        before = left
        state = pin_small(_narrow(base, state, groups, wide, bins).select(*cols))

    rest = state[0].where(inside & ~flat)
    done = state[0].where(~inside | flat).select(
        *groups,
        "target",
        F.when(inside, F.col("__klo")).alias("cut_key"),
        F.when(inside, F.col("__tlo")).alias("cut_tie"),
    )
    if rest.isEmpty():
        return done, state[1]
    cells = _prefixed(rest.select(*groups, *_BOUNDS).distinct(), groups)
    cells_h = hinted((cells, state[1]))
    hit = base.join(cells_h, _inside(base, cells_h, groups)).select(*groups, "__k", "__t", *_BOUNDS)
    w = Window.partitionBy(*groups, *_BOUNDS).orderBy("__k", "__t")
    ranked = hit.withColumn("__r", F.row_number().over(w))
    want = _prefixed(rest.select(*groups, "target", "rank", *[F.col(b).alias(f"{b}_w") for b in _BOUNDS]), groups)
    want_h = hinted((want, state[1]))
    on = [_same(ranked[g], want_h[f"__g_{g}"]) for g in groups]
    on += [ranked[b] == want_h[f"{b}_w"] for b in _BOUNDS] + [ranked["__r"] == want_h["rank"]]
    found = ranked.join(want_h, reduce(lambda a, b: a & b, on)).select(
        *groups, "target", F.col("__k").alias("cut_key"), F.col("__t").alias("cut_tie")
    )
    return pin_small(found.unionByName(done))


def _progress(state: DataFrame, wide: Column, cols: list[str]) -> tuple:
    """Cells that are still too wide, and a checksum of the search state."""
    row = state.agg(F.count_if(wide).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("sum")).collect()[0]
    return row["n"], row["sum"]


def _distance(a: Column, b: Column) -> tuple[Column, Column]:
    """a - b as DOUBLE, exact for near whole numbers, and half of it; the difference may overflow, its half may not."""
    half = a.cast("double") / 2.0 - b.cast("double") / 2.0
    return F.coalesce(F.try_subtract(a, b).cast("double"), F.lit(float("inf"))), half


def _narrow(base: DataFrame, state: tuple[DataFrame, bool], groups: list[str], wide: Column, bins: int) -> DataFrame:
    """One histogram pass over the rows of every cell that is still too wide."""
    todo = state[0].where(wide)
    cells = _prefixed(todo.select(*groups, *_BOUNDS).distinct(), groups)
    cells_h = hinted((cells, state[1]))
    rows = base.join(cells_h, _inside(base, cells_h, groups))

    def place(v: str, lo: str, hi: str) -> Column:
        span, half_span = _distance(F.col(hi), F.col(lo))
        far, half_far = _distance(F.col(v), F.col(lo))
        share = F.when(span == F.lit(float("inf")), half_far / half_span).otherwise(far / span)
        return F.least(F.floor(share * F.lit(float(bins))), F.lit(bins - 1)).cast("int")

    slot = F.when(F.col("__klo") < F.col("__khi"), place("__k", "__klo", "__khi")).otherwise(
        place("__t", "__tlo", "__thi")
    )
    old = [F.col(b).alias(f"{b}_o") for b in _BOUNDS]
    hist = (
        rows.select(*groups, "__k", "__t", *old, slot.alias("__slot"))
        .groupBy(*groups, *[f"{b}_o" for b in _BOUNDS], "__slot")
        .agg(*_range_aggs())
    )
    w = Window.partitionBy(*groups, *[f"{b}_o" for b in _BOUNDS]).orderBy("__slot")
    cum = hist.withColumn("__upto", F.sum("__n").over(w)).withColumn("__before", F.col("__upto") - F.col("__n"))
    want = _prefixed(todo.select(*groups, "target", "rank", *[F.col(b).alias(f"{b}_w") for b in _BOUNDS]), groups)
    want_h = hinted((want, state[1]))
    on = [_same(cum[g], want_h[f"__g_{g}"]) for g in groups]
    on += [cum[f"{b}_o"] == want_h[f"{b}_w"] for b in _BOUNDS]
    on += [want_h["rank"] > cum["__before"], want_h["rank"] <= cum["__upto"]]
    stepped = cum.join(want_h, reduce(lambda a, b: a & b, on)).select(
        *groups, "target", (F.col("rank") - F.col("__before")).alias("rank"), *_BOUNDS, "__n"
    )
    return stepped.unionByName(state[0].where(~wide))


def beyond(key: Column, tie: Column, cut: Column) -> Column:
    """True when a row sorts after the cut; a NULL cut sorts before every row."""
    here = F.struct(key.alias("cut_key"), tie.alias("cut_tie"))
    return cut["cut_key"].isNull() | (here > F.struct(cut["cut_key"].alias("cut_key"), cut["cut_tie"].alias("cut_tie")))


def percentiles(
    df: DataFrame, columns: list[str], q: float, sort_rows: int = SORT_ROWS, bins: int = BINS
) -> dict[str, float | None]:
    """Exact interpolated percentile of numeric columns, ignoring missing values.

    One pass serves all columns; a whole column is never held in one task, as
    it would be inside the built-in exact percentile aggregate.
    """
    long = unpivot_numeric(df, columns)
    groups, key, tie = ["__c"], F.col("__v"), F.lit(0)
    ranges = group_ranges(long, groups, key, tie)
    counts = {r["__c"]: r["__n"] for r in ranges[0].collect()}
    pos = (F.col("__n") - 1).cast("double") * F.lit(float(q))
    lo_hi = F.array(
        F.struct(F.lit("lo").alias("target"), (F.floor(pos) + 1).alias("rank")),
        F.struct(F.lit("hi").alias("target"), (F.ceil(pos) + 1).alias("rank")),
    )
    targets = ranges[0].select("__c", F.inline(lo_hi))
    got, _ = select_ranks(long, groups, key, tie, ranges, targets, sort_rows, bins)
    found = {(r["__c"], r["target"]): r["cut_key"] for r in got.collect()}
    out: dict[str, float | None] = {}
    for c in columns:
        n = counts.get(c, 0)
        if not n:
            out[c] = None
            continue
        at = (n - 1) * q
        frac = at - int(at)
        low, high = found[(c, "lo")], found[(c, "hi")]
        step = (high - low) * frac
        out[c] = low if not frac else low + step if math.isfinite(step) else low * (1 - frac) + high * frac
    return out


def unpivot_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of the non-missing numeric cells."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("__c"), finite_or_null(F.col(quote(c)).cast("double")).alias("__v")) for c in columns]
    )
    return df.select(F.inline(cells)).where("__v is not null")
