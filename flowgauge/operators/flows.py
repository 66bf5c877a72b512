"""Bidirectional flows from a table of decoded packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE_MS = 120_000
ACTIVE_MS = 1_800_000
STATS = ("min", "mean", "stddev", "max")


def endpoint_key(df: DataFrame, src: list[str], dst: list[str], extra: list[str]) -> tuple[DataFrame, list[str]]:
    """Add the direction-free key of a packet: the two ends in order, and ``__fwd`` for low -> high."""
    a, b = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(src)]), F.struct(
        *[F.col(c).alias(f"p{i}") for i, c in enumerate(dst)]
    )
    fwd = a <= b
    lo, hi = F.when(fwd, a).otherwise(b), F.when(fwd, b).otherwise(a)
    return df.withColumn("__lo", lo).withColumn("__hi", hi).withColumn("__fwd", fwd), ["__lo", "__hi", *extra]


def cell_summaries(packets: DataFrame, keys: list[str], ts_ms: str, idle_ms: int) -> DataFrame:
    """Per (key, time cell): its session's start and the last times of earlier cells.

    A cell (``__cell``) is no wider than the idle timeout, so no session starts
    inside one except at its first packet. First and last times of cells, combined
    before the shuffle, thus tell all sessions of a key without sorting packets:
    a session starts at a cell whose first packet is later than the one before it
    by more than the timeout.
    """
    t, fwd = F.col(ts_ms), F.col("__fwd")
    cells = packets.groupBy(*keys, "__cell").agg(
        F.min(t).alias("__first"), F.max(t).alias("__l"), F.max(F.when(fwd, t)).alias("__lf"), F.max(F.when(~fwd, t)).alias("__lb")
    )
    along = Window.partitionBy(*keys).orderBy("__cell")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(
        *keys, "__cell", "__first", F.lag("__l").over(along).alias("__cp"), F.max("__lf").over(earlier).alias("__cf"), F.max("__lb").over(earlier).alias("__cb")
    )
    opens = F.col("__cp").isNull() | (F.col("__first") - F.col("__cp") > F.lit(idle_ms))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.last(F.when(opens, F.col("__first")), ignorenulls=True).over(upto)
    return carried.select(*keys, "__cell", "__cp", "__cf", "__cb", start.alias("__start"))


def mark_flows(
    packets: DataFrame,
    keys: list[str],
    ts_ms: str = "ts_ms",
    order: str = "pkt_id",
    idle_ms: int = IDLE_MS,
    active_ms: int = ACTIVE_MS,
    cell_ms: int | None = None,
) -> DataFrame:
    """Add ``__start`` (session start), ``__cut`` (active-timeout part) and times since earlier packets.

    A gap above the idle timeout starts a session; a session is cut every
    ``active_ms`` from its start. Work is per (key, time cell) of at most the idle
    timeout, with last packets and the session start of earlier cells joined in, so
    one busy pair of endpoints is spread over many tasks and packets are sorted once.
    """
    width = max(1, min(idle_ms, cell_ms or idle_ms // 2))
    t = F.col(ts_ms)
    rows = packets.withColumn("__cell", F.floor(t / F.lit(width)))
    part = [*keys, "__cell"]
    w = Window.partitionBy(*part).orderBy(ts_ms, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.join(cell_summaries(rows, keys, ts_ms, idle_ms), part)

    def last(side: Column, carried: str) -> Column:
        return F.coalesce(F.last(F.when(side, t), ignorenulls=True).over(before), F.col(carried))

    fwd = F.col("__fwd")
    seen = seen.withColumns(
        {"__prev": F.coalesce(F.lag(t).over(w), F.col("__cp")), "__prev_dir": F.when(fwd, last(fwd, "__cf")).otherwise(last(~fwd, "__cb"))}
    )

    def cut_of(at: Column) -> Column:
        return F.floor((at - F.col("__start")) / F.lit(active_ms))

    placed = seen.withColumn("__cut", cut_of(t))

    def gap(prev: str) -> Column:
        same = (F.col(prev) >= F.col("__start")) & (cut_of(F.col(prev)) == F.col("__cut"))
        return F.when(same, t - F.col(prev))

    return placed.withColumn("__gap", gap("__prev")).withColumn("__gap_dir", gap("__prev_dir"))


def _stats(value: Column, prefix: str, suffix: str) -> list[Column]:
    return [
        F.min(value).alias(f"{prefix}_min_{suffix}"),
        F.avg(value).alias(f"{prefix}_mean_{suffix}"),
        F.coalesce(F.stddev_samp(value), F.when(F.count(value) > 0, F.lit(0.0))).alias(f"{prefix}_stddev_{suffix}"),
        F.max(value).alias(f"{prefix}_max_{suffix}"),
    ]


def assemble_flows(
    packets: DataFrame,
    src: list[str],
    dst: list[str],
    extra: list[str] | None = None,
    flags: list[str] | None = None,
    ts_ms: str = "ts_ms",
    size: str = "size",
    order: str = "pkt_id",
    idle_ms: int = IDLE_MS,
    active_ms: int = ACTIVE_MS,
    cell_ms: int | None = None,
) -> DataFrame:
    """One row per flow with sizes, inter-arrival times and flag counts, both ways and per direction.

    ``src`` and ``dst`` list the columns of an endpoint (address, port), ``extra``
    the rest of the key (protocol) and ``flags`` boolean columns to count.
    The direction src2dst is that of the first packet.
    """
    extra, flags = extra or [], flags or []
    keyed, keys = endpoint_key(packets, src, dst, extra)
    marked = mark_flows(keyed, keys, ts_ms, order, idle_ms, active_ms, cell_ms)
    t, n, fwd = F.col(ts_ms), F.col(size), F.col("__fwd")
    aggs = [
        F.min_by(fwd, F.struct(ts_ms, order)).alias("__first_fwd"),
        F.min(order).alias("flow_id"),
    ]
    for name, cond in (("bidirectional", F.lit(True)), ("up", fwd), ("down", ~fwd)):
        gap = F.col("__gap") if name == "bidirectional" else F.when(cond, F.col("__gap_dir"))
        ts, ps = F.when(cond, t), F.when(cond, n)
        aggs += [
            F.min(ts).alias(f"{name}_first_seen_ms"),
            F.max(ts).alias(f"{name}_last_seen_ms"),
            (F.max(ts) - F.min(ts)).alias(f"{name}_duration_ms"),
            F.count(ps).alias(f"{name}_packets"),
            F.coalesce(F.sum(ps), F.lit(0)).alias(f"{name}_bytes"),
            *_stats(ps, name, "ps"),
            *_stats(gap, name, "piat_ms"),
            *[F.count_if(cond & F.col(f)).alias(f"{name}_{f}_packets") for f in flags],
        ]
    grouped = marked.groupBy(*keys, "__start", "__cut").agg(*aggs)
    first = F.col("__first_fwd")
    ends = [
        F.when(first, F.col(f"__lo.p{i}")).otherwise(F.col(f"__hi.p{i}")).alias(c) for i, c in enumerate(src)
    ] + [F.when(first, F.col(f"__hi.p{i}")).otherwise(F.col(f"__lo.p{i}")).alias(c) for i, c in enumerate(dst)]
    names = [c for c in grouped.columns if c.startswith("up_")]
    swapped = []
    for side, (mine, other) in (("src2dst", ("up_", "down_")), ("dst2src", ("down_", "up_"))):
        for c in names:
            stem = c[len("up_") :]
            swapped.append(F.when(first, F.col(mine + stem)).otherwise(F.col(other + stem)).alias(f"{side}_{stem}"))
    both = [c for c in grouped.columns if c.startswith("bidirectional_")]
    return grouped.select("flow_id", *ends, *extra, *both, *swapped)
