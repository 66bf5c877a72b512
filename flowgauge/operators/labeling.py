"""Row labels by file, by column and by time window x endpoint."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions.scalars import quote
from flowgauge.operators.small import SMALL_ROWS, attach, pin_small

CATEGORY = "attack_category"
TARGET = "target_label"
LABELS = [CATEGORY, TARGET]
DEFAULT_LABEL = "BENIGN"
INLINE_WINDOWS = 64
INLINE_MAPPING = 64
#: Widths of slots as powers of two of a microsecond: about 1 s, 67 s, 72 min, 3 days, 204 days and 36 years.
WIDTHS = (20, 26, 32, 38, 44, 50)


def label_static(df: DataFrame, attack_type: str, is_benign: bool | None = None) -> DataFrame:
    """Give every row of a file one class; without a flag, 'benign' in any case is benign."""
    benign = attack_type.lower() == "benign" if is_benign is None else is_benign
    return df.withColumn(CATEGORY, F.lit(attack_type)).withColumn(TARGET, F.lit(0 if benign else 1))


def label_static_column(df: DataFrame, column: str) -> DataFrame:
    """The same rule where the class of a row is that of the file it came from."""
    c = F.col(quote(column))
    return df.withColumn(CATEGORY, c).withColumn(TARGET, F.when(F.lower(c) == "benign", 0).otherwise(1))


def label_from_column(
    df: DataFrame, column: str, benign: list[str], mapping: dict[str, str] | None = None, drop: bool = False
) -> DataFrame:
    """Class from a label column.

    The class is the mapped value; benign is decided on the trimmed value before
    mapping, and a missing label counts as an attack.
    """
    if column not in df.columns:
        raise ValueError(f"label column {column!r} not found")
    raw = F.trim(F.col(quote(column)).cast("string"))
    target = F.when(raw.isin(*benign), 0).otherwise(1)
    mapping = mapping or {}
    if len(mapping) <= INLINE_MAPPING:
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())]) if mapping else None
        named = raw if table is None else F.coalesce(table[raw], raw)
        out = df.withColumn(TARGET, target).withColumn(CATEGORY, named)
    else:
        names = df.sparkSession.createDataFrame(list(mapping.items()), "__raw string, __named string")
        keyed = df.withColumn(TARGET, target).withColumn("__raw", raw)
        out = attach(keyed, names, ["__raw"]).withColumn(CATEGORY, F.coalesce("__named", "__raw"))
        out = out.drop("__raw", "__named")
    if drop and column not in LABELS:
        out = out.drop(column)
    return out.select(*[quote(c) for c in out.columns if c not in LABELS], CATEGORY, TARGET)


@dataclass(frozen=True)
class TimeWindow:
    label: str
    start: str | None = None
    end: str | None = None
    src: tuple = ()
    dst: tuple = ()
    default: bool = False


def _utc_micros(text: str) -> int:
    at = datetime.fromisoformat(text)
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    delta = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def default_label(windows: list[TimeWindow]) -> str:
    """Label of rows no window matches: the last default window, else BENIGN."""
    return next((w.label for w in reversed(windows) if w.default), DEFAULT_LABEL)


def _usable(windows: list[TimeWindow]) -> list[TimeWindow]:
    return [w for w in windows if not w.default and w.start and w.end]


def label_time_windows(df: DataFrame, windows: list[TimeWindow], ts: str, src: str, dst: str, out: str = "label") -> DataFrame:
    """Label by the last window that holds the start time and an endpoint pair.

    A window matches in both directions and an empty endpoint list matches any;
    endpoints are compared as text, whatever their types. A few windows become one
    CASE expression, longer lists go through the interval cover; both work on
    tables and on streams and give the same labels.
    """
    usable = _usable(windows)
    if len(usable) > INLINE_WINDOWS:
        return label_by_cover(df, windows_frame(df.sparkSession, windows), ts, src, dst, default_label(windows), out)
    t, s, d = F.col(ts).cast("timestamp"), F.col(src).cast("string"), F.col(dst).cast("string")

    def member(c: Column, values: tuple) -> Column | None:
        return c.isin(*map(str, values)) if values else None

    def both(*conds: Column | None) -> Column:
        return reduce(lambda a, b: a & b, [c for c in conds if c is not None], F.lit(True))

    case: Column | None = None
    for w in reversed(usable):
        during = t.between(F.timestamp_micros(F.lit(_utc_micros(w.start))), F.timestamp_micros(F.lit(_utc_micros(w.end))))
        ends = both(member(s, w.src), member(d, w.dst)) | both(member(s, w.dst), member(d, w.src))
        hit = during & ends
        case = F.when(hit, w.label) if case is None else case.when(hit, w.label)
    fallback = F.lit(default_label(windows))
    return df.withColumn(out, fallback if case is None else case.otherwise(fallback))


def windows_frame(spark: SparkSession, windows: list[TimeWindow]) -> DataFrame:
    """Windows as a table: ord, label, start_us, end_us, src, dst (endpoints as text)."""
    rows = [
        (i, w.label, _utc_micros(w.start), _utc_micros(w.end), [str(x) for x in w.src], [str(x) for x in w.dst])
        for i, w in enumerate(windows)
        if w in _usable(windows)
    ]
    return spark.createDataFrame(
        rows, "ord int, label string, start_us bigint, end_us bigint, src array<string>, dst array<string>"
    )


# ---- long lists of windows -------------------------------------------------


def interval_cover(windows: DataFrame) -> DataFrame:
    """Cut each window into aligned slots: a row per (window, ``__width``, ``__slot``), with ``__whole``.

    Slots of a width are ``1 << bits`` microseconds wide and start at multiples of
    that; the next width has 64 times as many. A window takes the widest slots that
    are no longer than itself: at most 65 of them, whatever its length (beyond 36
    years, one per 36 years). The first and the last may reach over its ends; those
    that do not are ``__whole``.
    """
    length = F.col("end_us") - F.col("start_us")
    width = F.lit(0)
    for k, bits in enumerate(WIDTHS):
        width = F.when(length >= (1 << bits), k).otherwise(width)
    bits = F.element_at(F.array(*map(F.lit, WIDTHS)), F.col("__width") + 1)
    sized = windows.where("start_us <= end_us").withColumn("__width", width).withColumn("__bits", bits)

    def slot(us: str) -> Column:
        return F.expr(f"shiftright({us}, __bits)")

    cut = sized.withColumn("__slot", F.explode(F.sequence(slot("start_us"), slot("end_us"))))
    first, last = F.expr("shiftleft(__slot, __bits)"), F.expr("shiftleft(__slot + 1, __bits) - 1")
    return cut.withColumn("__whole", (first >= F.col("start_us")) & (last <= F.col("end_us"))).drop("__bits")


def cover_lists(windows: DataFrame) -> DataFrame:
    """(``__width``, ``__slot``, ``__end``, ``__ws``): the windows to try for a slot and one endpoint.

    A window is listed under each endpoint of its first list that names any, or
    under null if it names none, together with what the other end must be. Of
    windows that fill a slot under one endpoint and ask the same of the other end
    only the last can decide, so only it is listed.
    """
    named = F.when(F.size("src") > 0, F.array_distinct("src")).when(F.size("dst") > 0, F.array_distinct("dst"))
    keyed = windows.select(
        "ord",
        "label",
        "start_us",
        "end_us",
        F.explode(F.coalesce(named, F.array(F.lit(None).cast("string")))).alias("__end"),
        F.when(F.size("src") > 0, F.col("dst")).otherwise(F.array().cast("array<string>")).alias("other"),
    )
    cut = interval_cover(keyed)
    entry = F.struct("ord", "label", "start_us", "end_us", "other")
    # a window that does not fill its slot stays by itself
    alone = F.when(~F.col("__whole"), F.col("ord")).otherwise(-1)
    last = cut.groupBy("__width", "__slot", "__end", "other", alone.alias("__alone")).agg(F.max_by(entry, "ord").alias("w"))
    return last.groupBy("__width", "__slot", "__end").agg(F.collect_list("w").alias("__ws"))


def _last_hit(other: str | None) -> Column:
    """The last window of a list that holds the row's time and, where it asks for one, its other end."""

    def fits(w: Column) -> Column:
        during = F.col("__us").between(w["start_us"], w["end_us"])
        if other is None:
            return during
        return during & ((F.size(w["other"]) == 0) | F.coalesce(F.array_contains(w["other"], F.col(other)), F.lit(False)))

    return F.array_max(F.transform(F.filter("__ws", fits), lambda w: F.struct(w["ord"].alias("ord"), w["label"].alias("label"))))


def label_by_cover(
    df: DataFrame,
    windows: DataFrame,
    ts: str,
    src: str,
    dst: str,
    default: str = DEFAULT_LABEL,
    out: str = "label",
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """The same rule for any list of windows, see ``windows_frame`` for its columns.

    A row looks up the slot of its time under both of its endpoints and under none,
    once per width that the cover has, and tries only the windows listed there. Rows
    are never multiplied nor grouped, so they need no id and may be a stream. The
    lists of a width are broadcast if counted to be small (``max_rows``); otherwise
    they are joined by shuffle, on slot and endpoint.
    """
    lists, small = pin_small(cover_lists(windows), max_rows)
    kinds = lists.select("__width", F.col("__end").isNull().alias("free")).distinct().collect()
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"__us": us, "__src": F.col(src).cast("string"), "__dst": F.col(dst).cast("string")})
    lookups = []
    for width, free in sorted(kinds):
        part = lists.where((F.col("__width") == width) & (F.col("__end").isNull() if free else F.col("__end").isNotNull()))
        part = part.select("__slot", "__end", "__ws")
        part, fits = (part, True) if small else pin_small(part, max_rows)
        part = F.broadcast(part) if fits else part
        lookups += [(width, part, None, None)] if free else [(width, part, "__src", "__dst"), (width, part, "__dst", "__src")]
    best = []
    for i, (width, part, end, other) in enumerate(lookups):
        named = part.select(F.col("__slot").alias("__k"), F.col("__end").alias("__e"), "__ws")
        cond = F.shiftright("__us", WIDTHS[width]) == F.col("__k")
        rows = rows.join(named, cond if end is None else cond & (F.col(end) == F.col("__e")), "left")
        rows = rows.withColumn(f"__b{i}", _last_hit(other)).drop("__k", "__e", "__ws")
        best.append(F.col(f"__b{i}"))
    last = F.array_max(F.array(*best))["label"] if best else F.lit(None).cast("string")
    return rows.select(*[quote(c) for c in df.columns if c != out], F.coalesce(last, F.lit(default)).alias(out))
