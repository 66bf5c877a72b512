"""Labelling, scoring counts, deduplication, sessions and time to detect on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from flowgauge.functions.scalars import BENIGN_NAME
from flowgauge.operators.detectors import LOADERS, FittedDetector
from flowgauge.operators.flows import ACTIVE_MS, IDLE_MS, endpoint_key
from flowgauge.operators.labeling import TimeWindow, label_time_windows
from flowgauge.operators.metrics import binary_counts, flags
from flowgauge.operators.runs import ModelStore
from flowgauge.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parquet_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """A stream over Parquet files; a backlog is taken in batches of at most ``files_per_batch`` files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all data that is there now into a Parquet table, and read that.

    Rows go from tasks to files; nothing passes through the driver.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_labels(flows: DataFrame, windows: list[TimeWindow], ts: str, src: str, dst: str, out: str = "label") -> DataFrame:
    """Window labels are a narrow expression and need no state."""
    return label_time_windows(flows, windows, ts, src, dst, out)


def stream_confusion(
    scored: DataFrame, ts: str, width: str, delay: str, keys: list[str], slide: str | None = None
) -> DataFrame:
    """Confusion counts, accuracy and false-positive rate per event-time window; late rows are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    marked = scored.withWatermark(ts, delay).withColumn("__w", window)
    counts = binary_counts(marked, ["__w", *keys])
    tn, fp, tp, n = (F.col(c) for c in ("tn", "fp", "tp", "n"))
    return counts.select(
        F.col("__w.start").alias("window_start"),
        F.col("__w.end").alias("window_end"),
        *keys,
        "tn",
        "fp",
        "fn",
        "tp",
        F.round((tp + tn) / n, 5).alias("accuracy"),
        F.round(F.try_divide(fp.cast("double"), (fp + tn).cast("double")), 5).alias("fp_rate"),
    )


def stream_scores(rows: DataFrame, detector: FittedDetector) -> DataFrame:
    """Rows of a stream with ``y_pred``, ``score`` and ``proba`` of a fitted detector, which is read once, before the stream starts."""
    return detector.transform(rows)


def stored_detector(store: ModelStore, model: str, dataset: str, fold: int | None = None) -> FittedDetector:
    """The detector of a finished training run; fails when there is none for this configuration."""
    found = store.load(LOADERS, model, dataset, fold)
    if found is None:
        raise FileNotFoundError(f"no stored detector {model!r} of {dataset!r} for configuration {store.config!r}")
    return found


def stream_dedup(rows: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """First row per key within the watermark horizon."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_flows(packets: DataFrame, ts: str, keys: list[str], idle: str, delay: str, size: str) -> DataFrame:
    """Sessions of packets per direction-free key, closed by the idle timeout."""
    return (
        packets.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, idle).alias("__s"), *keys)
        .agg(
            F.count(F.lit(1)).alias("bidirectional_packets"),
            F.sum(size).alias("bidirectional_bytes"),
            F.min(size).alias("bidirectional_min_ps"),
            F.max(size).alias("bidirectional_max_ps"),
            F.min(ts).alias("first_seen"),
            F.max(ts).alias("last_seen"),
        )
        .drop("__s")
    )


MISSING = -(1 << 63)


def packed(rows: pd.DataFrame) -> np.ndarray:
    """Whole numbers and flags as one matrix of LONGs; a missing value is the least LONG."""
    columns = [rows[c] if rows[c].dtype.kind in "iub" else rows[c].astype("Int64").fillna(MISSING) for c in rows.columns]
    return np.column_stack([c.to_numpy(np.int64) for c in columns]) if len(columns) else np.zeros((len(rows), 0), np.int64)


def unpacked(rows: np.ndarray, flags: list[int]) -> list[tuple]:
    """Rows as tuples, with flags and missing values as they were."""
    out = [[None if x == MISSING else x for x in c] if (rows[:, i] == MISSING).any() else c for i, c in enumerate(rows.T.tolist())]
    for i in flags:
        out[i] = [None if x is None else bool(x) for x in out[i]]
    return list(zip(*out))


class _InEventOrder(StatefulProcessor):
    """Per stream key: rows wait on disk until the watermark has passed them, then are handled in time order.

    Waiting rows lie in slices of event time, each with at most ``SLICE_ROWS`` rows
    of one batch in order; a directory holds the first time of each. A batch adds
    slices for its own rows and reads those that the watermark has reached. What is
    not yet due in these is put together into new slices, so slices that overlap
    become few. The work of a batch goes by its own rows and those that become due,
    not by all that wait.

    Subclasses name their columns (event time in microseconds and a row id
    first) and turn the open item and a row into the new open item and, at most,
    one closed item.
    """

    ROW: str
    OPEN: str
    OUT: dict[str, str]
    SLICE_ROWS = 2048

    def typed_keys(self, names: list[str], rows: DataFrame) -> "_InEventOrder":
        """Use the keys' own types: whole numbers, or anything else as it comes."""
        whole = {n for n in names if isinstance(rows.schema[n].dataType, T.LongType)}
        self.OUT = {**{n: "int64" if n in whole else "object" for n in names}, **self.OUT}
        return self

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.directory = handle.getMapState("directory", "slice bigint", "least bigint")
        self.slices = handle.getMapState("slices", "slice bigint", "rows binary")
        self.open = handle.getValueState("open", self.OPEN)
        fields = [c.split() for c in self.ROW.split(", ")]
        self.names = [name for name, _ in fields]
        self.marks = [i for i, (_, kind) in enumerate(fields) if kind == "boolean"]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        for pdf in rows:
            self._wait(waiting, packed(pdf[self.names]))
        yield self._advance(key, timerValues, waiting)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues, self._waiting())

    def _waiting(self) -> dict[int, int]:
        """First time of each slice by its number."""
        return {number: least for (number,), (least,) in self.directory.iterator()}

    def _wait(self, waiting: dict[int, int], rows: np.ndarray) -> None:
        rows = rows[np.lexsort(rows.T[::-1])]
        for at in range(0, len(rows), self.SLICE_ROWS):
            number = max(waiting, default=-1) + 1
            waiting[number] = int(rows[at, 0])
            self.slices.updateValue((number,), (rows[at : at + self.SLICE_ROWS].tobytes(),))
            self.directory.updateValue((number,), (waiting[number],))

    def _due(self, waiting: dict[int, int], due_us: int) -> list[tuple]:
        """Take the rows before the watermark, in order."""
        reached = [number for number, least in waiting.items() if least < due_us]
        if not reached:
            return []
        found = [np.frombuffer(self.slices.getValue((n,))[0], np.int64).reshape(-1, len(self.names)) for n in reached]
        for number in reached:
            del waiting[number]
            self.slices.removeKey((number,))
            self.directory.removeKey((number,))
        rows = np.concatenate(found)
        early = rows[:, 0] < due_us
        if not early.all():
            self._wait(waiting, rows[~early])
        rows = rows[early]
        return unpacked(rows[np.lexsort(rows.T[::-1])], self.marks)

    def _advance(self, key, timer: TimerValues, waiting: dict[int, int]) -> pd.DataFrame:
        due_us = timer.getCurrentWatermarkInMs() * 1000
        current, done = self.open.get(), []
        for row in self._due(waiting, due_us):
            current, closed = self.step(current, row)
            if closed is not None:
                done.append(closed)
        first = min(waiting.values(), default=None)
        ends_us = None if current is None else self.ends(current)
        if ends_us is not None and ends_us < due_us and (first is None or ends_us < first):
            done.append(current)
            current = None
        if current is None:
            self.open.clear()
        else:
            self.open.update(current)
        wake = [] if first is None else [first]
        if current is not None and self.ends(current) is not None:
            wake.append(self.ends(current))
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if wake:
            self.handle.registerTimer(max(min(wake) // 1000 + 1, timer.getCurrentWatermarkInMs() + 1))
        shown = [(*key, *self.show(d)) for d in done]
        columns = list(self.OUT)
        return pd.DataFrame(shown, columns=columns).astype(self.OUT)

    def step(self, current: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        raise NotImplementedError

    def ends(self, current: tuple) -> int | None:
        """Event time after which the open item closes by itself, if it ever does."""
        return None

    def show(self, closed: tuple) -> tuple:
        return closed

    def close(self) -> None:
        pass


class _Detection(_InEventOrder):
    """Attack instances: start, rows, rows before the first hit (-1: none yet)."""

    ROW = "us bigint, id bigint, t boolean, p boolean"
    OPEN = "start_us bigint, length bigint, delay bigint"
    OUT = {"start_us": "int64", "rows": "int64", "delay": "Int64"}

    def step(self, current, row):
        us, _, t, p = row
        if not t:
            return None, current
        start, length, delay = current if current is not None else (us, 0, -1)
        return (start, length + 1, length if delay < 0 and p else delay), None

    def show(self, closed):
        start, length, delay = closed
        return start, length, None if delay < 0 else delay


class _Flow(_InEventOrder):
    """Flows cut by idle and active timeout."""

    ROW = "us bigint, id bigint, size bigint"
    OPEN = "session_us bigint, cut bigint, first_us bigint, last_us bigint, packets bigint, bytes bigint, low bigint, high bigint"
    OUT = {
        "first_us": "int64",
        "last_us": "int64",
        "bidirectional_packets": "int64",
        "bidirectional_bytes": "int64",
        "bidirectional_min_ps": "int64",
        "bidirectional_max_ps": "int64",
    }

    def __init__(self, idle_us: int, active_us: int):
        self.idle_us, self.active_us = idle_us, active_us

    def step(self, current, row):
        us, _, size = row
        if current is None or us - current[3] > self.idle_us:
            return (us, 0, us, us, 1, size, size, size), current
        session, cut, first, last, packets, total, low, high = current
        now = (us - session) // self.active_us
        if now != cut:
            return (session, now, us, us, 1, size, size, size), current
        return (session, cut, first, us, packets + 1, total + size, min(low, size), max(high, size)), None

    def ends(self, current):
        return current[3] + self.idle_us

    def show(self, closed):
        return closed[2:]


SIDES = ("bidirectional", "src2dst", "dst2src")
# running numbers of one direction of an open flow; times in milliseconds
SIDE = {
    **{c: "bigint" for c in ("first", "last", "packets", "bytes", "low", "high")},
    **{c: "double" for c in ("mean", "spread")},
    **{c: "bigint" for c in ("gaps", "gap_low", "gap_high")},
    **{c: "double" for c in ("gap_mean", "gap_spread")},
}


def _added(n: int, mean: float, spread: float, value: int) -> tuple[float, float]:
    """Mean and sum of squared distances with one more value, the n-th."""
    away = value - mean
    mean += away / n
    return mean, spread + away * (value - mean)


class _FlowRecord(_InEventOrder):
    """Flows with the columns of the batch operator; src2dst is the direction of the first packet."""

    def __init__(self, idle_ms: int, active_ms: int, flags: list[str]):
        self.idle_ms, self.active_ms, self.flags = idle_ms, active_ms, flags
        marks = [f"f{i}" for i in range(len(flags))]
        self.ROW = ", ".join(["us bigint", "id bigint", "fwd boolean", "size bigint", *[f"{m} bigint" for m in marks]])
        side = [*SIDE.items(), *[(m, "bigint") for m in marks]]
        self.width = len(side)
        self.OPEN = "session bigint, cut bigint, flow_id bigint, forward boolean, " + ", ".join(
            f"s{k}_{c} {kind}" for k in range(3) for c, kind in side
        )
        self.OUT = {"flow_id": "int64", "forward": "bool"}
        for name in SIDES:
            whole = ("first_seen_ms", "last_seen_ms", "duration_ms", "packets", "bytes")
            self.OUT |= {f"{name}_{c}": "Int64" for c in whole}
            for kind in ("ps", "piat_ms"):
                self.OUT |= {f"{name}_min_{kind}": "Int64", f"{name}_mean_{kind}": "Float64"}
                self.OUT |= {f"{name}_stddev_{kind}": "Float64", f"{name}_max_{kind}": "Int64"}
            self.OUT |= {f"{name}_{f}_packets": "int64" for f in flags}

    def schema(self) -> str:
        sql = {"int64": "bigint", "Int64": "bigint", "Float64": "double", "bool": "boolean"}
        return ", ".join(f"`{c}` {sql[kind]}" for c, kind in self.OUT.items())

    def step(self, current, row):
        us, row_id, fwd, size, *marks = row
        ms = us // 1000
        if current is None or ms - self._last(current) > self.idle_ms:
            return self._with(self._fresh(ms, 0, row_id, fwd), ms, fwd, size, marks), current
        cut = (ms - current[0]) // self.active_ms
        if cut != current[1]:
            return self._with(self._fresh(current[0], cut, row_id, fwd), ms, fwd, size, marks), current
        return self._with(current, ms, fwd, size, marks), None

    def _fresh(self, session: int, cut: int, row_id: int, fwd: bool) -> tuple:
        none = [0.0 if kind == "double" else 0 for kind in SIDE.values()] + [0] * len(self.flags)
        return (session, cut, row_id, fwd, *none, *none, *none)

    def _last(self, current: tuple) -> int:
        return current[4 + list(SIDE).index("last")]

    def _with(self, current: tuple, ms: int, fwd: bool, size: int, marks: list[int]) -> tuple:
        session, cut, flow_id, forward, *rest = current
        for k in (0, 1 if fwd == forward else 2):
            side = rest[k * self.width : (k + 1) * self.width]
            first, last, n, total, low, high, mean, spread, gaps, glow, ghigh, gmean, gspread, *seen = side
            if n:
                gap = ms - last
                glow, ghigh = (min(glow, gap), max(ghigh, gap)) if gaps else (gap, gap)
                gaps += 1
                gmean, gspread = _added(gaps, gmean, gspread, gap)
                low, high = min(low, size), max(high, size)
            else:
                first, low, high = ms, size, size
            n += 1
            mean, spread = _added(n, mean, spread, size)
            seen = [a + b for a, b in zip(seen, marks)]
            side = [first, ms, n, total + size, low, high, mean, spread, gaps, glow, ghigh, gmean, gspread, *seen]
            rest[k * self.width : (k + 1) * self.width] = side
        return (session, cut, flow_id, forward, *rest)

    def ends(self, current):
        return (self._last(current) + self.idle_ms) * 1000

    def show(self, closed):
        out = [closed[2], closed[3]]
        for k in range(3):
            side = closed[4 + k * self.width : 4 + (k + 1) * self.width]
            first, last, n, total, low, high, mean, spread, gaps, glow, ghigh, gmean, gspread, *seen = side
            out += [first, last, last - first, n, total] if n else [None, None, None, 0, 0]
            for m, lo, avg, around, hi in ((n, low, mean, spread, high), (gaps, glow, gmean, gspread, ghigh)):
                out += [lo, avg, (around / (m - 1)) ** 0.5 if m > 1 else 0.0, hi] if m else [None] * 4
            out += seen
        return tuple(out)


def _key(rows: DataFrame, c: Column) -> Column:
    """Whole numbers as LONG, any other key as text."""
    whole = isinstance(rows.select(c.alias("k")).schema["k"].dataType, T.IntegralType)
    return c.cast("bigint" if whole else "string")


def _keyed_state(rows: DataFrame, keys: list[str], processor: _InEventOrder, schema: str) -> DataFrame:
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    named = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor.typed_keys(keys, rows), outputStructType=f"{named}, {schema}", outputMode="Append", timeMode="EventTime"
    )


def stream_flows_active(
    packets: DataFrame, ts: str, lo: Column, hi: Column, row_id: Column, size: Column, idle_s: int, active_s: int, delay: str
) -> DataFrame:
    """Flows per ordered pair of endpoints (numbers or addresses), cut by both timeouts as in the batch operator."""
    shaped = packets.withWatermark(ts, delay).select(
        ts,
        _key(packets, lo).alias("lo"),
        _key(packets, hi).alias("hi"),
        F.unix_micros(ts).alias("us"),
        row_id.cast("bigint").alias("id"),
        size.cast("bigint").alias("size"),
    )
    schema = ", ".join(f"{c} bigint" for c in _Flow.OUT)
    return _keyed_state(shaped, ["lo", "hi"], _Flow(idle_s * 1_000_000, active_s * 1_000_000), schema)


def stream_flow_records(
    packets: DataFrame,
    ts: str,
    src: list[str],
    dst: list[str],
    extra: list[str] | None = None,
    flags: list[str] | None = None,
    size: str = "size",
    order: str = "pkt_id",
    idle_ms: int = IDLE_MS,
    active_ms: int = ACTIVE_MS,
    delay: str = "1 hour",
) -> DataFrame:
    """Flows with all columns of the batch operator, as they close behind the watermark.

    ``src`` and ``dst`` list the columns of an endpoint (address, port), numbers or
    text, ``extra`` the rest of the key; ``flow_id`` is the order number of the
    flow's first packet. Times count in milliseconds.
    """
    extra, flags = extra or [], flags or []
    keyed, _ = endpoint_key(packets.withWatermark(ts, delay), src, dst, extra)
    ends = {f"{end}{i}": F.col(f"__{end}.p{i}") for end in ("lo", "hi") for i in range(len(src))}
    shaped = keyed.select(
        ts,
        *[_key(keyed, c).alias(name) for name, c in ends.items()],
        *[_key(keyed, F.col(c)).alias(c) for c in extra],
        (F.unix_millis(ts) * 1000).alias("us"),
        F.col(order).cast("bigint").alias("id"),
        F.col("__fwd").alias("fwd"),
        F.col(size).cast("bigint").alias("size"),
        *[F.coalesce(F.col(f).cast("bigint"), F.lit(0)).alias(f"f{i}") for i, f in enumerate(flags)],
    )
    record = _FlowRecord(idle_ms, active_ms, flags)
    got = _keyed_state(shaped, [*ends, *extra], record, record.schema())
    sides = [(c, "lo", "hi", i) for i, c in enumerate(src)] + [(c, "hi", "lo", i) for i, c in enumerate(dst)]
    named = [F.when(F.col("forward"), F.col(f"{a}{i}")).otherwise(F.col(f"{b}{i}")).alias(c) for c, a, b, i in sides]
    rest = [c for c in got.columns if c not in {*ends, *extra, "forward", "flow_id"}]
    return got.select("flow_id", *named, *extra, *rest)


def stream_time_to_detect(
    scored: DataFrame, ts: str, key: Column, row_id: Column, delay: str, benign: str = BENIGN_NAME
) -> DataFrame:
    """One row per closed attack instance of a stream key: start, rows, rows until the first hit (or NULL).

    Rows are handled in event-time order once the watermark has passed them.
    Needs the RocksDB state store: pending rows stay on disk.
    """
    truth, alarm = flags(scored, benign)
    shaped = scored.withWatermark(ts, delay).select(
        ts,
        _key(scored, key).alias("key"),
        F.unix_micros(ts).alias("us"),
        row_id.cast("bigint").alias("id"),
        truth.alias("t"),
        alarm.alias("p"),
    )
    return _keyed_state(shaped, ["key"], _Detection(), "start_us bigint, rows bigint, delay bigint")
