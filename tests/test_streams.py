"""Streams over several files, with late rows."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowgauge.operators.labeling import TimeWindow, label_time_windows
from flowgauge.streaming import streams as s

BASE = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, key bigint, id bigint, y_true int, y_pred int"


def land(spark, path, batches):
    for i, rows in enumerate(batches):
        data = [(BASE + timedelta(minutes=m), *rest) for m, *rest in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{path}/{i:03d}")


def open_stream(spark, path):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(path)


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    path = str(tmp_path / "in")
    land(
        spark,
        path,
        [
            [(1, 1, 1, 1, 1), (2, 1, 2, 0, 1), (9, 1, 3, 0, 0)],
            [(45, 1, 4, 1, 0)],
            # rows are late against the watermark of the batch before
            [(46, 1, 7, 0, 0)],
            [(3, 1, 5, 1, 1), (100, 1, 6, 0, 0)],
        ],
    )
    out = s.drain(s.stream_confusion(open_stream(spark, path), "ts", "10 minutes", "5 minutes", ["key"]), "late")
    got = {r["window_start"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in out.collect()}
    assert got == {BASE: (1, 1, 0, 1), BASE + timedelta(minutes=40): (1, 0, 1, 0)}


def test_time_to_detect_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    land(
        spark,
        path,
        [
            [(0, 1, 0, 0, 0), (2, 1, 2, 1, 0), (1, 1, 1, 1, 0)],
            [(3, 1, 3, 1, 1), (4, 1, 4, 0, 0), (0, 2, 10, 1, 0), (5, 2, 11, 0, 0)],
            [(60, 1, 5, 1, 1), (60, 2, 12, 0, 0)],
            [(90, 1, 6, 0, 0), (200, 1, 7, 0, 0)],
        ],
    )
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    out = s.drain(
        s.stream_time_to_detect(open_stream(spark, path), "ts", F.col("key"), F.col("id"), "10 minutes"), "mttd"
    )
    got = sorted((r["key"], r["rows"], r["delay"]) for r in out.collect())
    assert got == [(1, 1, 0), (1, 3, 2), (2, 1, None)]


def test_dedup_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [[(1, 1, 1, 0, 0), (2, 1, 1, 0, 0)], [(3, 1, 1, 0, 0), (4, 2, 1, 0, 0)]])
    out = s.drain(s.stream_dedup(open_stream(spark, path), "ts", "1 hour", ["key", "id"]), "dedup")
    assert sorted(r["key"] for r in out.collect()) == [1, 2]


class Held:
    """State of one key in memory; counts the bytes of rows read and written."""

    def __init__(self):
        self.maps, self.value, self.timers, self.moved = {}, None, [], 0

    def getMapState(self, name, *_):
        self.maps[name] = data = {}
        held = self

        class Map:
            def getValue(self, key):
                held.moved += len(data[key][0]) if name == "slices" else 0
                return data[key]

            def updateValue(self, key, value):
                held.moved += len(value[0]) if name == "slices" else 0
                data[key] = value

            def removeKey(self, key):
                del data[key]

            def iterator(self):
                return iter(list(data.items()))

        return Map()

    def getValueState(self, *_):
        held = self

        class Value:
            def get(self):
                return held.value

            def update(self, value):
                held.value = value

            def clear(self):
                held.value = None

        return Value()

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def batches_of(us, seed, watermark_ms):
    rng = np.random.default_rng(seed)
    t = rng.random(len(us)) < 0.6
    p = rng.random(len(us)) < 0.3
    return pd.DataFrame({"us": us, "id": np.arange(len(us)), "t": t, "p": p}), watermark_ms


def test_batches_of_a_busy_key_cost_by_their_new_rows():
    processor = s._Detection().typed_keys([], None)
    held = Held()
    processor.init(held)
    rng = np.random.default_rng(1)
    first = batches_of(rng.integers(10**9, 10**9 + 200_000 * 10**6, 200_000), 2, 0)
    batches = [first] + [batches_of(rng.integers(10**9 + k * 10**9, 10**9 + 200_000 * 10**6, 50), k, 10**6 + k * 10**6) for k in range(1, 40)]
    got, cost = [], []
    for rows, watermark in batches:
        held.moved = 0
        got += [processor.handleInputRows((), iter([rows]), At(watermark)).__next__()]
        cost.append(held.moved // 32)
        assert len(held.timers) == 1
    # a batch of 50 rows makes about 1000 waiting rows due and touches few slices of the 98
    assert cost[0] == 200_000 and max(cost[1:]) < 12 * s._Detection.SLICE_ROWS and np.mean(cost[1:]) < 5 * s._Detection.SLICE_ROWS
    whole = pd.concat([r for r, _ in batches]).sort_values(["us", "id", "t", "p"])
    whole = whole[whole.us < batches[-1][1] * 1000]
    want, current = [], None
    for row in whole.itertuples(index=False):
        current, closed = processor.step(current, tuple(row))
        want += [processor.show(closed)] if closed else []
    out = pd.concat(got)
    assert [(a, b, None if pd.isna(c) else c) for a, b, c in out.itertuples(index=False)] == want and len(want) > 1000
    assert held.value == current


def test_rows_in_slices_keep_missing_values():
    rows = pd.DataFrame({"us": [3, 1], "id": [None, 7], "t": [True, False], "size": [1.0, np.nan]})
    back = s.unpacked(s.packed(rows), [2])
    assert back == [(3, None, True, 1), (1, 7, False, None)]


def test_any_list_of_windows_labels_streams_like_tables(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [[(m, m % 7, m, 0, 0) for m in range(k * 100, k * 100 + 100)] for k in range(3)])
    windows = [
        TimeWindow(f"w{i}", (BASE + timedelta(minutes=3 * i)).isoformat(), (BASE + timedelta(minutes=3 * i, seconds=(1, 400, 4000)[i % 3])).isoformat(), src=(i % 7, "x"))
        for i in range(90)
    ]
    out = s.drain(s.stream_labels(open_stream(spark, path), windows, "ts", "key", "key"), "labels")
    table = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(path)
    few = [label_time_windows(table, windows[k : k + 45], "ts", "key", "key", f"l{k}").select("id", f"l{k}") for k in (0, 45)]
    both = few[0].join(few[1], "id").withColumn("want", F.when(F.col("l45") != "BENIGN", F.col("l45")).otherwise(F.col("l0")))
    want = {r["id"]: r["want"] for r in both.collect()}
    assert {r["id"]: r["label"] for r in out.collect()} == want and len(set(want.values())) > 20
