"""Hand-worked values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.functions.scalars import normal_cdf
from flowgauge.operators import anomaly, clean, fitted, labeling, metrics, select, splits
from flowgauge.operators.labeling import TimeWindow
from flowgauge.operators.prefix import range_edges

PREDS = "run_id string, row_id bigint, y_true int, y_pred int, score double"


def preds(spark, rows):
    return spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], PREDS)


def cells(spark, tn, fp, fn, tp):
    rows = [(0, 0, 0.0)] * tn + [(0, 1, 0.0)] * fp + [(1, 0, 0.0)] * fn + [(1, 1, 0.0)] * tp
    return preds(spark, rows)


FOUR = [(0, 0, 0.1), (0, 0, 0.4), (1, 0, 0.35), (1, 1, 0.8)]


def test_ranking_metrics(spark):
    row = metrics.ranking_metrics(metrics.score_curve(preds(spark, FOUR))).collect()[0]
    assert row["pr_auc"] == 0.83333
    assert row["roc_auc"] == 0.75


def test_one_class_has_no_roc(spark):
    row = metrics.ranking_metrics(metrics.score_curve(preds(spark, [(0, 0, 0.1), (0, 1, 0.2)]))).collect()[0]
    assert row["roc_auc"] is None and row["pr_auc"] == 0.0


@pytest.mark.parametrize(
    "curve, want",
    [([(0.0, 1.0), (0.1, 0.5), (0.2, 0.5)], 0.625), ([(0.1, 0.9)], 0.9)],
)
def test_robustness_index(spark, curve, want):
    df = spark.createDataFrame([("r", *p) for p in curve], "run_id string, epsilon double, accuracy double")
    assert metrics.robustness_index(df).collect()[0]["robustness_index"] == want


def test_binary_counts(spark):
    p = cells(spark, 50, 10, 5, 35)
    row = metrics.count_metrics(p).collect()[0]
    assert row["accuracy"] == 0.85
    assert row["precision_score"] == 0.77778
    assert row["recall_score"] == 0.875
    assert row["f1_score"] == 0.82353
    assert row["matthews_correlation_coefficient"] == 0.69752
    assert row["intrusion_detection_capability"] == 0.39686
    assert row["fp_per_million"] == 100000.0
    shares = {(r["y_true"], r["y_pred"]): r["share"] for r in metrics.confusion_normalized(p).collect()}
    assert shares == {(0, 0): 0.83333, (0, 1): 0.16667, (1, 0): 0.125, (1, 1): 0.875}
    multi = metrics.mcc_multiclass(p).collect()[0]
    assert multi["matthews_correlation_coefficient"] == 0.69752


def test_inverted_predictions_clamp_to_zero(spark):
    p = cells(spark, 0, 10, 10, 0)
    assert metrics.count_metrics(p).collect()[0]["matthews_correlation_coefficient"] == 0.0


def test_undefined_ratios_are_zero(spark):
    row = metrics.count_metrics(cells(spark, 5, 0, 0, 0)).collect()[0]
    assert (row["precision_score"], row["recall_score"], row["f1_score"]) == (0.0, 0.0, 0.0)
    assert row["intrusion_detection_capability"] == 0.0


def detect(spark, true, pred, buckets=None):
    rows = [(t, p, 0.0) for t, p in zip(true, pred)]
    r = metrics.time_to_detect(preds(spark, rows), buckets=buckets).collect()[0]
    return (
        r["mttd_samples"],
        r["attack_instances_total"],
        r["attack_instances_detected"],
        r["attack_instances_undetected"],
    )


def test_time_to_detect(spark):
    assert detect(spark, [0, 1, 1, 0, 1, 1, 1], [0, 0, 1, 0, 0, 0, 0]) == (1.0, 2, 1, 1)
    assert detect(spark, [0, 1], [0, 0]) == (math.inf, 1, 0, 1)
    assert detect(spark, [0, 0], [0, 0]) == (math.inf, 0, 0, 0)


@pytest.mark.parametrize("seed, buckets, hot", [(1, 9, 0.5), (2, 40, 0.93), (3, 3, 1.0), (4, 25, 0.1)])
def test_time_to_detect_across_buckets(spark, seed, buckets, hot):
    rng = random.Random(seed)
    true, state = [], 0
    for _ in range(300):
        state = state if rng.random() < hot else 1 - state
        true.append(state or int(hot == 1.0))
    pred = [int(rng.random() < 0.1) for _ in true]
    delays, total, i = [], 0, 0
    while i < len(true):
        if not true[i]:
            i += 1
            continue
        j = i
        while j < len(true) and true[j]:
            j += 1
        total += 1
        hits = [k - i for k in range(i, j) if pred[k]]
        delays += hits[:1]
        i = j
    mean = sum(delays) / len(delays) if delays else math.inf
    got = detect(spark, true, pred, buckets)
    assert got[0] == pytest.approx(mean, abs=1e-5)
    assert got[1:] == (total, len(delays), total - len(delays))


def test_min_max_keeps_constants_at_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    got = fitted.fit_min_max(df, ["a", "b"]).transform(df).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.0 / 3.0, 0.0), (1.0, 0.0)]


def test_sigma_threshold(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "rmse double")
    assert anomaly.fit_error_model(df).threshold == pytest.approx(1.09245, abs=1e-5)
    with pytest.raises(ValueError):
        anomaly.fit_error_model(df, "adaptive")


def test_normal_cdf(spark):
    zs = [-4.0, -1.0, 0.0, 0.5, 2.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(normal_cdf(F.col("z")).alias("p")).collect()
    for z, r in zip(zs, got):
        assert r["p"] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)


@pytest.mark.parametrize("limits", [{}, {"sort_rows": 2, "bins": 3}])
def test_kfold_blocks(spark, limits):
    rows = [(i, c) for i, c in enumerate("a" * 7 + "b" * 4 + "c" * 12)]
    df = spark.createDataFrame(rows, "row_id bigint, y string").repartition(4)
    got = splits.split_kfold(df, "y", 5, **limits).collect()
    sizes = {c: [sum(r["y"] == c and r["fold"] == k for r in got) for k in range(5)] for c in "abc"}
    assert sizes == {"a": [2, 2, 1, 1, 1], "b": [1, 0, 1, 1, 1], "c": [2, 3, 3, 2, 2]}
    for c in "abc":
        folds = [r["fold"] for r in sorted(got, key=lambda r: r["row_id"]) if r["y"] == c]
        assert folds == sorted(folds)


def flows_like(spark, n=2000, parts=3):
    rng = random.Random(11)
    rows = [(i, rng.choices("abc", [0.9, 0.08, 0.02])[0]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id bigint, y string").repartition(parts)


def test_stratified_split_is_exact_and_partition_free(spark):
    rows, df = flows_like(spark)
    base = {r["row_id"]: r["split"] for r in splits.split_stratified(df, "y", 0.3, 5).collect()}
    assert sum(s == "test" for s in base.values()) == 600
    for parts, limits in ((1, {}), (64, {"sort_rows": 10, "bins": 8})):
        other = splits.split_stratified(flows_like(spark, parts=parts)[1], "y", 0.3, 5, **limits).collect()
        assert {r["row_id"]: r["split"] for r in other} == base
    for c in "abc":
        n = sum(y == c for _, y in rows)
        test = sum(base[i] == "test" for i, y in rows if y == c)
        assert abs(test - 0.3 * n) < 1
    again = {r["row_id"]: r["split"] for r in splits.split_stratified(df, "y", 0.3, 6).collect()}
    assert again != base


def test_split_errors(spark):
    _, df = flows_like(spark, 50)
    lonely = df.unionByName(spark.createDataFrame([(999, "z")], df.schema))
    with pytest.raises(ValueError):
        splits.split_stratified(lonely, "y", 0.3, 1)
    with pytest.raises(ValueError):
        splits.split_benign_train(df, "y", "benign", 0.3, 1)
    with pytest.raises(ValueError):
        splits.split_kfold(df, "y", 1)
    with pytest.raises(ValueError):
        splits.split_cross_dataset(df.withColumn("dataset", F.lit("one")), "y", 0.3, 1)


def test_single_benign_row_trains(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, None)], "row_id bigint, y int")
    got = {r["row_id"]: r["split"] for r in splits.split_benign_train(df, "y", 0, 0.3, 1).collect()}
    assert got == {1: "train", 2: "test", 3: "test", 4: "test"}


def test_time_split_of_text_and_ties(spark):
    rows = [(i, f"2024-01-01 00:00:{i % 3:02d}") for i in range(9)] + [(9, "soon"), (10, None)]
    df = spark.createDataFrame(rows, "row_id bigint, t string")
    got = splits.split_timestamp(df, "t", 0.4, sort_rows=1, bins=2).collect()
    train = {r["row_id"] for r in got if r["split"] == "train"}
    assert len(got) == 9 and train == {0, 3, 6, 1, 4}


def test_window_labels_agree(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(2000), rng.randrange(6), rng.randrange(6)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, s bigint, src int, dst int").select(
        "row_id", F.timestamp_seconds("s").alias("ts"), "src", "dst"
    )
    windows = []
    for i in range(12):
        start = rng.randrange(1500)
        src, dst = tuple(rng.sample(range(6), rng.randrange(3))), tuple(rng.sample(range(6), rng.randrange(3)))
        at = [f"1970-01-01T00:{x // 60:02d}:{x % 60:02d}+00:00" for x in (start, start + rng.randrange(500))]
        windows.append(TimeWindow(f"w{i}", at[0], at[1], src, dst))
    windows += [TimeWindow("open"), TimeWindow("quiet", default=True)]

    def expected(s, a, b):
        label = "quiet"
        for w in windows[:12]:
            lo, hi = (sum(int(p) * m for p, m in zip(t[14:19].split(":"), (60, 1))) for t in (w.start, w.end))
            if lo <= s <= hi:
                ok = lambda x, y: (not w.src or x in w.src) and (not w.dst or y in w.dst)
                if ok(a, b) or ok(b, a):
                    label = w.label
        return label

    want = {i: expected(s, a, b) for i, s, a, b in rows}
    case = labeling.label_time_windows(df, windows, "ts", "src", "dst")
    assert {r["row_id"]: r["label"] for r in case.collect()} == want
    table = labeling.windows_frame(spark, windows)
    for limit in (50_000, 0):
        joined = labeling.label_by_cover(df, table, "ts", "src", "dst", default="quiet", max_rows=limit)
        assert {r["row_id"]: r["label"] for r in joined.collect()} == want


def test_label_column_rules(spark):
    df = spark.createDataFrame([(1, " Benign "), (2, "DoS"), (3, None)], "row_id bigint, label string")
    got = labeling.label_from_column(df, "label", ["Benign"], {"Benign": "benign"}).orderBy("row_id").collect()
    assert [(r["attack_category"], r["target_label"]) for r in got] == [("benign", 0), ("DoS", 1), (None, 1)]
    big = {f"k{i}": "x" for i in range(100)} | {"DoS": "flood"}
    wide = labeling.label_from_column(df, "label", ["Benign"], big).orderBy("row_id").collect()
    assert [r["attack_category"] for r in wide] == ["Benign", "flood", None]
    with pytest.raises(ValueError):
        labeling.label_from_column(df, "nope", [])
    assert labeling.label_static(df, "BENIGN").collect()[0]["target_label"] == 0
    assert labeling.label_static(df, "x", is_benign=True).collect()[0]["target_label"] == 0


def test_cleaning_rules(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, "a"), (2, nan, "a"), (3, inf, "a"), (4, None, "a"), (5, 2.0, None)], "row_id bigint, v double, c string")
    kept = clean.drop_duplicate_rows(df).collect()
    assert sorted(r["row_id"] for r in kept) == [1, 3, 5]
    assert clean.remove_incomplete_rows(df).count() == 0
    with pytest.raises(KeyError):
        clean.drop_columns(df, ["zzz"])
    assert clean.auto_columns(df, "min_max") == ["row_id", "v"]
    assert clean.auto_columns(df, "label") == ["c"]
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1.5, "t")], "x double, y string")
    both = clean.union_tables([a, b])
    assert dict(both.dtypes) == {"x": "double", "y": "string"}


def test_correlations(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        x = rng.gauss(1e6, 1)
        rows.append((x, x + rng.gauss(0, 1), rng.random() if rng.random() > 0.2 else None, 3.0, -x))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(6)
    cols = df.columns
    got = {(r["i"], r["j"]): r["r"] for r in select.correlations(df, cols).collect()}
    assert got.keys() == {(i, j) for i in range(5) for j in range(i + 1, 5)}
    import numpy as np

    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if 3 in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)
    assert select.correlation_threshold(df, 0.99).columns == ["a", "b", "c", "d"]


def test_selection_thresholds(spark):
    import numpy as np

    w = np.array([1.0, 2.0, 6.0])
    assert select.parse_threshold(None, w, False) == 3.0
    assert select.parse_threshold(None, w, True) == 1e-5
    assert select.parse_threshold("1.5*median", w, False) == 3.0
    assert select.parse_threshold(0.5, w, False) == 0.5
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "row_id bigint, v double")
    with pytest.raises(ValueError):
        select.variance_threshold(flat)


def test_interval_cover_holds_every_time_of_a_window(spark):
    rng = random.Random(8)
    lengths = [0, 1, 10**6, (1 << 20) - 1, 1 << 20, 75 * 10**6, (1 << 32) + 5, 400 * 86400 * 10**6, 40 * 365 * 86400 * 10**6, 400 * 365 * 86400 * 10**6]
    rows = [(i, "w", start := rng.randrange(-(10**15), 10**15), start + n, [], []) for i, n in enumerate(lengths * 3)]
    rows.append((len(rows), "reversed", 5, 4, [], []))
    df = spark.createDataFrame(rows, "ord int, label string, start_us bigint, end_us bigint, src array<string>, dst array<string>")
    slots = {}
    for r in labeling.interval_cover(df).collect():
        slots.setdefault(r["ord"], []).append((r["__slot"], r["__whole"], labeling.WIDTHS[r["__width"]]))
    assert set(slots) == set(range(len(rows) - 1))
    for i, _, start, end, _, _ in rows[:-1]:
        found = sorted(slots[i])
        bits = found[0][2]
        assert [s for s, _, _ in found] == list(range(start >> bits, (end >> bits) + 1)) and (len(found) <= 65 or bits == labeling.WIDTHS[-1])
        assert all(w == (s << bits >= start and ((s + 1) << bits) - 1 <= end) for s, w, _ in found)
    # of any number of windows that fill a slot for everyone, one is listed
    many = spark.createDataFrame([(k, f"w{k}", 0, 1 << 45, [], []) for k in range(300)], df.schema)
    lists = labeling.cover_lists(many).collect()
    assert max(len(r["__ws"]) for r in lists) == 300 and sum(len(r["__ws"]) == 1 and r["__ws"][0]["ord"] == 299 for r in lists) == len(lists) - 1


@pytest.mark.parametrize("shape", ["even", "clustered", "powers", "one", "two"])
def test_counted_edges_balance_buckets(spark, shape):
    rng = random.Random(3)
    values = {
        "even": [rng.random() for _ in range(3000)],
        "clustered": [1e9 + k for k in range(1500)] + [5.0 + k * 1e-7 for k in range(1500)],
        "powers": [2.0 ** -rng.uniform(0, 900) for _ in range(3000)],
        "one": [7.0] * 50,
        "two": [-1.7e308, 1.7e308] * 5,
    }[shape]
    rows = [(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)]
    edges = range_edges(spark.createDataFrame(rows, "v double"), "v", 20)
    assert edges == sorted(set(edges)) and len(edges) <= 19
    counts = np.bincount(np.searchsorted(edges, values, "right")) if edges else np.array([len(values)])
    if shape in ("even", "clustered", "powers"):
        assert len(counts) >= 14 and counts.max() <= 2.2 * len(values) / 20
    assert range_edges(spark.createDataFrame(rows, "v double"), "v") == []
