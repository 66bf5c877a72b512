"""Rank selection, running sums and code tables against plain Python, with small limits and hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from flowgauge.functions.hashing import hash_order, hash_uniform
from flowgauge.operators import ranking, small
from flowgauge.operators.fitted import Fitted, dense_codes, distinct_values, fit_label, fit_one_hot
from flowgauge.operators.prefix import running_sums
from flowgauge.operators.ranking import group_ranges, percentiles, select_ranks
from flowgauge.session import durable


def skewed_rows(n=3000, seed=1):
    """A third of the rows share one key; one group holds most rows; one group is NULL."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choices(["big", "mid", None], [0.8, 0.15, 0.05])[0]
        k = 7_000 if rng.random() < 0.34 else int(rng.paretovariate(0.5)) % 10_000_000
        rows.append((g, k, i))
    return rows


def expected_cuts(rows, wanted):
    groups = {}
    for g, k, t in rows:
        groups.setdefault(g, []).append((k, t))
    out = {}
    for g, target, rank in wanted:
        ordered = sorted(groups.get(g, []))
        out[(g, target)] = ordered[rank - 1] if 1 <= rank <= len(ordered) else (None, None)
    return out


@pytest.mark.parametrize("limits", [(1_000_000, 4096), (20, 16), (1, 4)])
@pytest.mark.parametrize("stored", [False, True])
def test_select_ranks(spark, monkeypatch, limits, stored):
    if stored:
        if limits != (20, 16):
            pytest.skip("one size is enough for stored tables")
        monkeypatch.setattr(ranking, "pin_small", lambda df, *a: (durable(df), False))
    rows = skewed_rows()
    wanted = [(g, i, r) for g in ("big", "mid", None) for i, r in enumerate((0, 1, 40, 77, 500, 2000, 10**6))]
    df = spark.createDataFrame(rows, "g string, k bigint, t bigint").repartition(7)
    targets = spark.createDataFrame(wanted, "g string, target int, rank bigint")
    args = (df, ["g"], F.col("k"), F.col("t"))
    got, _ = select_ranks(*args, group_ranges(*args), targets, *limits)
    found = {(r["g"], r["target"]): (r["cut_key"], r["cut_tie"]) for r in got.collect()}
    assert found == expected_cuts(rows, wanted)


@pytest.mark.parametrize("limits", [(1_000_000, 4096), (5, 8)])
def test_percentiles(spark, limits):
    rng = random.Random(3)
    values = [0.0] * 200 + [rng.gauss(0, 1e6) for _ in range(301)] + [rng.random() * 1e-300 for _ in range(50)]
    rows = [(v, float(i % 4)) for i, v in enumerate(values)] + [(float("nan"), None), (None, float("inf"))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    got = percentiles(df, ["a", "b"], 0.5, *limits)
    ordered = sorted(values)
    n = len(ordered)
    want = ordered[n // 2] if n % 2 else ordered[n // 2 - 1] + (ordered[n // 2] - ordered[n // 2 - 1]) * 0.5
    assert got["a"] == want
    assert got["b"] == sorted(float(i % 4) for i in range(n))[n // 2] or n % 2 == 0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [1, 2, 13])
def test_running_sums(spark, descending, buckets):
    rng = random.Random(5)
    rows = [(g, s, rng.randrange(100)) for g in "ab" for s in sorted(rng.sample(range(5000), 400))]
    df = spark.createDataFrame(rows, "g string, s bigint, n bigint").repartition(6)
    got = running_sums(df, ["g"], "s", ["n"], descending=descending, buckets=buckets)
    total = {g: sum(n for h, _, n in rows if h == g) for g in "ab"}
    want, acc = {}, {}
    for g, s, n in sorted(rows, key=lambda r: -r[1] if descending else r[1]):
        acc[g] = acc.get(g, 0) + n
        want[(g, s)] = (acc[g], total[g])
    assert {(r["g"], r["s"]): (r["cum_n"], r["total_n"]) for r in got.collect()} == want


def test_hashes_do_not_depend_on_partitions(spark):
    ids = spark.range(500)
    cols = [hash_order(1, F.col("id")).alias("o"), hash_uniform(2, F.col("id")).alias("u")]
    one = {r["id"]: (r["o"], r["u"]) for r in ids.coalesce(1).select("id", *cols).collect()}
    many = {r["id"]: (r["o"], r["u"]) for r in ids.repartition(64).select("id", *cols).collect()}
    assert one == many
    assert 0.4 < sum(u for _, u in one.values()) / 500 < 0.6


def words(spark, n=700):
    rng = random.Random(9)
    rows = [(i, f"w{rng.randrange(400)}" if i % 10 else None, rng.choice("xyz")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id bigint, a string, b string").repartition(5)


def test_dense_codes_equal_sorted_position(spark):
    rows, df = words(spark)
    got = {(r["column"], r["value"]): r["code"] for r in dense_codes(distinct_values(df, ["a", "b"]).where("value is not null")).collect()}
    want = {("a", v): i for i, v in enumerate(sorted({r[1] for r in rows if r[1]}))}
    want |= {("b", v): i for i, v in enumerate("xyz")}
    assert got == want


def test_label_codes_with_and_without_inlining(spark):
    _, df = words(spark)
    inline = fit_label(df, ["a", "b"])
    stored = fit_label(df, ["a", "b"], max_inline=10)
    assert stored.tables and not inline.tables
    one = sorted(map(tuple, inline.transform(df).collect()))
    two = sorted(map(tuple, stored.transform(df).collect()))
    assert one == two


def test_one_hot_form_is_asked_for_never_chosen_by_size(spark, monkeypatch):
    rows, df = words(spark)
    short = fit_one_hot(df, ["b"]).transform(df).where("row_id = 1").collect()[0]
    assert short["b_x"] + short["b_y"] + short["b_z"] == 1.0
    with pytest.raises(ValueError, match="vector"):
        fit_one_hot(df, ["a", "b"], max_categories=10)
    values = {r[1] for r in rows}
    codes = [*sorted(v for v in values if v is not None), *([None] if None in values else [])]
    for limit in (10**6, 3):
        # a tiny limit sends the codes through a table; the slots stay the same
        monkeypatch.setattr("flowgauge.operators.fitted.pin_small", lambda d, *a: small.pin_small(d, limit))
        out = fit_one_hot(df, ["a", "b"], output="vector").transform(df)
        got = {r["row_id"]: (list(r["a_onehot"].indices), r["a_onehot"].size, r["b_onehot"].size) for r in out.collect()}
        assert got == {r[0]: ([codes.index(r[1])], len(codes), 3) for r in rows}


def test_unknown_values_encode_to_null_and_zeros(spark):
    seen = spark.createDataFrame([("x",), ("y",)], "a string")
    new = spark.createDataFrame([("z",)], "a string")
    assert fit_label(seen, ["a"]).transform(new).collect()[0]["a"] is None
    row = fit_one_hot(seen, ["a"]).transform(new).collect()[0]
    assert (row["a_x"], row["a_y"]) == (0.0, 0.0)
    assert isinstance(fit_one_hot(seen, ["a"]), Fitted)


def test_attach_without_broadcast(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    lookup = durable(spark.createDataFrame([("a", 10), (None, 20)], "k string, w int"))
    got = {r["v"]: r["w"] for r in small.attach(df, (lookup, False), ["k"]).collect()}
    assert got == {1: 10, 2: 20, 3: None}


@pytest.mark.parametrize("limits", [(1_000_000, 4096), (2, 4)])
@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf"), 1.7e308, -1.7e308, 5e-324])
def test_rank_search_ends_on_odd_doubles(spark, limits, odd):
    values = [float(i) for i in range(60)] + [odd, odd, -odd, 1.7e308]
    rows = [("g", v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, k double, t bigint").repartition(3)
    args = (df, ["g"], F.col("k"), F.col("t"))
    ranks = [1, 2, 30, 61, 62]
    targets = spark.createDataFrame([("g", r, r) for r in ranks], "g string, target int, rank bigint")
    got, _ = select_ranks(*args, group_ranges(*args), targets, *limits)
    kept = sorted((v, i) for _, v, i in rows if abs(v) < float("inf"))
    want = {r: kept[r - 1] if r <= len(kept) else (None, None) for r in ranks}
    assert {r["target"]: (r["cut_key"], r["cut_tie"]) for r in got.collect()} == want


@pytest.mark.parametrize("limits", [(1_000_000, 4096), (2, 4)])
def test_rank_search_ends_on_whole_extremes(spark, limits):
    low, high = -(2**63), 2**63 - 1
    keys = [low, low + 1, low + 2, high, high - 1, high - 2, 0, 1, 2**62, 2**62 + 1, 2**62 + 2]
    rows = [("g", k, t) for k in keys for t in (low, 7, high)]
    df = spark.createDataFrame(rows, "g string, k bigint, t bigint").repartition(3)
    args = (df, ["g"], F.col("k"), F.col("t"))
    targets = spark.createDataFrame([("g", r, r) for r in range(1, 34)], "g string, target int, rank bigint")
    got, _ = select_ranks(*args, group_ranges(*args), targets, *limits)
    ordered = sorted((k, t) for _, k, t in rows)
    assert {r["target"]: (r["cut_key"], r["cut_tie"]) for r in got.collect()} == {i + 1: p for i, p in enumerate(ordered)}


def test_percentile_of_extremes(spark):
    df = spark.createDataFrame([(v,) for v in [-1.7e308, 1.7e308, 0.0, 1.0, float("nan"), 2.0]], "a double")
    assert percentiles(df, ["a"], 0.5, 1, 4) == {"a": 1.0}
    assert percentiles(spark.createDataFrame([(-1.7e308,), (1.7e308,)], "a double"), ["a"], 0.5)["a"] == 0.0


@pytest.mark.parametrize("kind", ["double", "string"])
def test_timestamp_split_drops_rows_without_a_finite_time(spark, kind):
    from flowgauge.operators.splits import split_timestamp

    times = [float(i) for i in range(80)] + [float("nan")] * 10 + [float("inf")] * 5 + [None] * 5
    rows = [(i, t if kind == "double" or t is None else str(t)) for i, t in enumerate(times)]
    out = split_timestamp(spark.createDataFrame(rows, f"row_id bigint, t {kind}"), "t", 0.25, sort_rows=3, bins=4)
    assert {(r["split"], r["count"]) for r in out.groupBy("split").count().collect()} == {("train", 60), ("test", 20)}
