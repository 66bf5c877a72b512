"""Whitening against a dense eigenvalue routine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import whitening
from flowgauge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def numbers(rows):
    return np.floor(1024 * np.array(rows, np.float64)) + 100_000


def check(got, rows, most):
    """got: id -> rows of the query's form; rows: id -> vector."""
    ids = sorted(rows)
    x = numbers([rows[i] for i in ids])
    n, mean = len(x), x.mean(axis=0)
    values, basis = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    want = (x - mean) @ basis / np.sqrt(values)
    have = np.array([got[i] for i in ids])
    signs = np.sign((have * want).sum(axis=0))
    assert np.allclose(have, want * signs, atol=1e-9)


def test_query_against_dense_eigenvectors(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    assert len(found) == 8 * len(rows)
    got = {i: [0.0] * 8 for i in rows}
    for r in found:
        got[r["vec_id"]][r["component"] - 1] = r["whitened"]
    check(got, rows, 8)
    x = numbers([rows[i] for i in rows]).astype(int).astype(object)
    far = dict(zip(rows, ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)))
    assert all(r["deviation"] == far[r["vec_id"]] and r["n"] == len(x) for r in found)
    values = np.linalg.eigvalsh(np.cov(numbers(list(rows.values())).T, bias=True))
    for r in found:
        assert abs(r["explained"] / (values[-r["component"]] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist(), 1.0, "w") for i in range(40)]
    odd = [(50, None, 1.0, "w"), (51, [1.0, None, 2.0], 1.0, "w"), (52, [float("nan"), 0.0, 0.0], 1.0, "w"), (53, [float("inf"), 0.0, 0.0], 1.0, "w")]
    odd += [(54, [1.0, 2.0], 1.0, "w"), (55, [], 1.0, "w"), (None, [0.5, 0.5, 0.25], 1.0, "w"), (3, good[3][1], 1.0, "w")]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, deviation double, whitened string").repartition(3)
    model = whitening.fit(df, components=8)
    assert (model.dim, model.n, len(model.values)) == (3, 42, 3)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened"] and out.count() == 42
    assert whitening.identity_error(df, model) < 1e-9
    empty = whitening.fit(df.limit(0))
    assert (empty.dim, empty.n) == (0, 0) and whitening.whiten(df.limit(0), empty).count() == 0 == whitening.identity_error(df.limit(0), empty)
    # vectors without spread have no component; the rows stay
    flat = df.filter("vec_id = 3").select("vec_id", "embedding")
    model = whitening.fit(flat)
    assert len(model.values) == 0 and [r["whitened"] for r in whitening.whiten(flat, model).collect()] == [[], []]


def test_exact_sums_of_far_entries(spark):
    rows = [(i, [100.5 * (i - 7), 3.0, 2.0**10 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    model = whitening.fit(df)
    x = numbers([v for _, v in rows]).astype(int).astype(object)
    far = ((30 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, model).collect()}
    assert got == {i: int(far[i]) for i, _ in rows}
    assert model.sums == x.sum(axis=0).tolist()
    # both moving dimensions rise together: one component only
    assert len(model.values) == 1
    beyond = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")
    # a deviation beyond a LONG is null
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(beyond, whitening.fit(beyond)).collect()} == {1: None, 2: None, 3: 200_000**2}


@pytest.mark.parametrize("kind", ["random", "repeated", "close", "rank", "zero", "identity", "one"])
def test_leading_eigenvalues(kind):
    rng = np.random.default_rng(2)
    d = 1 if kind == "one" else 40
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = np.linspace(5, 1, d)
    if kind == "repeated":
        e[:3], e[5:11] = 6, e[5]
    elif kind == "close":
        e[0], e[1], e[2] = 9, 9 - 2e-13, 9 - 1e-9
    elif kind == "rank":
        e[2:] = 0
    elif kind == "zero":
        e[:] = 0
    elif kind == "identity":
        e[:] = 2
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors, counts = whitening.leading(v, 8)
    wanted = min(8, int((e > 0).sum()))
    assert len(values) == wanted and vectors.shape == (d, wanted)
    assert np.allclose(values, np.sort(e)[::-1][:wanted], atol=1e-12, rtol=0)
    assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max(initial=0) < 1e-11
    assert all(c >= k for k, c in enumerate(counts, 1)) and (kind != "random" or counts == list(range(1, wanted + 1)))
    for shift in (-1.0, 0.5, 1.7, 4.9, 7.0):
        if np.abs(e - shift).min() > 1e-9:
            assert whitening.inertia(v, shift) == (e > shift).sum()


def test_queries_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding"))
    a, b = (whitening.fit(df.repartition(k)) for k in (1, 7))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.values, b.values)
