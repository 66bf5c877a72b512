"""Sharding, exact search, archives and the pipeline."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowgauge.llm import decontam, hilbert, langid, sp_dropout, topk, warc
from flowgauge.llm.queries import QUERIES
from tests.llm.helpers import fingerprint, groups, hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
    place = hilbert.hilbert_index(points, bits)
    walk = points[:, np.argsort(place)]
    assert sorted(place) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_shards_of_the_table(spark):
    rows = QUERIES["op5_hilbert_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    assert len(rows) == len(texts)
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "rows", None)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shards_of_odd_rows(spark):
    rows = [(None, None, float("nan"), None)] * 3 + [(1, "a", 1.0, True)] * 5 + [(2, "b", None, False), (3, "a", float("inf"), True)]
    df = spark.createDataFrame(rows, "doc_id long, source string, x double, flag boolean").withColumn("shard", F.lit("q"))
    got = hilbert.hilbert_shards(df, ["source", "x", "flag"], 4)
    assert got.columns == ["doc_id", "source", "x", "flag", "curve", "shard", "slot"]
    sizes = sorted(r["count"] for r in got.groupBy("shard").count().collect())
    assert sizes == [2, 2, 3, 3] and got.select("shard", "slot").distinct().count() == 10
    assert hilbert.hilbert_shards(df.limit(0), ["source"], 4).count() == 0


def test_cuts_come_from_all_rows(spark):
    n = 60_000
    rows = spark.range(n, numPartitions=5).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 600 == 7, F.concat(F.lit("rare"), F.col("id"))).otherwise("common").alias("source"),
        F.pmod(F.col("id") * 7919, F.lit(n)).alias("x"),
        F.when(F.col("id") < n // 2, 0).otherwise(F.col("id") % 1000).cast("double").alias("hot"),
    )
    plain = [tuple(r)[1:] for r in rows.collect()]
    want = []
    for column in zip(*plain):
        values = sorted(column)
        few = sorted(set(values))
        want.append(few if len(few) <= 254 else sorted({values[k * n // 254] for k in range(254)}))
    # each rare value has a level of its own; levels of a column without repeats differ by one row at most
    assert hilbert.hilbert_shards(rows, ["source"], 4).select("curve").distinct().count() == 101 == len(want[0])
    sizes = [r["count"] for r in hilbert.hilbert_shards(rows, ["x"], 4).groupBy("curve").count().collect()]
    assert len(sizes) == 254 and max(sizes) - min(sizes) <= 1
    assert hilbert.level_cuts(rows, ["source", "x", "hot"], 8) == want


def test_files_prune(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    hilbert.write_shards(hilbert.hilbert_shards(docs, ["lang", "n_chars"], 8), str(tmp_path / "s"), 8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count()
    spans = back.groupBy("shard").agg(F.countDistinct("lang").alias("k")).collect()
    assert sum(r["k"] for r in spans) < 8 * 4 * 0.75


@pytest.mark.parametrize("block_rows", [4096, 37])
def test_search_against_all_scores(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=5).round(2)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, -0.5, 0.0, 1.0]) for i in range(300, 420)] + [(300, [0.5, 0.5, -0.5, 0.0, 1.0])]
    rows += [(None, [1.0] * 5), (500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, [2.0]), (600, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") % 50 == 0, block_rows=block_rows).collect())
    whole = {i: np.floor(1024 * np.array([*v, *[0.0] * (5 - len(v))])).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_walk_stops_early():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, (4000, 2))
    x[17] = (5000, 5000)
    query = topk.Query(-1, np.array([3.0, 2.0]), 1)
    seen = query.walk(np.arange(4000), x.astype(float), np.argsort(x, axis=0, kind="stable").T)
    assert query.ids.tolist() == [17] and seen < 400


def test_search_sends_no_vectors_through_the_driver(spark):
    rows = [(i, [float(i % 7), float(i % 11), -float(i % 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("id") % 10 == 0, block_rows=16)
    assert found.count() == 400 and len(found.collect()) == 400
    # a copy of each query for each slab: by the size of the table of queries this looked small enough to broadcast
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width, most", [(2, 1000), (48, 500), (48, 3), (3, 2**30)])
def test_slabs_and_blocks_of_queries_against_all_scores(width, most):
    rng = np.random.default_rng(width + most)
    x = rng.integers(-most, most, (900, width))
    x[:300] //= 1 + most // 7  # small numbers in one block, large ones in the others
    x[400:430] = x[400]
    ids = rng.permutation(2000)[:900]
    asked = np.flatnonzero(ids % 9 == 0)
    rows = []
    for slab in (0, 1):
        parts = [(False, p, True) for p in np.array_split(np.arange(900), 6)[slab::2]] + [(True, p, False) for p in np.array_split(asked, 4)]
        rows += [{"slab": slab, "asked": a, **topk._pack(ids[p], x[p], lists)} for a, p, lists in parts]
    kinds = pa.schema([("slab", pa.int64()), ("asked", pa.bool_()), ("ids", pa.binary()), ("x", pa.binary()), ("n", pa.int64()), ("lists", pa.binary())])
    got = {}
    for batch in topk._search(10, width)(pa.RecordBatch.from_pylist(rows[i : i + 3], kinds) for i in range(0, len(rows), 3)):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    exact = x.astype(object)
    for i in asked:
        want = sorted((-int(s), int(v)) for s, v in zip(exact @ exact[i], ids) if v != ids[i])[:10]
        assert len(got[ids[i]]) == 20 and sorted(got[ids[i]])[:10] == want


def test_archives_of_odd_pages(spark, tmp_path):
    long, mid = "é" * 3000 + "\r\n\r\nWARC/1.1\r\nX-Archive: no\r\n" + "z" * 50, "m" * 1000
    rows = [(1, "http://a", long), (2, "bad url\r\nX: y", long), (3, None, long), (3, None, long), (4, "u", mid), (None, "u", mid), (5, "u", mid[:-1]), (6, "u", mid[:-1]), (7, "u", None), (8, "u", ""), (9, "u", "\r\n" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha1", F.lit("x"))
    path = str(tmp_path / "w")
    got = warc.read_archives(spark, path, warc.write_archives(df, path, size=97)).collect()
    import hashlib

    body = lambda t: (t or "").encode()
    want = []
    for i, _, t in rows:
        same = [j for j, _, o in rows if body(o) == body(t) and j is not None]
        keeper = max(same) if len(body(t)) >= 1000 and same else None
        revisit = keeper is not None and keeper != i
        want.append((i or -1, len(body(t)), hashlib.sha1(body(t)).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r["page_id"] or -1, *list(r)[1:])) for r in got)
    chunks = warc.chunk_table(df, size=97)
    assert chunks.filter("octet_length(data) > 97").count() == 0
    empty = str(tmp_path / "e")
    assert warc.read_archives(spark, empty, warc.write_archives(df.limit(0), empty)).count() == 0


def test_payloads_beyond_a_batch_travel_as_chunks(spark, tmp_path):
    import hashlib

    big = "".join(f"{i} é\n" for i in range(1_800_000))
    rows = [(1, "u", big), (2, "u", big + "x"), (1, "u", big), (3, "u", big)] + [(k, "u", f"small {k}") for k in range(4, 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert len(big.encode()) > 2 * (8 << 20)
    path = str(tmp_path / "w")
    token = warc.write_archives(df, path)
    lines = spark.read.option("lineSep", f"WARC/1.1\r\nX-Archive: {token}\r\n").text(path)
    assert lines.agg(F.max(F.octet_length("value"))).first()[0] < 3 * warc.CHUNK_BYTES
    got = {}
    for r in warc.read_archives(spark, path, token).collect():
        got.setdefault(r["page_id"], []).append((r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    sha = hashlib.sha1(big.encode()).hexdigest()
    n = len(big.encode())
    assert got[1] == [(n, sha, "revisit", 3)] * 2 and got[3] == [(n, sha, "response", None)]
    assert got[2][0][:3] == (n + 1, hashlib.sha1(f"{big}x".encode()).hexdigest(), "response") and len(got) == 39


def test_damaged_archives_raise(spark, tmp_path):
    import glob
    import gzip

    df = spark.createDataFrame([(1, "u", "abc " * 500)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    token = warc.write_archives(df, path, size=100)
    for name in glob.glob(f"{path}/*.gz"):
        body = gzip.open(name).read()
        spoilt = tmp_path / "bad"
        spoilt.mkdir(exist_ok=True)
        with gzip.open(spoilt / name.rsplit("/", 1)[1], "wb") as out:
            out.write(body.replace(b"abc abc", b"abd abc", 1))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archives(spark, str(tmp_path / "bad"), token).collect()


def test_pipeline_against_plain_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "subwords"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = langid.train(docs, only=~langid.held_out())
    named = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    left = [i for i in sorted(rows) if rows[i] and re.search(r"[^\W\d_]", rows[i]) and named[i]["score"] >= 0.5]
    least = groups([(i, fingerprint(rows[i])) for i in left])
    left = [i for i in left if least[i] == i]
    left = [i for i in left if not hits(rows[i], items)[1]]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == left
    back = {r["doc_id"]: r["decoded"] for r in sp_dropout.decode(got).collect()}
    assert all(back[i] == rows[i] for i in left)
    assert decontam.WINDOW == 10


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, odd.limit(0), SF).count() == 0
