import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowgauge.llm import simhash
from flowgauge.llm.components import components
from tests.llm.helpers import NASTY, fingerprint, groups

SF = "/root/testdata/sf0.001"


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def test_fingerprints_match_plain_ones(spark):
    rows = [(i, t) for i, t in enumerate([*NASTY, "A b C", "a B c", "a b c d", "one two"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.with_fingerprint(df).collect()}
    assert got == {i: signed(fingerprint(t)) for i, t in rows}


def test_groups_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prints = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    want = groups(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("blocks", [2, 3])
@pytest.mark.parametrize("anchor_rows", [2, 512])
def test_links_in_dense_balls(spark, blocks, anchor_rows):
    """A dense ball sends nearly all anchors over a small limit; both ways give the plain result."""
    rng = random.Random(blocks * 1000 + anchor_rows)
    centre, words = rng.getrandbits(64), set()
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5])):
            x ^= 1 << b
        words.add(x)
    words |= {rng.getrandbits(64) for _ in range(50)}
    prints = [(signed(x), x) for x in sorted(words)]
    df = spark.createDataFrame([(p,) for p, _ in prints], "fp long")
    found = {r["fp"]: r["root"] for r in simhash.link_fingerprints(df, blocks, anchor_rows).collect()}
    want = groups(prints)
    same = {}
    for p, _ in prints:
        assert same.setdefault(want[p], found.get(p, p)) == found.get(p, p)
    assert len(set(same.values())) == len(same)


def test_every_close_pair_shares_an_anchor():
    rng = random.Random(3)
    for blocks in (1, 2, 3):
        for _ in range(40):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.choice([1, 2])):
                y ^= 1 << b
            rows, anchor = simhash.anchors_of(np.array([x, y], np.uint64), blocks)
            assert set(anchor[rows == 0]) & set(anchor[rows == 1])


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 6), (None, "a b c d", 7), (4, None, 8), (3, "", 9), (None, "zz yy xx ww", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnsRenamed({}).withColumn("component_id", F.lit("x"))
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicate_groups(df).collect() if r["component_id"] is not None)
    assert got == [(-1, 1), (1, 1), (1, 1), (3, 3), (4, 3)]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3]
    empty = df.limit(0)
    assert simhash.near_duplicate_groups(empty).count() == 0 == simhash.drop_near_duplicates(empty).count()


def test_components_of_long_chains(spark):
    n = 200
    order = random.Random(5).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001), (1001, 1000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def _copies(rng: random.Random) -> list[tuple[int | None, str | None]]:
    """A dense group, chains of edits, texts with one common passage, short, blank and repeated texts."""
    vocabulary = [f"w{i}" for i in range(400)]

    def some(n: int) -> list[str]:
        return rng.choices(vocabulary, k=n)

    def edited(words: list[str], n: int) -> list[str]:
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    base, common = some(200), some(12)
    texts = [edited(base, rng.choice([1, 2, 4, 8])) for _ in range(60)]
    for _ in range(25):
        chain = some(rng.choice([6, 20, 60, 120]))
        for _ in range(4):
            texts.append(chain)
            chain = edited(chain, rng.choice([0, 1, 1, 2, 3]))
    texts += [common + some(rng.choice([1, 5, 40])) for _ in range(60)]
    texts += [some(3), some(5), ["one", "two"], ["ONE", "two"], [], common, common]
    rows = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(rows)
    return [*rows, (len(texts), None), (None, rows[0][1]), (None, "only here"), rows[0]]


def _kept_by_bits(rows):
    """Kept ids by comparing all pairs of fingerprints."""
    prints = [fingerprint(t) for _, t in rows]
    least = groups(list(enumerate(prints)))
    best = {}
    for k, (i, _) in enumerate(rows):
        best[least[k]] = min(best.get(least[k], (True, 0)), (i is None, i or 0))
    return sorted(-1 if none else i for none, i in best.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_the_stage(spark, seed):
    rows = _copies(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_dedup(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == _kept_by_bits(rows)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), SF).count() == 0
