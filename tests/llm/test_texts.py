import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from flowgauge.llm import decontam, html_text, langid, license_scan, lm_backoff, sp_dropout
from flowgauge.llm.queries import QUERIES
from tests.llm.helpers import NASTY, hits

SF = "/root/testdata/sf0.001"


def nasty(spark, extra=""):
    rows = [(i if i % 4 else None, t, "z", "en") for i, t in enumerate([*NASTY, NASTY[3], NASTY[3]])]
    return spark.createDataFrame(rows, "doc_id long, text string, __w string, lang string")


# --- language


def test_language_on_held_out_documents(spark):
    got = QUERIES["op2_language_id"](spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tried = [r for r in got if r["held_out"]]
    assert len(got) == 200 and len(tried) > 40
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tried) >= 0.98 * len(tried)
    assert all(0.0 <= r["score"] <= 1.0 for r in got)


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.train(d, only=~langid.held_out()) for d in (docs, spoilt))
    assert a.languages == b.languages and np.array_equal(a.log_prob, b.log_prob)


def test_language_of_odd_texts(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert langid.score_texts(["½ Ⅷ² 7_", "ß"], model)[0][0] == "und" != langid.score_texts(["ß"], model)[0][0]
    df = nasty(spark).withColumn("score", F.lit(7))
    got = langid.identify(df, model)
    assert got.columns == [*[c for c in df.columns if c != "score"], "lang_pred", "score"]
    for r in got.collect():
        known = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not known) and (known or r["score"] == 0.0)
    assert langid.identify(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}
    assert langid.keep_identified(df, model).columns == df.columns


def test_pieces_do_not_change_grams(monkeypatch):
    text = "the quick brown fox " * 20
    whole = np.sort(np.concatenate([*langid.text_grams(text)]))
    monkeypatch.setattr(langid, "PIECE", 17)
    assert np.array_equal(np.sort(np.concatenate([*langid.text_grams(text)])), whole)


# --- decontamination


@pytest.mark.parametrize("shard_words, block_bytes", [(1_000_000, 8 << 20), (50, 60)])
def test_matches_against_plain_search(spark, shard_words, block_bytes):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item here"), (None, "null id item"), (4, None), (5, "?!"),
             (6, "four five six seven eight nine ten eleven one two three"), (6, "short ITEM here")]
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", "!?", base, f"x {base} y short-item here", "short item", f"{base} {base}", "null id item null id item", "two three four five six seven eight nine ten",
             "one two three four five six seven eight nine ten eleven one two three", "é ü short item here"]
    docs = spark.createDataFrame([(i, t, 1, "m") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_matches(docs, bench, shard_words=shard_words, block_bytes=block_bytes)
    named = [("null" if i is None else i, t) for i, t in items]
    for r in found.withColumn("n_hit", decontam.covered_words()).collect():
        n, hit, ids = hits(texts[r["doc_id"]], named)
        assert (r["n_words"], r["n_hit"], {m["item"] for m in r["matches"]}) == (n, hit, ids), texts[r["doc_id"]]
    longest = found.filter("doc_id = 4").select(F.explode("matches").alias("m")).filter("m.item = '1'").select("m.*").collect()
    assert [tuple(m) for m in longest] == [("1", 11, 1, 0)]
    kept = decontam.decontaminate(docs, bench, shard_words=shard_words)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 5, 8]
    assert decontam.find_matches(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_suffix_order_and_search():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 3, 400)
    array = decontam.SuffixArray(ids, 2, 10)
    padded = np.concatenate([ids, np.zeros(20, np.int64)])
    keys = [tuple(padded[i : i + 10]) for i in array.order]
    assert keys == sorted(keys)
    windows = np.array([padded[i : i + 6] for i in range(0, 300, 7)])
    low, high = array.find(windows)
    for w, a, b in zip(windows, low, high):
        assert sorted(array.order[a:b]) == [i for i in range(400) if tuple(padded[i : i + 6]) == tuple(w)]


# --- subwords


def test_no_dropout_is_the_usual_segmentation(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=sp_dropout.MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for r in sp_dropout.encode(docs, dropout=0.0).collect():
        assert r["ids"] == model.encode(r["text"])


def test_dropout_varies_and_decodes(spark):
    docs = nasty(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "text", F.lit("q").alias("__w"), "lang"))
    docs = docs.withColumn("ids", F.lit("clash"))
    one, two = (sp_dropout.encode(docs, seed=s) for s in (1, 2))
    for df in (one, two):
        assert sp_dropout.decode(df).filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    a, b = (sorted(map(str, df.select("doc_id", "ids").collect())) for df in (one, two))
    assert a != b and a == sorted(map(str, sp_dropout.encode(docs.repartition(7), seed=1).select("doc_id", "ids").collect()))
    tried = sp_dropout.encode(docs, seed=1, verify="ok")
    assert {r["ok"] for r in tried.filter("text is not null").collect()} == {True}
    assert tried.filter("text is null").first()["ok"] is None
    assert one.filter("text is null").first()["ids"] is None and one.filter("text = ''").first()["ids"] == []
    assert sp_dropout.encode(docs.limit(0)).count() == 0


def test_remembered_paths_give_what_the_agenda_gives():
    """Units merged together by remembered paths come out as each by itself, whatever is remembered."""
    import random

    rng = random.Random(1)
    units = [" " + "".join(rng.choice("etaoinéß\n9") for _ in range(rng.randint(0, 45))) for _ in range(600)]
    units += [" internationalisation", " aaaaaaaaaaaaaaaa", "𓀀y", "   ", "   x", "a▁b", "", " "]
    units *= 3
    for dropout, kept in ((0.0, 10**6), (0.2, 10**6), (0.2, 50), (1.0, 10**6)):
        segmenter = sp_dropout.Segmenter(sp_dropout.Vocabulary(), dropout, 3, kept)
        draws = segmenter.draws([5], [len(units)])
        for _ in range(2):
            flat, sizes = segmenter.merge(units, draws)
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for unit, draw, ids in zip(units, draws.tolist(), parts):
                assert ids.tolist() == segmenter.by_heap(unit, draw), unit


def test_common_units_stay_remembered(monkeypatch):
    """Beyond the limit units met once are forgotten; those of every batch are found once only, and ids stay those of the agenda."""
    asked = []
    roots = sp_dropout.Segmenter._roots
    monkeypatch.setattr(sp_dropout.Segmenter, "_roots", lambda self, units: asked.extend(units) or roots(self, units))
    segmenter = sp_dropout.Segmenter(sp_dropout.Vocabulary(), 0.1, 3, 1500)
    common = [f" {a}{b}" for a in ("inter", "over", "un", "re", "sub") for b in ("nation", "house", "view", "water", "  x", "\u4e00ne")]
    for k in range(20):
        units = common * 2 + [f" once{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
        draws = segmenter.draws([k], [len(units)])
        flat, sizes = segmenter.merge(units, draws)
        for unit, draw, ids in zip(units, draws.tolist(), np.split(flat, np.cumsum(sizes)[:-1])):
            assert ids.tolist() == segmenter.by_heap(unit, draw), unit
    assert len(asked) == len(set(asked)) == len(common) + 20 * 200
    assert segmenter.unit.n < 3000 and set(common) < set(segmenter.roots) and len(segmenter.roots) < 2000


def test_candidates_are_drawn_one_by_one():
    """Any two candidates are skipped together as often as independent ones, and all segmentations that these give occur."""
    import random
    from collections import Counter

    segmenter = sp_dropout.Segmenter(sp_dropout.Vocabulary(), 0.1, 3)
    draws = segmenter.draws([1], [10**6])
    candidates = [0 << 20 | 2, 1 << 20 | 2, 2 << 20 | 2, 0 << 20 | 3, 1 << 20 | 3, 0 << 20 | 4, 3 << 20 | 2, 3 << 20 | 5, 5 << 20 | 2, 9 << 20 | 7]
    skips = np.array([segmenter._skips(draws, np.full(1, c, np.uint64)) for c in candidates])
    together = (skips.astype(np.float32) @ skips.T.astype(np.float32)) / 10**6
    assert (np.abs(np.diag(together) - 0.1) < 0.002).all()
    assert (np.abs(together[~np.eye(10, dtype=bool)] - 0.01) < 0.001).all()
    # also from one occurrence of a candidate to the next in a document
    assert abs((skips[0][1:] & skips[0][:-1]).mean() - 0.01) < 0.001
    rng = random.Random(2)
    for i, word in enumerate((" between", " house", " water", " the", " nation", " internationalisation")):
        n = 60_000
        flat, sizes = segmenter.merge([word] * n, segmenter.draws([i], [n]))
        seen = Counter(tuple(x) for x in np.split(flat, np.cumsum(sizes)[:-1]))
        plain = Counter(tuple(segmenter._agenda(word, lambda c: rng.random() < 0.1)) for _ in range(n))
        # as often as by a plain random merge, and no fewer kinds
        assert all(abs(plain[k] - seen[k]) <= 6 * m**0.5 for k, m in (plain + seen).items()), word
        assert len(seen) >= 0.8 * len(plain) and len(seen) > 5, (word, len(seen), len(plain))


def test_every_occurrence_draws_its_own_merges(spark):
    """The same word in many documents, and many times in one, is cut in many ways, more than any fixed few."""
    word = "internationalisation"
    docs = spark.createDataFrame([(i, word) for i in range(300)], "doc_id long, text string").union(
        spark.createDataFrame([(None, word + "s"), (1000, " ".join([word] * 300))], "doc_id long, text string")
    )
    rows = {r["doc_id"]: r["ids"] for r in sp_dropout.encode(docs, dropout=0.3, seed=5).collect()}
    across = {tuple(ids) for i, ids in rows.items() if i is not None and i < 300}
    assert len(across) > 20
    surface, within, cut = sp_dropout.Vocabulary().surface, set(), []
    for i in rows[1000]:
        if surface[i].startswith(b" ") and cut:
            within.add(tuple(cut))
            cut = []
        cut.append(i)
    assert len(within) > 20


# --- pages


def test_training_pages_are_told_apart():
    x, y = html_text.labelled_table()
    assert (html_text.keep_of(html_text.grow_tree(x, y), x) == y).mean() >= 0.97


def test_extraction(spark):
    long = "The river rose in the night and by the morning the lower streets of the town were under water. "
    pages = {
        1: (f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Flood</h1><p>{long}</p><p>It<b>al</b>ics &amp; more&nbsp;text</p><p>End.</p></article>"
            "<div class='comments'><p>First!</p></div><footer>&copy; us</footer>", f"Flood {long}Italics & more text End."),
        2: (None, ""), 3: ("", ""), 4: ("<script>var a = '<p>no</p>';</script>", ""),
        5: (f"<p>{long}<!-- <p>gone</p> --><p>{long}<style>p{{}}</style>", f"{long}{long}".strip()),
        6: (f"<article><p>{long}<br>Short<form><p>{long}</p></form></article><aside>{long}</aside>", f"{long}Short"),
        7: ("<", ""),
        8: (f"<div class=siteHeader><p>{long}</p></div><div class='story-body'><div class='entry-header'><h2>Tide</h2></div><p>Up.</p><p hidden>{long}<p>Down.<p hidden>{long}</p>"
            f"<div id=readerComments><p>{long}</p></div><div style='display: none'>{long}</div><p>{long}</p></div>", f"Tide Up. Down. {long}".strip())}  # fmt: skip
    df = spark.createDataFrame([(i, "u", p, 1) for i, (p, _) in pages.items()], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert {i: got[i] for i in pages if i != 7} == {i: t for i, (_, t) in pages.items() if i != 7}
    assert html_text.extract(df.limit(0)).count() == 0


def test_names_of_wrappers_do_not_lose_the_article():
    tree = html_text.grow_tree(*html_text.labelled_table())
    long = "The committee met on Tuesday to discuss the plan in detail and agreed to publish a full report."
    article = f"<article><h1>A plan</h1><p>{long}</p></article>"
    text = f"A plan {long}"
    for page in (
        f"<body class='no-sidebar'>{article}</body>",
        f"<body class='sidebar header-fixed'>{article}</body>",
        f"<div class='content-with-sidebar'><div class=sidebar><p>{long}</p></div>{article}</div>",
        f"<article class='post has-comments'><h1>A plan</h1><p>{long}</p></article>",
        f"<div class='social page'><div class=modal>{article}</div><div class=ad>{long}</div></div>",
        f"<form action=x>{article}</form>",
        f"{article}<div id=comments><article class=comment><p>{long}</p></article></div>",
        "<article>" + "<div>" * 6000 + f"<h1>A plan</h1><p>{long}</p>" + "</div>" * 6000 + f"</article><div class=footer>{long}</div>",
        "<div class=related>" + "<div>" * 6000 + f"<p>{long}</p>" + "</div>" * 6000 + f"</div>{article}",
    ):
        assert html_text.main_text(page, tree) == text, page[:80]


def test_what_stands_beside_the_article_is_left_out():
    tree = html_text.grow_tree(*html_text.labelled_table())
    long = "The committee met on Tuesday to discuss the plan in detail and agreed to publish a full report."
    other = "Readers wrote many long letters about this in the days after and they were all of one mind."
    article, text = f"<article><h1>A plan</h1><p>{long}</p></article>", f"A plan {long}"
    card = f"<article><h3>More</h3><p>{other}</p></article>"
    pages = {
        f"{article}<section class=comments>{card}{card}</section>": text,
        f"<section class=comments>{card}</section>{article}": text,
        f"<article><h1>A plan</h1><p>{long}</p><section class=comments>{card}</section></article>": text,
        f"{article}<article class=comment><p>{other}</p></article>": text,
        f"<article class='comment'><p>{other}</p></article>": "",
        f"<main>{article}</main><article class=reply><p>{other}</p></article>": text,
        f"{article}<div class=related>{card}{card}</div>": text,
        f"{article}<article class=related-card><p>{other}</p></article>": text,
        f"<div class=sidebar>{card}</div>{article}": text,
        f"<main><h1>A plan</h1><p>{long}</p></main><div class=sidebar>{card}</div>": text,
        f"<div><h1>A plan</h1><p>{long}</p><p>{long}</p></div><section class=comments>{card}</section>": f"{text} {long}",
        f"{article}<div class=menu><div class=related>{card}</div><p>{other}</p></div>": text,
        f"<article><h1>A plan</h1><p>{long} <span class=ad>Buy <span>one</span> now</span>Really.</p></article>": f"{text} Really.",
        f"<article><h1>A plan</h1><p>{long}<span hidden>x</span></p><p><b style='display:none'>y</b></p></article>": text,
        f"<article><h1>A plan</h1><span class=ad><p>Buy.</p><p>{other}</p></span><p>{long}</p></article>": text,
        f"<article><h1>A plan</h1><p>So <span class=ad>buy</p><p>{long}</p></article>": f"A plan So {long}",
        f"<article><h1>A plan</h1><p title=\"it's>{long}</p></article>": text,
    }
    for page, want in pages.items():
        assert html_text.main_text(page, tree) == want, page[:90]


@pytest.mark.parametrize("unit", ["<template>x", '<a <a "', "<script", "<div class=sidebar>", "<span class=ad>", "<form><article>", "<div class=related><article>", "<!-- ", "' \" <p '"])
def test_broken_pages_take_time_by_their_length(unit):
    import time

    tree = html_text.grow_tree(*html_text.labelled_table())
    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        html_text.main_text(unit * n, tree)
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.2


def test_articles_of_the_table(spark):
    rows = QUERIES["op3_html_extraction"](spark, SF).collect()
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows:
        inner = raw[r["page_id"]].split("<article>")[1].split("</article>")[0]
        plain = html_text.entities.unescape(html_text.re.sub(r"</?(?:p|h1|br)>", " ", html_text.re.sub(r"</?b>", "", inner)))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])


# --- language model


def test_backoff_edges(spark):
    df = nasty(spark).withColumn("id", F.lit(1))
    got = lm_backoff.backoff_scores(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r["n_tokens"] > 0) == (r["log_score"] < 0) or r["n_tokens"] == 0 == r["log_score"]
    assert lm_backoff.backoff_scores(df.limit(0)).count() == 0


def test_backoff_of_order_three(spark):
    texts = ["a b c", "a b c d", "a b d", "c a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_backoff.backoff_scores(df, order=3, chunk_bytes=4).collect()}
    ln = np.log
    n = 13
    assert got[1]["log_score"] == pytest.approx(ln(4 / n) + ln(4 / 4) + ln(2 / 4) + 2 * ln(0.4) + ln(2 / n))
    assert got[1]["n_backoff"] == 1 and got[1]["n_tokens"] == 4
    assert got[3]["log_score"] == pytest.approx(ln(3 / n) + ln(0.4) + ln(4 / n) + ln(0.4) + ln(4 / 4))


def test_registered_trigrams_match_plain_counts(spark):
    """The registered query of order 3 on a given table, by plain dictionaries."""
    import math
    from collections import Counter

    from flowgauge.llm import queries

    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    grams = [Counter(tuple(w[i : i + n]) for w in docs.values() for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(grams[0].values())
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_stupid_backoff_trigrams"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for doc, w in docs.items():
        score, backed = 0.0, 0
        for i in range(len(w)):
            n, lost = min(3, i + 1), 0
            while n > 1 and grams[n - 1][tuple(w[i - n + 1 : i + 1])] < 2:
                n, lost = n - 1, lost + 1
            below = grams[n - 2][tuple(w[i - n + 1 : i])] if n > 1 else total
            score += lost * math.log(0.4) + math.log(grams[n - 1][tuple(w[i - n + 1 : i + 1])] / below)
            backed += lost > 0
        r = got[doc]
        assert (r["n_tokens"], r["n_backoff"]) == (len(w), backed) and abs(r["log_score"] - score) < 1e-3


def test_planes_round_trip():
    x = np.array([1, 2**40, 2**63 + 5], np.uint64)
    assert np.array_equal(lm_backoff.unplanes(lm_backoff.planes(x), np.uint64), x)


# --- licences


def test_licences(spark):
    model = license_scan.train(spark)
    filler = "thon eran heed of the inent and others were seen " * 30
    rows = [
        (1, "Nothing here.\nReleased under the MIT License.\nMore."), (2, None), (3, ""), (4, filler + "Licensed under the Apache License, Version 2.0. " + filler),
        (5, "You need a driving license to rent a car in this town."), (None, "This work is licensed under the GNU General Public License, version 3."),
        (6, filler), (7, "zq xv"), (8, "LICENSED UNDER CC BY-NC 4.0."), (8, "LICENSED UNDER CC BY-NC 4.0.")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, probability double")
    got = license_scan.scan(df, model)
    found = sorted((r["doc_id"] or -1, r["paragraph"], r["family"], r["confirmed"]) for r in got.collect() if r["doc_id"] != 4)
    assert found == [(-1, 0, "GPL", True), (1, 1, "MIT", True), (8, 0, "CC-BY-NC", True), (8, 0, "CC-BY-NC", True)]
    assert {r["family"] for r in got.filter("doc_id = 4 and confirmed").collect()} == {"Apache-2.0"}
    assert license_scan.scan(df.limit(0), model).count() == 0
    assert not any(word in got._jdf.queryExecution().toString() for word in ("Python", "Pandas", "Arrow"))


def test_licences_held_out(spark):
    """Planted notices of the table are found, and nothing else is."""
    docs = {r["doc_id"]: (r["text"] or "").split("\n") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r["doc_id"], r["paragraph"]) for r in QUERIES["op8_license_scan"](spark, SF).collect()}
    want = {(i, k) for i, lines in docs.items() for k, l in enumerate(lines) if "icense" in l}
    assert want <= got and all("eserved" in docs[i][k] for i, k in got - want)
