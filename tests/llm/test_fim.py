"""Fill-in-the-middle against plain slicing."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from flowgauge.llm import fim
from tests.llm.helpers import NASTY


def plain(key, text, rate, spm, seed=7):
    """(n, form, output, prefix_chars, middle_chars) by a regular expression."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    n = len(units)
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text or "", None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def texts():
    rng = random.Random(3)
    words = ["zeile", "é", "😀", "a<b", "<", "<P", "S>", "\r", "\x00", "die", "▁"]
    shared = "".join(rng.choice(words) + rng.choice(" \n") for _ in range(4000))
    out = [*NASTY, "\n", "\n\n\n", "a\n", "a\nb", "<P>", "x <M> y\nz", "<<P", "<S"]
    for n in (10, 300, 5000):
        out += ["".join(rng.choice(words) + rng.choice("  \n") for _ in range(n)) for _ in range(6)]
    out += [shared, shared, "new start\n" + shared, shared + "\nnew end", shared[:2000] + "<M>" + shared[2000:], "no line end " * 9000]
    return out


def test_forms_against_plain_ones(spark):
    rows = [(None if i % 9 == 8 else i, t, f"x{i}", "f") for i, t in enumerate(texts())] + [(3, "a\nb\n", "x", "f")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, form string").repartition(3)
    for rate, spm in ((100, 50), (60, 0), (100, 100), (0, 50)):
        got = fim.transform(df, rate=rate, spm=spm)
        assert got.columns == ["doc_id", "text", "tag", "n", "form", "output", "prefix_chars", "middle_chars"]
        got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        want = sorted(str((i, t, x, *plain(i, t, rate, spm))) for i, t, x, _ in rows)
        assert sorted(str(tuple(r)[:8]) for r in got) == want
        assert all(r["back"] == (r["text"] or "") for r in got)
    assert fim.transform(df.limit(0)).count() == 0


def test_chunks_cover_texts_and_follow_content():
    rng = np.random.default_rng(5)
    body = rng.integers(32, 127, 3 << 20, np.uint8).tobytes()
    ends = fim.chunk_ends(body)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(body) and sizes.max() <= fim.MOST and (sizes[:-1] >= fim.LEAST).all() and 1500 < sizes.mean() < 3500
    # blocks of hashing leave no trace, and copies behind another start share all later chunks
    h = [fim.possible_ends(body[i : i + fim.WINDOW])[-1:].tolist() for i in range(fim.BLOCK - 40, fim.BLOCK + 8)]
    whole = set(fim.possible_ends(body).tolist())
    assert [fim.WINDOW in x for x in h] == [i + fim.WINDOW in whole for i in range(fim.BLOCK - 40, fim.BLOCK + 8)]
    moved = b"another start " + body
    own = {body[a:b] for a, b in zip([0, *ends], ends)}
    other = fim.chunk_ends(moved)
    shared = sum(b - a for a, b in zip([0, *other], other) if moved[a:b] in own)
    assert shared > 0.99 * len(body)


def test_markers_over_edges_and_equal_hashes():
    rng = np.random.default_rng(6)
    body = rng.integers(97, 123, 40_000, np.uint8).tobytes()
    end = fim.chunk_ends(body)[2]
    for at in (end - 3, end - 2, end - 1, end):
        assert fim.Counts(body[:at] + b"<M>" + body[at:], fim.Chunks()).marked
    assert not fim.Counts(body, fim.Chunks()).marked

    class Same(fim.Chunks):
        """Every chunk under one key: only the check of the content keeps the summaries apart."""

        def summary(self, content):
            known = self.young.get(0)
            if known is None or known.content != content:
                self.young[0] = known = fim.Summary.of(content)
            return known

    lines = body.replace(b"q", b"\n")
    assert fim.Counts(lines, Same()).units == fim.Counts(lines, fim.Chunks()).units == len(re.findall(rb"[^\n]*\n|[^\n]+", lines))
    small = fim.Chunks(kept_bytes=5000)
    for _ in range(2):
        fim.Counts(lines, small)
    assert small.size <= 5000 + fim.MOST * 9
    kept = fim.Chunks()
    fim.Counts(lines, kept)
    fim.Counts(b"start\n" + lines, kept)
    assert kept.shared > 5
