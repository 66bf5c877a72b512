"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per (language, hashed n-gram) are summed on Spark; the matrix of
log-probabilities (languages x ``BUCKETS`` floats, a fixed size per language) is
sent to the tasks, which score batches of texts with numpy. Texts are read whole,
long ones in overlapping pieces of ``PIECE`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import append, bound_batches, grown, require, segment_sums

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
PIECE = 1 << 18
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Languages a model may have; the matrix then stays below 128 MB.
MOST_LANGUAGES = 1000
#: Bound of the training sample, in documents.
TRAIN_ROWS = 100_000


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that overlap by one character less than the longest n-gram."""
    over = max(ORDERS) - 1
    for at in range(0, max(len(text), 1), PIECE):
        yield text[max(0, at - over) : at + PIECE]


def grams(text: str, first: bool) -> np.ndarray:
    """Buckets of all n-grams of a piece; n-grams wholly inside the overlap belong to the piece before."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    code = np.zeros(len(points) + 1, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x110000) + points[n - 1 :]
        if n in ORDERS:
            mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            skip = 0 if first else max(ORDERS) - n
            out.append((mixed >> np.uint64(49)).astype(np.int32)[skip:])
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def text_grams(text: str) -> Iterator[np.ndarray]:
    lowered = text.lower()
    for i, piece in enumerate(pieces(lowered)):
        yield grams(piece, i == 0)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # languages x buckets
    prior: np.ndarray


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    only: Column | None = None,
    max_rows: int = TRAIN_ROWS,
    alpha: float = 0.1,
    key: str = "doc_id",
) -> Model:
    """Fit on rows with a language and a text; ``only`` restricts them further.

    At most about ``max_rows`` rows are used, chosen by a hash of ``key``: with
    more labelled rows than that each is taken with the same chance. Repeated
    rows count as often as they come. Without any labelled row the model has no
    language and every text is then ``und``.
    """
    require(docs, text, lang, key)
    bound_batches(docs.sparkSession)
    usable = F.col(lang).isNotNull() & F.col(text).isNotNull()
    labelled = docs.filter(usable & only if only is not None else usable)
    n = labelled.select(lang).count()
    if n > max_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("train"), F.col(key)), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                seen[name] = seen.get(name, 0) + 1
                for part in text_grams(body):
                    total += np.bincount(part, minlength=BUCKETS)
        for name, total in sums.items():
            here = np.flatnonzero(total)
            cells = pa.array(np.concatenate([[-1], here]), pa.int32())
            values = pa.array(np.concatenate([[seen[name]], total[here]]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), cells, values], names=["lang", "bucket", "n"])

    counted = labelled.select(F.col(lang).cast("string"), text).mapInArrow(count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row per language: a list of at most BUCKETS cells
    rows = table.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    counts = np.zeros((len(rows), BUCKETS))
    docs_of = np.zeros(len(rows))
    for i, row in enumerate(rows):
        for bucket, n in row["cells"]:
            if bucket < 0:
                docs_of[i] = n
            else:
                counts[i, bucket] = n
    smooth = counts + alpha
    log_prob = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True)) if rows else counts
    prior = np.log(docs_of / docs_of.sum()) if rows else docs_of
    return Model([r["lang"] for r in rows], log_prob.astype(np.float32), prior)


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior probability for each text."""
    k = len(model.languages)
    joint = np.tile(model.prior, (len(texts), 1)) if k else np.zeros((len(texts), 0))
    known = np.array([bool(k and t and LETTER.search(t)) for t in texts], bool)
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if waiting:
            cells = np.concatenate(waiting)
            lengths = np.fromiter(map(len, waiting), np.int64, len(waiting))
            for j in range(k):
                np.add.at(joint[:, j], owners, segment_sums(model.log_prob[j][cells].astype(np.float64), lengths))
            waiting.clear()
            owners.clear()

    size = 0
    for i, text in enumerate(texts):
        if known[i]:
            for part in text_grams(text):
                waiting.append(part)
                owners.append(i)
                size += len(part)
                if size > 2_000_000:
                    flush()
                    size = 0
    flush()
    if not k:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = joint.argmax(axis=1)
    top = joint[np.arange(len(texts)), best]
    share = 1.0 / np.exp(joint - top[:, None]).sum(axis=1)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
    return names, np.where(known, share, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language of every text and its probability (0 to 1).

    A null text, or one without letters, is ``und`` with score 0. Ties go to the
    first language in text order. Columns named like the two new ones are replaced.
    """
    require(docs, text)
    bound_batches(docs.sparkSession)
    work = docs.select(*[c for c in docs.columns if c not in (out, score)])
    at = work.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, share = score_texts(batch.column(at).to_pylist(), sent.value)
            yield append(batch, **{out: pa.array(names, pa.string()), score: pa.array(share, pa.float64())})

    return work.mapInArrow(run, grown(work, f"`{out}` string, `{score}` double"))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """Only documents whose language is known with probability ``least``; columns stay as they are."""
    found = identify(docs, model, text, "__lang", "__score")
    return found.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).select(*docs.columns)
