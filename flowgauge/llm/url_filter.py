"""URL filter: rules by host and path, else a character language-model ratio.

Two smoothed Markov models over the signs of host and path, one of accepted and
one of rejected URLs, are kept as one table: a row per context of up to three
signs with the difference of log-likelihoods of every sign that may follow. The
order varies: a context is kept if it holds a given share of all positions, a share
of zero keeps every context met in training, and a longer context that is not kept
falls back to its end. There are at most 34,916 contexts of these signs at any size
of the training table, and 1024 an order with a share of 1/1024. Probabilities
interpolate all shorter orders (Witten-Bell). Differences are whole numbers (units
of 2**-20), so sums do not depend on the order of rows.

Training, calibration and scoring are DataFrame operations only.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import require, stored

ORDER = 3
#: Unless another share is given, a context is kept if it holds this share of the training positions.
SHARE = 1.0 / 1024
UNIT = 1 << 20
#: Signs that a model tells; "$" ends a text, "0" is any run of digits, "~" any other sign.
SIGNS = "abcdefghijklmnopqrstuvwxyz0/.-_~$"
START = "^" * ORDER
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Width of a bar of the calibration's histogram, and the range it covers, in nats a sign.
BAR, RANGE = 0.01, 8.0
#: Hosts are dealt into so many parts; each is scored by a model of the others.
PARTS = 3

#: Words of hosts that a filter accepts, and of those that it rejects.
ACCEPTED = (
    "academy archive arts astronomy author baker bank biology board books botany bridge builder business camera campus chemistry "
    "church city climate clinic coast college company cooking council craft culture daily data design dictionary doctor earth "
    "economy editor education energy engineer family farming field film fisher forest forum garden geology guide harbour health "
    "history home hospital house institute island journal kitchen lab lake language law letters library light magazine market math "
    "medicine mountain museum music nature news notes ocean opera painter paper parent physics planet poetry press project radio "
    "reader recipe record research review river school science sea society sport station stone story student studio teacher theatre "
    "thread town travel tribune university valley village voice water weather weekly wiki winter world writer"
).split()
REJECTED = (
    "adserver ads adult banner bet bets bonus bookie cam cash casino cheap cialis click clickbait coupon crack deals debt "
    "dating diet discount download drugs escort fake fast-cash farm followers free gamble gambling hack hookup hot jackpot keygen "
    "likes loan loans lottery lucky malware meds naked nude offer payday pharmacy phish pills pirate poker popup porn prize promo "
    "proxy redirect replica roulette seo sex slots spam spins spyware swindle torrent track tracker tracking traffic viagra warez "
    "webcam win winner x xxx"
).split()


@dataclass
class Rule:
    """Allow or block the URLs of a host and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, line: str) -> Rule:
        """From a line like ``block example.com/en/``."""
        verdict, place = line.split()
        host, slash, path = place.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        return cls(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null; of rules of equal length block goes first."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict == "allow", r.name))

    def pick(value: str) -> Column:
        found = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), getattr(r, value)) for r in ordered]
        return F.coalesce(*found, F.lit(None).cast("string"))

    return pick("name"), pick("verdict")


# --- model --------------------------------------------------------------------------


def judged(host: Column, path: Column) -> Column:
    """The text that a model reads: lower case, a run of digits as one, other signs as one kind; null if empty."""
    plain = F.regexp_replace(F.translate(F.concat(host, path), UPPER, LOWER), "[0-9]+", "0")
    return F.nullif(F.regexp_replace(plain, "[^a-z0/._-]", "~"), F.lit(""))


def _positions(rows: DataFrame, text: str, *kept: str) -> DataFrame:
    """A row per sign of each text, its end included: ``sign`` and the context ``c`` of three signs before it."""
    signs = rows.select(*kept, F.split(F.concat(F.lit(START), F.col(text), F.lit("$")), "").alias("__signs"))
    window = F.transform(
        F.sequence(F.lit(1), F.size("__signs") - ORDER),
        lambda i: F.struct(F.array_join(F.slice("__signs", i, ORDER), "").alias("c"), F.get("__signs", i + ORDER - 1).alias("sign")),
    )
    return signs.select(*kept, F.inline(window))


def _tail(order: int) -> Column:
    return F.substring("c", ORDER - order + 1, order) if order else F.lit("")


def _counts(side: str) -> Column:
    """One count for each of SIGNS, from the entries of a context."""
    none = F.lit(0).cast("long")
    return F.transform(F.array(*[F.lit(s) for s in SIGNS]), lambda s: F.coalesce(F.try_element_at("entries", s)[side], none)).alias(side)


def smooth(counts: Column, shorter: Column) -> Column:
    """Witten-Bell: the counts of a context, one for each of SIGNS, interpolated with the next shorter one."""
    kinds = F.greatest(F.lit(1), F.size(F.filter(counts, lambda n: n > 0)))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda x, n: x + n)
    return F.zip_with(counts, shorter, lambda n, p: (n + kinds * p) / (total + kinds))


@dataclass
class Model:
    """Rows of (context, ratio): log-likelihood of each sign under rejection less that under acceptance."""

    table: DataFrame
    threshold: float


def _grams(texts: DataFrame) -> DataFrame:
    """``texts``: (text, accepted, part). A row per part, context of three signs and sign, counted on all rows."""
    side = {"g": F.col("accepted"), "b": ~F.col("accepted")}
    grams = _positions(texts, "text", "accepted", "part").groupBy("part", "c", "sign").agg(*[F.count_if(c).alias(k) for k, c in side.items()])
    return stored(grams, "url-grams")


def _fit(grams: DataFrame, share: float) -> dict[int, DataFrame]:
    """Models by the part that they leave out, PARTS for none; a model that lacks a class is not there."""
    models = F.array(*[F.when(F.col("part") != k, k) for k in range(PARTS)], F.lit(PARTS))
    grams = grams.select("c", "sign", "g", "b", F.explode(models).alias("model")).filter("model is not null")
    totals = grams.groupBy("model").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).collect()
    least = {r["model"]: (r["g"] + r["b"]) * share for r in totals if r["g"] and r["b"]}
    if not least:
        return {}
    # a context has at most one entry a sign
    each = grams.select("model", F.explode(F.array(*[_tail(k) for k in range(ORDER + 1)])).alias("context"), "sign", "g", "b")
    pairs = each.groupBy("model", "context", "sign").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    entries = F.map_from_entries(F.collect_list(F.struct("sign", F.struct("g", "b")))).alias("entries")
    rows = pairs.groupBy("model", "context").agg(entries, F.sum(F.col("g") + F.col("b")).alias("weight"))
    enough = reduce(lambda x, y: x | y, [(F.col("model") == k) & (F.col("weight") >= w) for k, w in least.items()])
    kept = stored(rows.filter(enough).select("model", "context", _counts("g"), _counts("b")), "url-counts")
    flat = F.array(*[F.lit(1.0 / len(SIGNS))] * len(SIGNS))
    told = [kept.filter("context = ''").select("model", "context", smooth(F.col("g"), flat).alias("g"), smooth(F.col("b"), flat).alias("b"))]
    for order in range(1, ORDER + 1):
        # what ends a kept context is kept
        shorter = told[-1].select("model", F.col("context").alias("__end"), F.col("g").alias("__g"), F.col("b").alias("__b"))
        longer = kept.filter(F.length("context") == order).withColumn("__end", F.substring("context", 2, ORDER)).join(shorter, ["model", "__end"])
        told.append(longer.select("model", "context", smooth(F.col("g"), F.col("__g")).alias("g"), smooth(F.col("b"), F.col("__b")).alias("b")))
    ratio = F.zip_with("b", "g", lambda b, g: F.round(F.log(b / g) * UNIT).cast("long"))
    found = stored(reduce(DataFrame.unionAll, told).select("model", "context", ratio.alias("ratio")), "url-model")
    return {k: found.filter(F.col("model") == k).drop("model") for k in least}


def _scores(texts: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """(key, score): mean difference a sign of the rows of each key, which all hold one text."""
    positions = _positions(texts, "__text", *key)
    index = F.instr(F.lit(SIGNS), F.col("sign"))
    found = []
    for order in range(ORDER + 1):
        part = table.filter(F.length("context") == order).select(F.col("context").alias(f"__c{order}"), F.col("ratio").alias(f"__r{order}"))
        if order:
            positions = positions.join(F.broadcast(part), _tail(order) == F.col(f"__c{order}"), "left")
            found.append(F.get(f"__r{order}", index - 1))
        else:
            base = part.select(f"__r{order}").first()[0]
            found.append(F.get(F.array(*[F.lit(x).cast("long") for x in base]), index - 1))
    told = positions.select(*key, F.coalesce(*reversed(found)).alias("__d"))
    return told.groupBy(*key).agg((F.sum("__d") / F.count("__d") / UNIT).alias("score"))


def _threshold(scored: DataFrame, most_false: float) -> float:
    """The middle of the bars that part held-back URLs best, with at most ``most_false`` of the accepted ones beyond."""
    bar = F.floor(F.least(F.greatest(F.col("score"), F.lit(-RANGE)), F.lit(RANGE)) / BAR).cast("int")
    bars = {(r["bar"], r["accepted"]): r["n"] for r in scored.groupBy(bar.alias("bar"), "accepted").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = (sum(n for (_, a), n in bars.items() if a is side) for side in (True, False))
    if not good or not bad:
        return 0.0
    above, below = good, bad
    best, at = (-1.0, 0), []
    for edge in range(round(-RANGE / BAR), round(RANGE / BAR) + 1):
        gain = (below / bad - above / good, -above) if above <= most_false * good else (-1.0, 0)
        if gain > best:
            best, at = gain, [edge]
        elif gain == best:
            at.append(edge)
        above -= bars.get((edge, True), 0)
        below -= bars.get((edge, False), 0)
    # edges beyond the last held-back URL tell nothing
    return at[len(at) // 2] * BAR if at else math.inf


def train(labelled: DataFrame, url: str = "url", accepted: str = "accepted", most_false: float = 0.005, share: float = SHARE) -> Model:
    """Fit on labelled URLs, counted on all rows. All of them calibrate the threshold as well.

    Contexts that hold less than ``share`` of the positions are told by their ends.

    Hosts are dealt into three parts by hash, and each part is scored by a model of
    the other two; where these lack a class, no model can hold that part back.
    Rows without a label or without ``://`` are not used.
    """
    require(labelled, url, accepted)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    part = F.pmod(F.xxhash64(host), F.lit(PARTS)).cast("int")
    texts = labelled.select(judged(host, path).alias("text"), F.col(accepted).cast("boolean").alias("accepted"), part.alias("part"))
    texts = texts.filter(F.col("text").isNotNull() & F.col("accepted").isNotNull())
    models = _fit(_grams(texts), share)
    if PARTS not in models:
        raise ValueError("a model needs accepted and rejected URLs")
    held = texts.select(F.col("text").alias("__text"), "accepted", F.sha2("text", 256).alias("__key"), "part")
    scored = [_scores(held.filter(F.col("part") == k), models[k], "__key", "accepted") for k in range(PARTS) if k in models]
    return Model(models[PARTS], _threshold(reduce(DataFrame.unionAll, scored), most_false) if scored else 0.0)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, accepted) from the word lists: each word alone, with the next one, and with one further on, in like surroundings."""
    rows = []
    for words, accepted in ((ACCEPTED, True), (REJECTED, False)):
        for i, word in enumerate(words):
            names = (word, f"{word}-{words[(i + 1) % len(words)]}", word + words[(i + 7) % len(words)], f"{words[(i + 13) % len(words)]}-{word}")
            for j, name in enumerate(names):
                k = 4 * i + j
                lead, end = ("", "www.", "blog.", "m.")[k % 4], ("com", "org", "net", "info")[k // 4 % 4]
                place = ("", "example.", "", "site.")[(k // 3) % 4]
                way = ("/", f"/en/{k}", f"/de/{k}.html", f"/fr/{k}/", f"/es/{k}", f"/page/{k}", f"/index.php", f"/a/b_{k}")[(k // 5) % 8]
                rows.append({"url": f"https://{lead}{name}.{place}{end}{way}", "accepted": accepted})
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,accepted:boolean>>")
    return spark.range(1, numPartitions=1).select(F.inline(table))


def judge(pages: DataFrame, rules: list[Rule], model: Model, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row.

    The verdict is that of the longest rule that fits, else ``block`` if the score
    (nats a sign, null without host and path) is above the model's threshold, else
    ``allow``. A null URL or one without ``://`` has empty host and path, fits no
    rule and is allowed. Ids may be null; rows that repeat stay; other columns are
    not looked at; an empty table gives none.

    A text is scored once for each of 64 salts that its rows have, and joined back
    by (hash of the text, salt): rows of a very common URL are spread over tasks.
    """
    require(pages, id_col, url)
    light = pages.select(F.col(id_col).alias("__id"), F.col(url).alias("__url"))
    parts = light.select("__id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    text = judged(F.col("host"), F.col("path"))
    keyed = parts.select(
        "__id", "host", "path", name.alias("rule"), verdict.alias("__verdict"), F.sha2(text, 256).alias("__key"), F.pmod(F.xxhash64("__id"), F.lit(64)).cast("int").alias("__salt")
    )
    texts = parts.select(text.alias("__text"), F.sha2(text, 256).alias("__key"), F.pmod(F.xxhash64("__id"), F.lit(64)).cast("int").alias("__salt"))
    once = texts.filter("__text is not null").dropDuplicates(["__key", "__salt"])
    scores = _scores(once, model.table, "__key", "__salt")
    told = keyed.join(scores, ["__key", "__salt"], "left")
    own = F.when(F.col("score") > model.threshold, "block").otherwise("allow")
    return told.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("__verdict", own).alias("verdict"), "score")
