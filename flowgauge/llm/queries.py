"""Registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import decontam, fim, hilbert, html_text, langid, license_scan, lm_backoff, simhash, sp_dropout, topk, url_filter, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, only=~langid.held_out())
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op4_benchmark_decontamination",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS width, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
        lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (SELECT r, width, unnest(range(1, len(w) - width + 2)) AS pos,
        unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS win
        FROM d, widths WHERE len(w) >= width),
hit AS (SELECT dw.r, dw.pos, dw.width, bw.item_id FROM dw JOIN bw USING (width, win)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(pos, pos + width)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
    sha256(coalesce(items.names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_matches(docs, table(spark, sf_dir, "benchmark"))
    items = F.sort_array(F.array_distinct(F.col("matches.item")))
    return found.select(
        "doc_id",
        "n_words",
        decontam.covered_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


@query(
    "op6_stupid_backoff",
    r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS cur,
    unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 THEN w[i - 1] END)) AS prev FROM t),
one AS (SELECT cur, count(*) AS n FROM g GROUP BY cur),
two AS (SELECT prev, cur, count(*) AS n FROM g WHERE prev IS NOT NULL GROUP BY prev, cur),
s AS (SELECT r, CASE WHEN g.prev IS NULL THEN ln(c.n / (SELECT count(*) FROM g))
        WHEN two.n >= 2 THEN ln(two.n / p.n) ELSE ln(0.4) + ln(c.n / (SELECT count(*) FROM g)) END AS score,
        g.prev IS NOT NULL AND two.n < 2 AS backed
    FROM g JOIN one c ON g.cur = c.cur LEFT JOIN one p ON g.prev = p.cur LEFT JOIN two ON g.prev = two.prev AND g.cur = two.cur),
d AS (SELECT r, sum(score) AS score, count_if(backed) AS backed FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(score, 0), 4) AS log_score, CAST(coalesce(backed, 0) AS BIGINT) AS n_backoff
FROM t LEFT JOIN d USING (r)
""",
)
def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_backoff.backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.withColumn("log_score", F.round("log_score", 4))


@query(
    "op6_stupid_backoff_trigrams",
    r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, unnest(w) AS cur, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 THEN w[i - 1] END)) AS prev,
    unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 2 THEN w[i - 2] END)) AS first FROM t),
one AS (SELECT cur, count(*) AS n FROM g GROUP BY cur),
two AS (SELECT prev, cur, count(*) AS n FROM g WHERE prev IS NOT NULL GROUP BY prev, cur),
three AS (SELECT first, prev, cur, count(*) AS n FROM g WHERE first IS NOT NULL GROUP BY first, prev, cur),
s AS (SELECT r, CASE WHEN three.n >= 2 THEN ln(three.n / q.n)
        ELSE CASE WHEN g.first IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN two.n >= 2 THEN ln(two.n / p.n)
            ELSE CASE WHEN g.prev IS NULL THEN 0 ELSE ln(0.4) END + ln(c.n / (SELECT count(*) FROM g)) END END AS score,
        (g.first IS NOT NULL AND three.n < 2) OR (g.first IS NULL AND g.prev IS NOT NULL AND two.n < 2) AS backed
    FROM g JOIN one c ON g.cur = c.cur LEFT JOIN one p ON g.prev = p.cur LEFT JOIN two ON g.prev = two.prev AND g.cur = two.cur
    LEFT JOIN two q ON g.first = q.prev AND g.prev = q.cur LEFT JOIN three ON g.first = three.first AND g.prev = three.prev AND g.cur = three.cur),
d AS (SELECT r, sum(score) AS score, count_if(backed) AS backed FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(score, 0), 4) AS log_score, CAST(coalesce(backed, 0) AS BIGINT) AS n_backoff
FROM t LEFT JOIN d USING (r)
""",
)
def op6_stupid_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_backoff.backoff_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), order=3)
    return scored.withColumn("log_score", F.round("log_score", 4))


@query("op7_sentencepiece_dropout")
def op7_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sp_dropout.encode(docs, verify="lossless").select("doc_id", F.size("ids").alias("n_ids"), "ids", "lossless")


@query("op5_hilbert_sharding")
def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "lang",
        "source",
    )
    sharded = hilbert.hilbert_shards(docs, ["lang", "source", "size"], 24)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), license_scan.train(spark))


@query(
    "op9_exact_top_k",
    """
WITH v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id,
        CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query(
    "op10_warc_chunks",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN keeper IS NULL OR keeper IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN keeper IS NULL OR keeper IS NOT DISTINCT FROM page_id THEN NULL ELSE keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest, payload_bytes)
""",
)
def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=8)
    error = whitening.identity_error(vectors, model)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(x) for x in model.explained]).cast("array<double>"), F.col("at"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query(
    "op12_fill_in_middle",
    r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS w, [CAST('0x' || h[8 * i + 1:8 * i + 8] AS BIGINT) for i in range(4)] AS k FROM t),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS a, greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 100 THEN 'plain'
        WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
""",
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, rate=100, spm=50)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: The rules of the registered query.
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


@query("op13_url_filter")
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark), share=0.0)
    return url_filter.judge(table(spark, sf_dir, "pages"), [url_filter.Rule.of(r) for r in URL_RULES], model)
