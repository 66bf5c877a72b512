"""Splits and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.catalog import views as v
from flowgauge.catalog.registry import query
from flowgauge.operators import clean, profile, splits
from flowgauge.session import scratch_path
from flowgauge.sources import sinks

TEST_SIZE = 0.3
SEED = 42

# the same rule by full ranking
STRATIFIED = f"""counted AS (
  SELECT dataset, y, n, n_all, CAST(ceil(0.3 * CAST(n_all AS DOUBLE)) AS BIGINT) AS n_test FROM (
    SELECT dataset, y, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY dataset) AS BIGINT) AS n_all FROM base GROUP BY dataset, y)),
shares AS (SELECT *, (n * n_test) // n_all AS whole, (n * n_test) % n_all AS rest FROM counted),
quotas AS (
  SELECT dataset, y, whole + CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY rest DESC, y)
         <= n_test - sum(whole) OVER (PARTITION BY dataset) THEN 1 ELSE 0 END AS quota FROM shares),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, y ORDER BY {v.h52(str(SEED), 'row_id')}, row_id) AS r FROM base),
split AS (
  SELECT r.*, CASE WHEN r.r <= q.quota THEN 'test' ELSE 'train' END AS split
  FROM ranked r JOIN quotas q ON r.dataset = q.dataset AND r.y = q.y)"""

FLOW_BASE = "base AS (SELECT 'all' AS dataset, event_id AS row_id, event_type AS y FROM events)"


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.events(spark, sf_dir).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("y"))


@query("split_stratified", f"WITH {FLOW_BASE}, {STRATIFIED} SELECT row_id, y, split FROM split")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_stratified(_flows(spark, sf_dir), "y", TEST_SIZE, SEED)


KFOLD = """counted AS (SELECT y, count(*) AS n, min(row_id) AS first FROM base GROUP BY y),
placed AS (SELECT y, n, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM counted),
sized AS (
  SELECT y, i, CAST(floor((s + n - 1 - i) / CAST(5 AS DOUBLE)) - floor((s - 1 - i) / CAST(5 AS DOUBLE)) AS BIGINT) AS size
  FROM placed, range(0, 5) t(i)),
ends AS (SELECT y, i, sum(size) OVER (PARTITION BY y ORDER BY i) AS upto, size FROM sized),
ranked AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY row_id) AS r FROM base),
folded AS (
  SELECT r.row_id, r.y, CAST(e.i AS INTEGER) AS fold FROM ranked r JOIN ends e ON r.y = e.y AND r.r <= e.upto AND r.r > e.upto - e.size)"""


@query("split_kfold", f"WITH {FLOW_BASE}, {KFOLD} SELECT row_id, y, fold FROM folded")
def split_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_kfold(_flows(spark, sf_dir), "y", 5)


@query(
    "kfold_stats",
    f"""WITH {FLOW_BASE}, {KFOLD}, sizes AS (SELECT fold, count(*) AS test_samples FROM folded GROUP BY fold),
t AS (SELECT fold, CAST(sum(test_samples) OVER () - test_samples AS BIGINT) AS train_samples, test_samples FROM sizes)
SELECT *, CAST(floor(avg(train_samples) OVER ()) AS BIGINT) AS avg_train_samples,
       CAST(floor(avg(test_samples) OVER ()) AS BIGINT) AS avg_test_samples FROM t""",
)
def kfold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.kfold_stats(split_kfold(spark, sf_dir))


@query(
    "split_timestamp",
    """WITH r AS (SELECT event_id AS row_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)
SELECT row_id, CASE WHEN r <= CAST(floor((1 - CAST(0.3 AS DOUBLE)) * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def split_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir).select(F.col("event_id").alias("row_id"), "ts")
    return splits.split_timestamp(e, "ts", TEST_SIZE).drop("ts")


@query(
    "split_timestamp_dirty",
    """WITH e AS (SELECT event_id AS row_id, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL
    WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS t FROM events),
r AS (SELECT row_id, row_number() OVER (ORDER BY t, row_id) AS r, count(*) OVER () AS n FROM e WHERE t IS NOT NULL AND isfinite(t))
SELECT row_id, CASE WHEN r <= CAST(floor((1 - CAST(0.3 AS DOUBLE)) * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def split_timestamp_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text with NaN, infinite and missing ones, which have no place in time and drop out."""
    i = F.col("event_id")
    text = F.when(i % 7 == 0, "NaN").when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, "Infinity").otherwise(F.col("value").cast("string"))
    e = v.events(spark, sf_dir).select(i.alias("row_id"), text.alias("t"))
    return splits.split_timestamp(e, "t", TEST_SIZE, sort_rows=500, bins=64).drop("t")


MULTI_BASE = f"{v.MULTI}, base AS (SELECT dataset, row_id, target_label AS y FROM multi)"


@query("split_cross_dataset", f"WITH {MULTI_BASE}, {STRATIFIED} SELECT dataset, row_id, y AS target_label, split FROM split")
def split_cross_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = clean.align_tables(v.multi(spark, sf_dir))
    out = splits.split_cross_dataset(aligned, "target_label", TEST_SIZE, SEED)
    return out.select("dataset", "row_id", "target_label", "split")


BENIGN_SPLIT = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, y ORDER BY {v.h52(str(SEED), 'row_id')}, row_id) AS r,
         count(*) OVER (PARTITION BY dataset, y) AS n FROM base),
split AS (
  SELECT dataset, row_id, y, CASE WHEN y = 0 AND r > CASE WHEN n > 1 THEN ceil(0.3 * CAST(n AS DOUBLE)) ELSE 0 END
         THEN 'train' ELSE 'test' END AS split FROM ranked)"""

BINARY_BASE = """base AS (SELECT 'all' AS dataset, event_id AS row_id,
  CAST(event_type IN ('error', 'purchase') AS INTEGER) AS y FROM events)"""


@query("split_benign_train", f"WITH {BINARY_BASE}, {BENIGN_SPLIT} SELECT row_id, y, split FROM split")
def split_benign_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir).withColumn("y", F.col("y").isin(*v.ATTACKS).cast("int"))
    return splits.split_benign_train(f, "y", 0, TEST_SIZE, SEED)


@query(
    "split_cross_dataset_benign",
    f"WITH {MULTI_BASE}, {BENIGN_SPLIT} SELECT dataset, row_id, y AS target_label, split FROM split",
)
def split_cross_dataset_benign(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = clean.align_tables(v.multi(spark, sf_dir))
    out = splits.split_cross_dataset_benign(aligned, "target_label", 0, TEST_SIZE, SEED)
    return out.select("dataset", "row_id", "target_label", "split")


@query(
    "split_distribution",
    f"""WITH {FLOW_BASE}, {STRATIFIED}
SELECT split, y, printf('%.1f%%', count(*) / CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE) * 100) AS share
FROM split GROUP BY split, y""",
)
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.split_distribution(split_stratified(spark, sf_dir), "y", ["split"])


@query(
    "split_metadata",
    f"""WITH {MULTI_BASE}, {BENIGN_SPLIT}
SELECT dataset, split, count(*) AS n_rows, count(*) FILTER (WHERE y = 0) AS n_benign,
       count(*) FILTER (WHERE y <> 0) AS n_attack FROM split GROUP BY dataset, split""",
)
def split_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.split_metadata(split_cross_dataset_benign(spark, sf_dir), "target_label", 0, ["dataset", "split"])


@query(
    "split_sink_roundtrip",
    f"""WITH {MULTI_BASE}, {STRATIFIED}
SELECT dataset, split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS id_sum FROM split WHERE split = 'test' GROUP BY dataset, split""",
)
def split_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all splits, read the test part back by partition."""
    root = scratch_path(spark, "splits")
    sinks.write_splits(split_cross_dataset(spark, sf_dir), root, "0a1b2c3d")
    stored = sinks.test_rows(sinks.read_splits(spark, root, "0a1b2c3d"))
    return stored.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))
