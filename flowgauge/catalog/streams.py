"""The stream operators, each run over everything that is in the events file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.catalog import views as v
from flowgauge.catalog.models import MARKED, side_sql
from flowgauge.catalog.registry import query
from flowgauge.operators.detectors import decision_tree
from flowgauge.operators.runs import ModelStore
from flowgauge.session import scratch_path
from flowgauge.streaming import streams as s


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = s.parquet_stream(spark, sf_dir, schema, glob="events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


WATERMARK = "(SELECT CAST(max(epoch_us(ts)) // 1000 AS BIGINT) - 3600000 FROM events)"


@query("stream_label", f"WITH {v.FLOWS} SELECT row_id, {v.WINDOW_LABEL} AS label FROM flows")
def stream_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), "ts", F.col("user_id").alias("src"), v.k_of().alias("dst")
    )
    return s.drain(s.stream_labels(f, v.WINDOWS, "ts", "src", "dst").select("row_id", "label"), "label")


@query(
    "stream_confusion",
    f"""WITH {v.PREDS}, w AS (SELECT p.*, epoch_us(date_trunc('day', e.ts)) AS window_us FROM preds p JOIN events e ON e.event_id = p.row_id),
c AS (SELECT run_id, window_us, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp FROM w GROUP BY run_id, window_us)
SELECT run_id, window_us, tn, fp, fn, tp, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 5) AS accuracy,
  round(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 5) AS fp_rate FROM c WHERE window_us + 86400000000 <= {WATERMARK} * 1000""",
)
def stream_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows; those the watermark has not passed are not out yet."""
    e = _events(spark, sf_dir).select(
        "ts",
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.col("event_type").isin(*v.ATTACKS).cast("int").alias("y_true"),
        (F.col("value") >= 40).cast("int").alias("y_pred"),
    )
    out = s.drain(s.stream_confusion(e, "ts", "1 day", "1 hour", ["run_id"]), "confusion")
    return out.select("run_id", F.unix_micros("window_start").alias("window_us"), "tn", "fp", "fn", "tp", "accuracy", "fp_rate")


@query(
    "stream_scored_sliding",
    f"""WITH r AS (SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS run_id, epoch_us(ts) AS us, event_type IN ('error', 'purchase') AS t, user_id % 7 >= 3 AS p FROM events),
w AS (SELECT *, us // 43200000000 * 43200000000 - CAST(k * 43200000000 AS BIGINT) AS window_us FROM r, range(0, 2) s(k)),
c AS (SELECT run_id, window_us, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE NOT t AND p) AS fp,
  count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE t AND p) AS tp FROM w GROUP BY run_id, window_us)
SELECT run_id, window_us, tn, fp, fn, tp, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 5) AS accuracy,
  round(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 5) AS fp_rate FROM c WHERE window_us + 86400000000 <= {WATERMARK} * 1000""",
)
def stream_scored_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows every twelve hours, scored by a tree that was trained and stored before the stream starts.

    The tree learns which residues of the source alarm; it has to get all of them.
    """
    feature = (F.col("user_id") % 7).cast("double").alias("residue")
    train = v.events(spark, sf_dir).select(feature, (F.col("user_id") % 7 >= 3).cast("int").alias("alarm"))
    store = ModelStore(spark, scratch_path(spark, "stream-models"), "0f0f0f0f")
    store.save(decision_tree(max_depth=4).fit(train, ["residue"], "alarm"), "tree", "events")
    detector = s.stored_detector(store, "tree", "events")
    rows = _events(spark, sf_dir).select(
        "ts",
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.col("event_type").isin(*v.ATTACKS).cast("int").alias("y_true"),
        feature,
    )
    scored = s.stream_scores(rows, detector).select("ts", "run_id", "y_true", "y_pred")
    out = s.drain(s.stream_confusion(scored, "ts", "1 day", "1 hour", ["run_id"], slide="12 hours"), "sliding")
    return out.select("run_id", F.unix_micros("window_start").alias("window_us"), "tn", "fp", "fn", "tp", "accuracy", "fp_rate")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, CAST(floor(value / 50) AS BIGINT) AS bin FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("ts", "user_id", "event_type", F.floor(F.col("value") / 50).alias("bin"))
    keys = ["user_id", "event_type", "bin"]
    return s.drain(s.stream_dedup(e, "ts", "60 days", keys).select(*keys), "dedup")


@query(
    "stream_flows",
    f"""WITH {v.PACKETS}, k AS (SELECT *, least(src, dst) AS lo, greatest(src, dst) AS hi, epoch_us(ts) AS us FROM packets),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY lo, hi ORDER BY us) <= 21600000000 THEN 0 ELSE 1 END AS op FROM k),
n AS (SELECT *, sum(op) OVER (PARTITION BY lo, hi ORDER BY us ROWS UNBOUNDED PRECEDING) AS flow FROM g)
SELECT lo, hi, count(*) AS bidirectional_packets, CAST(sum(size) AS BIGINT) AS bidirectional_bytes, min(size) AS bidirectional_min_ps,
  max(size) AS bidirectional_max_ps, min(us) AS first_us, max(us) AS last_us FROM n GROUP BY lo, hi, flow
HAVING max(us) + 21600000000 <= {WATERMARK} * 1000""",
)
def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by the idle timeout; open ones are not out yet."""
    src, dst = F.col("user_id") % 20, v.k_of().cast("bigint") % 5 + 100
    p = _events(spark, sf_dir).select(
        "ts", F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"), (F.floor("value") + 40).alias("size")
    )
    out = s.drain(s.stream_flows(p, "ts", ["lo", "hi"], "6 hours", "1 hour", "size"), "flows")
    return out.select(
        "lo",
        "hi",
        *[c for c in out.columns if c.startswith("bidirectional")],
        F.unix_micros("first_seen").alias("first_us"),
        F.unix_micros("last_seen").alias("last_us"),
    )


@query(
    "stream_mttd",
    f"""WITH b AS (SELECT user_id AS key, event_id, epoch_us(ts) AS us, event_type IN ('error', 'purchase') AS t, value >= 40 AS p FROM events
  WHERE epoch_us(ts) < {WATERMARK} * 1000),
o AS (SELECT *, row_number() OVER w AS rn, lag(t) OVER w AS prev, max(CASE WHEN NOT t THEN us END) OVER (PARTITION BY key) AS last_benign
  FROM b WINDOW w AS (PARTITION BY key ORDER BY us, event_id)),
g AS (SELECT *, sum(CASE WHEN t AND NOT coalesce(prev, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY rn) AS island FROM o)
SELECT key, min(us) AS start_us, count(*) AS rows, CAST(min(rn) FILTER (WHERE p) - min(rn) AS BIGINT) AS delay
FROM g WHERE t GROUP BY key, island HAVING max(us) < any_value(last_benign)""",
)
def stream_mttd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed attack instances per source, in event-time order behind the watermark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    e = _events(spark, sf_dir).select(
        "ts",
        "user_id",
        "event_id",
        F.col("event_type").isin(*v.ATTACKS).cast("int").alias("y_true"),
        (F.col("value") >= 40).cast("int").alias("y_pred"),
    )
    return s.drain(s.stream_time_to_detect(e, "ts", F.col("user_id"), F.col("event_id"), "1 hour"), "mttd")


IDLE_US, ACTIVE_US = 6 * 3600 * 10**6, 12 * 3600 * 10**6


@query(
    "stream_flows_active",
    f"""WITH {v.PACKETS}, k AS (SELECT *, least(src, dst) AS lo, greatest(src, dst) AS hi, epoch_us(ts) AS us FROM packets
  WHERE epoch_us(ts) < {WATERMARK} * 1000),
g AS (SELECT *, lag(us) OVER (PARTITION BY lo, hi ORDER BY us, pkt_id) AS prev, max(us) OVER (PARTITION BY lo, hi) AS key_last FROM k),
s AS (SELECT *, max(CASE WHEN prev IS NULL OR us - prev > {IDLE_US} THEN us END) OVER (PARTITION BY lo, hi ORDER BY us, pkt_id ROWS UNBOUNDED PRECEDING) AS start FROM g),
f AS (SELECT lo, hi, min(us) AS first_us, max(us) AS last_us, count(*) AS bidirectional_packets, CAST(sum(size) AS BIGINT) AS bidirectional_bytes,
  min(size) AS bidirectional_min_ps, max(size) AS bidirectional_max_ps, any_value(key_last) AS key_last
  FROM s GROUP BY lo, hi, start, (us - start) // {ACTIVE_US})
SELECT * EXCLUDE (key_last) FROM f WHERE last_us < key_last OR last_us + {IDLE_US} < {WATERMARK} * 1000""",
)
def stream_flows_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows closed by idle or active timeout behind the watermark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    src, dst = F.col("user_id") % 20, v.k_of().cast("bigint") % 5 + 100
    p = _events(spark, sf_dir)
    size = F.floor("value") + 40
    got = s.stream_flows_active(
        p, "ts", F.least(src, dst), F.greatest(src, dst), F.col("event_id"), size, 6 * 3600, 12 * 3600, "1 hour"
    )
    return s.drain(got, "active-flows")


CLOSED = MARKED.replace("FROM events)", f"FROM events WHERE epoch_us(ts) // 1000 < {WATERMARK})", 1)


@query(
    "stream_flow_records",
    f"""WITH {CLOSED}, r AS (SELECT *, max(ts_ms) OVER (PARTITION BY lo, hi) AS key_last FROM md)
SELECT min(pkt_id) AS flow_id, 'h' || first_src AS src, 'h' || first_dst AS dst, {side_sql('bidirectional', '', 'gap')},
  {side_sql('src2dst', 'src = first_src', 'dgap')}, {side_sql('dst2src', 'src <> first_src', 'dgap')}
FROM r GROUP BY lo, hi, start, cut, first_src, first_dst
HAVING max(ts_ms) < any_value(key_last) OR max(ts_ms) + {IDLE_US // 1000} < {WATERMARK}""",
)
def stream_flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between text addresses with every column of the batch operator."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", s.ROCKSDB)
    kind, name = F.col("event_type"), lambda c: F.concat(F.lit("h"), c.cast("string"))
    p = _events(spark, sf_dir).select(
        "ts",
        F.col("event_id").alias("pkt_id"),
        name(F.col("user_id") % 20).alias("src"),
        name(v.k_of().cast("bigint") % 5 + 100).alias("dst"),
        (F.floor("value") + 40).alias("size"),
        (kind == "signup").alias("syn"),
        (kind == "purchase").alias("fin"),
    )
    got = s.stream_flow_records(
        p, "ts", ["src"], ["dst"], flags=["syn", "fin"], idle_ms=IDLE_US // 1000, active_ms=ACTIVE_US // 1000
    )
    got = s.drain(got, "flow-records")
    return got.select(*[F.round(c, 6).alias(c) if "_mean_" in c or "_stddev_" in c else F.col(c) for c in got.columns])
