"""Scans, labels, cleaning, profiles, fitted steps and feature selection."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.catalog import views as v
from flowgauge.catalog.registry import query
from flowgauge.functions import scalars
from flowgauge.operators import clean, fitted, labeling, profile, select
from flowgauge.operators.fitted import Step, fit_chain
from flowgauge.operators.labeling import TimeWindow
from flowgauge.operators.runs import config_hash_column
from flowgauge.plans.dataset import SplitPlan, prepare, preprocess
from flowgauge.session import scratch_path
from flowgauge.sources import readers
from flowgauge.sources.sinks import read_splits

# ---- scans ---------------------------------------------------------------


def _landed_csv(spark: SparkSession, sf_dir: str) -> str:
    """The flow table as CSV files with blanks around names and labels and several missing tokens."""
    d = v.dirty(spark, sf_dir)
    out = d.select(
        F.col("row_id").alias(" row_id"),
        F.when(F.isnan("value"), "NaN").otherwise(F.col("value").cast("string")).alias(" value "),
        F.concat(F.lit(" "), F.coalesce("cat", F.lit("NA")), F.lit(" ")).alias(" Label"),
        F.col("u"),
    )
    path = scratch_path(spark, "csv")
    out.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return path


@query(
    "scan_csv_roundtrip",
    f"""WITH {v.DIRTY}
SELECT row_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, cat AS "Label", CAST(u AS INTEGER) AS u FROM dirty""",
)
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.read_csv(spark, _landed_csv(spark, sf_dir))
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), "value", "Label", F.col("u").cast("int").alias("u"))


@query(
    "scan_parquet",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem
WHERE l_quantity > 40 AND l_discount < 0.05 GROUP BY ALL""",
)
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.read_any(spark, f"{sf_dir}/lineitem.parquet")
    kept = df.where((F.col("l_quantity") > 40) & (F.col("l_discount") < 0.05))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")
    )


@query(
    "scan_recursive",
    f"""WITH {v.MULTI} SELECT dataset, count(*) AS n, sum(src) AS src_sum FROM multi GROUP BY dataset""",
)
def scan_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables below nested folders, one class per folder."""
    root = scratch_path(spark, "tree")
    for name, df in v.multi(spark, sf_dir).items():
        df.drop("attack_category", "target_label").write.parquet(f"{root}/{name}/deep/part")
    df = readers.load_dataset(spark, [readers.SubFile(f"{root}/D{i}", attack_type=f"D{i}") for i in range(3)])
    by = df.groupBy(F.col("attack_category").alias("dataset"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src_sum"))


CLASS_TOTALS = f"""{v.DIRTY}, c AS (SELECT CAST(coalesce(cat, '') NOT IN ('view', 'click', 'signup') AS INTEGER) AS target_label, count(*) AS n FROM dirty GROUP BY 1),
q AS (SELECT target_label, n, sum(n) OVER () AS total, CAST(ceil(CAST(0.3 AS DOUBLE) * sum(n) OVER ()) AS BIGINT) AS test FROM c),
f AS (SELECT *, n * test // total AS base, n * test % total AS rest FROM q),
t AS (SELECT target_label, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, target_label) <= test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f)"""


@query(
    "csv_to_split",
    f"""WITH {CLASS_TOTALS} SELECT target_label, 'test' AS split, CAST(quota AS BIGINT) AS n FROM t
UNION ALL SELECT target_label, 'train', CAST(n - quota AS BIGINT) FROM t""",
)
def csv_to_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From CSV files to a stored split: load, label, land, preprocess, split; rows per class and part."""
    csv = scratch_path(spark, "flows")
    v.dirty(spark, sf_dir).select(F.col("row_id").alias("Flow ID"), F.col("cat").alias(" Label "), "u").write.option("header", True).csv(csv)
    files = [readers.SubFile(csv, label_column="Label", benign=tuple(v.BENIGN))]
    root = scratch_path(spark, "run")
    # a table without text columns: the step finds none and is skipped
    steps = [Step("min_max", ("u",)), Step("one_hot", ())]
    prepare(spark, {"D0": files}, {"D0": steps}, SplitPlan(test_size=0.3), root, "0a0a0a0a", reports=False)
    table = read_splits(spark, root, "0a0a0a0a")
    return table.groupBy("target_label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_subfiles",
    f"""WITH {v.MULTI}
SELECT row_id, src, value, attack_category, target_label,
       CASE WHEN dataset = 'D0' THEN value * 1 END AS only_0,
       CASE WHEN dataset = 'D1' THEN value * 2 END AS only_1,
       CASE WHEN dataset = 'D2' THEN value * 3 END AS only_2
FROM multi""",
)
def union_subfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.union_tables(list(v.multi(spark, sf_dir).values()))


@query("config_hash", """SELECT event_id, substr(sha256(props), 1, 8) AS config_hash FROM events""")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.events(spark, sf_dir).select("event_id", config_hash_column(F.col("props")).alias("config_hash"))


# ---- labels --------------------------------------------------------------


@query(
    "label_static",
    """SELECT event_id AS row_id, CASE WHEN event_id % 2 = 0 THEN 'Benign' ELSE event_type END AS attack_category,
       CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS target_label FROM events""",
)
def label_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of 'files': even rows carry the class of a benign file, odd ones that of their own."""
    e = v.events(spark, sf_dir).withColumn("row_id", F.col("event_id"))
    benign = labeling.label_static(e.where("event_id % 2 = 0").select("row_id"), "Benign")
    rest = labeling.label_static_column(e.where("event_id % 2 = 1").select("row_id", "event_type"), "event_type")
    return benign.unionByName(rest.drop("event_type"))


@query(
    "label_from_column",
    f"""WITH {v.FLOWS}
SELECT row_id, CASE label_raw WHEN 'error' THEN 'Fault' WHEN 'view' THEN 'Normal' ELSE label_raw END AS attack_category,
       CASE WHEN label_raw IN ('view', 'click', 'signup') THEN 0 ELSE 1 END AS target_label
FROM flows""",
)
def label_from_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = v.flows(spark, sf_dir).withColumn("label_raw", F.concat(F.lit(" "), "label_raw", F.lit("  ")))
    labelled = labeling.label_from_column(padded, "label_raw", v.BENIGN, {"error": "Fault", "view": "Normal"})
    return labelled.select("row_id", "attack_category", "target_label")


@query(
    "label_time_windows",
    f"""WITH {v.FLOWS} SELECT row_id, {v.WINDOW_LABEL} AS label FROM flows""",
)
def label_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.flows(spark, sf_dir)
    return labeling.label_time_windows(f, v.WINDOWS, "ts", "src", "dst").select("row_id", "label")


@query(
    "label_time_windows_bucketed",
    f"""WITH {v.FLOWS}, w AS (
  SELECT i AS ord, 'W' || CAST(i AS VARCHAR) AS label, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(i * 6 AS BIGINT)) AS s,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(i * 6 + 9 AS BIGINT)) AS e FROM range(0, 100) r(i)),
hit AS (
  SELECT f.row_id, arg_max(w.label, w.ord) AS label FROM flows f JOIN w ON f.ts BETWEEN w.s AND w.e
   AND (f.src BETWEEN w.ord AND w.ord + 29 OR f.dst BETWEEN w.ord AND w.ord + 29) GROUP BY f.row_id)
SELECT f.row_id, coalesce(h.label, 'BENIGN') AS label FROM flows f LEFT JOIN hit h ON f.row_id = h.row_id""",
)
def label_time_windows_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred overlapping windows."""
    base = datetime(2024, 1, 1)
    windows = [
        TimeWindow(
            f"W{i}",
            (base + timedelta(hours=6 * i)).isoformat(),
            (base + timedelta(hours=6 * i + 9)).isoformat(),
            src=tuple(range(i, i + 30)),
        )
        for i in range(100)
    ]
    f = v.flows(spark, sf_dir)
    return labeling.label_time_windows(f, windows, "ts", "src", "dst").select("row_id", "label")


#: Lengths in seconds of the windows of the next query, from one second to ten years.
SPANS = (1, 75, 7_200, 432_000, 34_560_000, 315_360_000)


def long_windows(n: int = 600) -> list[TimeWindow]:
    """Overlapping windows of very different lengths, for endpoints of either side, of both sides, or for any."""
    base = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        span, kind, a = SPANS[i % 6], (i // 6) % 4, i % 50
        kind = 0 if span > 432_000 and kind == 3 else kind
        start = base + timedelta(minutes=67 * i) - timedelta(seconds=span // 2 if span > 432_000 else 0)
        src = {0: range(a, a + 4), 2: range(a, a + 10)}.get(kind, ())
        dst = {1: range(a, a + 4), 2: range(40)}.get(kind, ())
        out.append(TimeWindow(f"W{i}", start.isoformat(), (start + timedelta(seconds=span)).isoformat(), tuple(src), tuple(dst)))
    return out


@query(
    "label_time_windows_long",
    f"""WITH {v.FLOWS}, i AS (
  SELECT CAST(i AS BIGINT) AS ord, list_extract([1, 75, 7200, 432000, 34560000, 315360000], CAST(i % 6 + 1 AS BIGINT)) AS span, i % 50 AS a,
         CASE WHEN i % 6 >= 4 AND (i // 6) % 4 = 3 THEN 0 ELSE (i // 6) % 4 END AS kind FROM range(0, 600) r(i)),
w AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(67 * ord) - to_seconds(CASE WHEN span > 432000 THEN span // 2 ELSE 0 END) AS s FROM i),
hit AS (
  SELECT f.row_id, arg_max('W' || CAST(w.ord AS VARCHAR), w.ord) AS label FROM flows f JOIN w ON f.ts BETWEEN w.s AND w.s + to_seconds(w.span)
   AND CASE w.kind WHEN 3 THEN TRUE
     WHEN 2 THEN (f.src BETWEEN w.a AND w.a + 9 AND f.dst < 40) OR (f.dst BETWEEN w.a AND w.a + 9 AND f.src < 40)
     ELSE f.src BETWEEN w.a AND w.a + 3 OR f.dst BETWEEN w.a AND w.a + 3 END GROUP BY f.row_id)
SELECT f.row_id, coalesce(h.label, 'BENIGN') AS label FROM flows f LEFT JOIN hit h ON f.row_id = h.row_id""",
)
def label_time_windows_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hundred windows from a second to ten years."""
    f = v.flows(spark, sf_dir)
    return labeling.label_time_windows(f, long_windows(), "ts", "src", "dst").select("row_id", "label")


@query(
    "binarize_labels",
    """SELECT event_id AS row_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS y FROM events""",
)
def binarize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir)
    return e.select(F.col("event_id").alias("row_id"), scalars.binarize(F.col("event_type"), "view").alias("y"))


@query(
    "attack_score",
    f"""WITH {v.PREDS}
SELECT row_id, score AS binary_score, 1 - (1 - score) AS multi_score FROM preds""",
)
def attack_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = v.preds(spark, sf_dir)
    s = F.col("score")
    binary = F.create_map(F.lit("0"), 1 - s, F.lit("1"), s)
    many = F.create_map(F.lit("dos"), s * 0.5, F.lit("scan"), s * 0.5, F.lit("Benign"), 1 - s)
    return p.select(
        "row_id",
        scalars.attack_score(binary).alias("binary_score"),
        scalars.attack_score(many, benign="Benign").alias("multi_score"),
    )


# ---- cleaning ------------------------------------------------------------


@query(
    "feature_mapping",
    f"""WITH {v.FLOWS} SELECT row_id, value AS packet_size, src AS source FROM flows""",
)
def feature_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"value": "packet_size", "src": "source", "not_there": "ignored"}
    return clean.feature_mapping(v.flows(spark, sf_dir), mapping, keep=("row_id",))


@query("drop_columns", f"""WITH {v.FLOWS} SELECT row_id, value FROM flows""")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_columns(v.flows(spark, sf_dir), ["ts", "src", "dst", "label_raw"])


@query(
    "remove_class",
    f"""WITH {v.DIRTY} SELECT row_id, cat AS attack_category FROM dirty
WHERE cat IS NULL OR cat NOT IN ('error', 'view')""",
)
def remove_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir).select("row_id", F.col("cat").alias("attack_category"))
    return clean.remove_class(d, ["error", "view"])


@query(
    "remove_nan_rows",
    f"""WITH {v.DIRTY}, {v.FINITE}
SELECT * FROM finite WHERE value IS NOT NULL AND cat IS NOT NULL""",
)
def remove_nan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.remove_incomplete_rows(v.dirty(spark, sf_dir))


@query("cast_numeric", f"""WITH {v.DIRTY} SELECT row_id, TRY_CAST(txt AS DOUBLE) AS txt FROM dirty""")
def cast_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cast_numeric(v.dirty(spark, sf_dir), ["txt", "missing"]).select("row_id", "txt")


@query("drop_single_value_columns", f"""WITH {v.DIRTY} SELECT row_id, cat, u FROM dirty""")
def drop_single_value_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir).select("row_id", "cat", "u", "const")
    return clean.drop_single_value_columns(d, ["cat", "u", "const"])


@query(
    "drop_duplicate_rows",
    """SELECT min(event_id) AS row_id, event_type, user_id % 5 AS u, floor(value / 50) AS bin
FROM events GROUP BY event_type, user_id % 5, floor(value / 50)""",
)
def drop_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir)
    d = e.select(
        F.col("event_id").alias("row_id"),
        "event_type",
        (F.col("user_id") % 5).alias("u"),
        F.floor(F.col("value") / 50).cast("double").alias("bin"),
    )
    return clean.drop_duplicate_rows(d)


@query(
    "common_columns",
    f"""WITH {v.MULTI} SELECT dataset, row_id, src, value, attack_category, target_label FROM multi""",
)
def common_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.align_tables(v.multi(spark, sf_dir))


# ---- profiles ------------------------------------------------------------


@query(
    "class_distribution",
    """SELECT event_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 5) AS percent
FROM events GROUP BY event_type""",
)
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_distribution(v.events(spark, sf_dir), "event_type")


@query(
    "dataset_summary",
    f"""WITH {v.DIRTY}
SELECT count(*) AS total_samples, 5 AS features, 3 AS numeric_features, 2 AS categorical_features,
       count(*) FILTER (WHERE value IS NULL OR isnan(value)) + count(*) FILTER (WHERE cat IS NULL) AS total_missing
FROM dirty""",
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dataset_summary(v.dirty(spark, sf_dir))


CLEAN_ROWS = f"""{v.DIRTY}, clean AS (SELECT value, cat, TRY_CAST(txt AS DOUBLE) AS txt, u FROM dirty
  WHERE value IS NOT NULL AND isfinite(value) AND cat IS NOT NULL AND TRY_CAST(txt AS DOUBLE) IS NOT NULL)"""


@query(
    "pipeline_steps",
    f"""WITH {CLEAN_ROWS} SELECT 'run' AS run_id, ord, action, dropped, CAST(rows_after AS BIGINT) AS rows_after FROM (VALUES
  (0, 'cast_numeric', '', NULL), (1, 'remove_nan_rows', '', (SELECT count(*) FROM clean)),
  (2, 'remove_single_value_columns', 'const', NULL),
  (3, 'remove_duplicate_rows', '', (SELECT count(*) FROM (SELECT DISTINCT * FROM clean))), (4, 'min_max', '', NULL)) t(ord, action, dropped, rows_after)""",
)
def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step log of a preprocessing run."""
    steps = [
        Step("cast_numeric", ("txt",)),
        Step("remove_nan_rows"),
        Step("remove_single_value_columns", ("const",)),
        Step("remove_duplicate_rows"),
        Step("min_max"),
    ]
    log = preprocess(v.dirty(spark, sf_dir), steps).step_table("run")
    detail = F.col("detail")
    return log.select("run_id", "ord", "action", detail["dropped"].alias("dropped"), detail["rows_after"].cast("bigint").alias("rows_after"))


# ---- fitted steps --------------------------------------------------------

_LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "lineitem").select(*_LINEITEM)


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns])


@query(
    "scale_min_max",
    f"""WITH {v.DIRTY}, {v.FINITE}, s AS (SELECT min(value) AS lo, max(value) AS hi, min(u) AS ulo, max(u) AS uhi FROM finite)
SELECT row_id, round((value - lo) / (hi - lo), 6) AS value, round((u - ulo) / CAST(uhi - ulo AS DOUBLE), 6) AS u,
       CAST(0 AS DOUBLE) AS const FROM finite, s""",
)
def scale_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir).select("row_id", "value", "u", "const")
    cols = ["value", "u", "const"]
    return _rounded(fitted.fit_min_max(d, cols).transform(d), cols)


@query(
    "scale_standard",
    """WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2,
       stddev_pop(l_extendedprice) AS s2, avg(l_discount) AS m3, stddev_pop(l_discount) AS s3, avg(l_tax) AS m4,
       stddev_pop(l_tax) AS s4 FROM lineitem)
SELECT round((l_quantity - m1) / s1, 6) + 0 AS l_quantity, round((l_extendedprice - m2) / s2, 6) + 0 AS l_extendedprice,
       round((l_discount - m3) / s3, 6) + 0 AS l_discount, round((l_tax - m4) / s4, 6) + 0 AS l_tax FROM lineitem, s""",
)
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lineitem(spark, sf_dir)
    return _rounded(fitted.fit_standard(d, _LINEITEM).transform(d), _LINEITEM)


@query(
    "encode_label",
    f"""WITH {v.DIRTY}
SELECT row_id, dense_rank() OVER (ORDER BY coalesce(cat, 'MISSING')) - 1 AS cat,
       dense_rank() OVER (ORDER BY txt) - 1 AS txt FROM dirty""",
)
def encode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir).select("row_id", "cat", "txt")
    return fitted.fit_label(d, ["cat", "txt"]).transform(d)


@query(
    "encode_one_hot",
    f"""WITH {v.DIRTY}
SELECT row_id, {', '.join(f"CAST(coalesce(cat = '{c}', FALSE) AS DOUBLE) AS cat_{c}" for c in v.CLASSES)},
       CAST(cat IS NULL AS DOUBLE) AS cat_nan FROM dirty""",
)
def encode_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir).select("row_id", "cat")
    return fitted.fit_one_hot(d, ["cat"]).transform(d)


@query(
    "encode_one_hot_mixed",
    f"""WITH {v.DIRTY}, d AS (SELECT row_id, cat, CASE WHEN value IS NOT NULL AND isfinite(value) THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS size FROM dirty),
k AS (SELECT size, row_number() OVER (ORDER BY size NULLS LAST) - 1 AS size_slot FROM (SELECT DISTINCT size FROM d))
SELECT row_id, {', '.join(f"CAST(coalesce(cat = '{c}', FALSE) AS DOUBLE) AS cat_{c}" for c in v.CLASSES)},
       CAST(cat IS NULL AS DOUBLE) AS cat_nan, size_slot FROM d JOIN k ON d.size IS NOT DISTINCT FROM k.size""",
)
def encode_one_hot_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short column as 0/1 columns beside a long one as a vector; NULL is a value in both."""
    d = v.dirty(spark, sf_dir)
    size = F.when(F.abs("value") < 1e18, F.floor("value").cast("bigint").cast("string")).alias("size")
    d = d.select("row_id", "cat", size)
    short = fitted.fit_one_hot(d, ["cat"]).transform(d)
    both = fitted.fit_one_hot(d, ["size"], output="vector").transform(short)
    slot = F.array_position(vector_to_array("size_onehot"), 1.0) - 1
    return both.withColumn("size_slot", slot).drop("size_onehot")


@query(
    "impute_mean",
    f"""WITH {v.DIRTY}, {v.FINITE}
SELECT row_id, round(coalesce(value, (SELECT avg(value) FROM finite)), 6) AS value FROM finite""",
)
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir).select("row_id", "value")
    return _rounded(fitted.fit_impute_mean(d, ["value"]).transform(d), ["value"])


@query(
    "impute_median",
    f"""WITH {v.DIRTY}, {v.FINITE}
SELECT row_id, round(coalesce(value, (SELECT median(value) FROM finite)), 6) AS value FROM finite""",
)
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir).select("row_id", "value")
    return _rounded(fitted.fit_impute_median(d, ["value"]).transform(d), ["value"])


@query(
    "impute_most_frequent",
    f"""WITH {v.DIRTY}, {v.FINITE}
SELECT row_id,
       coalesce(cat, (SELECT cat FROM finite WHERE cat IS NOT NULL GROUP BY cat ORDER BY count(*) DESC, cat LIMIT 1)) AS cat,
       coalesce(value, (SELECT value FROM finite WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)) AS value
FROM finite""",
)
def impute_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir).select("row_id", "cat", "value")
    return fitted.fit_impute_most_frequent(d, ["cat", "value"]).transform(d)


@query(
    "preprocess_chain",
    f"""WITH {v.DIRTY}, {v.FINITE},
a AS (SELECT row_id, coalesce(value, (SELECT avg(value) FROM finite)) AS value, coalesce(cat, 'MISSING') AS cat,
             TRY_CAST(txt AS DOUBLE) AS txt, u FROM finite),
b AS (SELECT * FROM a WHERE txt IS NOT NULL),
s AS (SELECT min(value) AS lo, max(value) AS hi, min(txt) AS tlo, max(txt) AS thi FROM b)
SELECT row_id, round((value - lo) / (hi - lo), 6) AS value,
       dense_rank() OVER (ORDER BY cat) - 1 AS cat, round((txt - tlo) / (thi - tlo), 6) AS txt, u FROM b, s""",
)
def preprocess_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.dirty(spark, sf_dir)
    steps = [
        Step("cast_numeric", ("txt",)),
        Step("impute_mean", ("value",)),
        Step("label", ("cat",)),
        Step("remove_nan_rows"),
        Step("remove_single_value_columns", ("const", "u")),
        Step("min_max", ("value", "txt")),
    ]
    return _rounded(fit_chain(d, steps).transform(d), ["value", "txt"])


# ---- feature selection ---------------------------------------------------


@query(
    "variance_threshold",
    f"""WITH {v.DIRTY} SELECT row_id, value, cat, txt FROM dirty""",
)
def variance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``u`` varies by about 2, ``const`` not at all; text stays."""
    return select.variance_threshold(v.dirty(spark, sf_dir), threshold=5.0)


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{_LINEITEM[i]}' AS feature_a, '{_LINEITEM[j]}' AS feature_b, "
        f"round(corr({_LINEITEM[i]}, {_LINEITEM[j]}), 6) + 0 AS r FROM lineitem"
        for i, j in _PAIRS
    ),
)
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select.correlations(_lineitem(spark, sf_dir), _LINEITEM)
    return found.select("feature_a", "feature_b", (F.round("r", 6) + 0.0).alias("r"))


@query(
    "correlation_threshold",
    """SELECT event_id AS row_id, value, user_id AS src FROM events""",
)
def correlation_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"),
        "value",
        (F.col("value") * 2 + 1).alias("twice"),
        F.col("user_id").alias("src"),
        (-F.col("user_id")).alias("minus_src"),
    )
    return select.correlation_threshold(d)


@query("lr_feature_selection")
def lr_feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a logistic regression on a label that follows x1, with a copy of pure noise."""
    u = v.unit(spark, sf_dir).withColumn("target_label", (F.col("x1") + F.col("x3") * 0.1 > 0.5).cast("int"))
    kept, _ = select.logistic_selection(u.drop("run_id"))
    return kept


@query(
    "lr_selection_properties",
    f"""WITH {v.UNIT} SELECT feature, kept, (SELECT count(*) FROM unit) AS n_rows
FROM (VALUES ('x1', TRUE), ('x2', FALSE), ('x3', FALSE)) t(feature, kept)""",
)
def lr_selection_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the selection: the feature that the label follows stays, one with no say and one with little go; no row is lost."""
    u = v.unit(spark, sf_dir).withColumn("target_label", (F.col("x1") + F.col("x3") * 0.1 > 0.5).cast("int"))
    kept, _ = select.logistic_selection(u.drop("run_id"))
    told = [F.struct(F.lit(c).alias("feature"), F.lit(c in kept.columns).alias("kept")) for c in v.FEATURES]
    return kept.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.array(*told)), "n_rows")


# ---- scalar functions ----------------------------------------------------


@query(
    "display_names",
    """WITH k AS (SELECT event_id AS row_id, 'test_' || event_type || '_f' || CAST(user_id AS VARCHAR) AS key FROM events)
SELECT row_id, upper(substr(key, 6, 1)) || substr(split_part(key, '_', 2), 2) || ' F' || split_part(key, '_f', 2) AS name,
       replace(key, '_f', '_f') AS safe FROM k""",
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("test_"), "event_type", F.lit("_f"), F.col("user_id").cast("string"))
    e = v.events(spark, sf_dir)
    spaced = F.replace(key, F.lit("_f"), F.lit(" f"))
    return e.select(
        F.col("event_id").alias("row_id"), scalars.display_name(key).alias("name"), scalars.file_safe(spaced).alias("safe")
    )


@query(
    "flow_start",
    """SELECT event_id AS row_id, epoch_us(ts) // 1000 * 1000 AS from_millis, epoch_us(ts) AS from_timestamp,
       epoch_us(ts) AS from_text FROM events""",
)
def flow_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    e = v.events(spark, sf_dir)
    ms, text = F.unix_millis("ts"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.unix_micros(scalars.flow_start(ms, T.LongType())).alias("from_millis"),
        F.unix_micros(scalars.flow_start(F.col("ts"), T.TimestampType())).alias("from_timestamp"),
        F.unix_micros(scalars.flow_start(text, T.StringType())).alias("from_text"),
    )


CDF_SQL = """CASE WHEN {z} >= 0 THEN (1 + (1 - ({poly}) * exp(-({x}) * ({x})))) / 2
  ELSE (1 - (1 - ({poly}) * exp(-({x}) * ({x})))) / 2 END"""


def cdf_sql(z: str) -> str:
    """The same polynomial in SQL."""
    x = f"(abs({z}) / sqrt(CAST(2 AS DOUBLE)))"
    t = f"(1 / (1 + CAST({scalars.ERF_P} AS DOUBLE) * {x}))"
    poly = "0"
    for a in reversed(scalars.ERF_A):
        poly = f"(({poly}) + CAST({a} AS DOUBLE)) * {t}"
    return CDF_SQL.format(z=z, poly=poly, x=x)


@query(
    "normal_cdf",
    f"""WITH z AS (SELECT event_id AS row_id, (value - 50) / 20 AS z FROM events)
SELECT row_id, round({cdf_sql('z')}, 6) AS p FROM z""",
)
def normal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir)
    z = (F.col("value") - 50) / 20
    return e.select(F.col("event_id").alias("row_id"), F.round(scalars.normal_cdf(z), 6).alias("p"))


@query(
    "format_value",
    """SELECT event_id AS row_id, CASE WHEN abs(value / 65537) < 0.001 AND value <> 0 THEN value / 65537
       ELSE round(value / 65537, 5) END AS shown FROM events""",
)
def format_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir)
    return e.select(F.col("event_id").alias("row_id"), scalars.format_value(F.col("value") / 65537).alias("shown"))
