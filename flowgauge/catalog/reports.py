"""Plans, lookups, comparisons and reports over many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.catalog import views as v
from flowgauge.catalog.registry import query
from flowgauge.operators import report, runs
from flowgauge.session import scratch_path
from flowgauge.sources.sinks import write_report

KEYS = "train_dataset, model, test_dataset"

META_VALUES = ", ".join(
    "(" + ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x + "'" for x in row) + ")"
    for row in report.METRIC_METADATA
)
META = f"""meta(metric_key, display_name, category, unit, higher_is_better, comparison_group, chart_type) AS (VALUES {META_VALUES})"""

PLAN = """ds AS (SELECT DISTINCT event_type AS d FROM events),
names AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM ds),
plan AS (SELECT a.d AS train_dataset, m.model, b.d AS test_dataset,
  'cross_' || m.model || '_train-' || CAST(a.i AS VARCHAR) AS train_run_id,
  'cross_' || m.model || '_train-' || CAST(a.i AS VARCHAR) || '_test-' || CAST(b.i AS VARCHAR) AS run_id
  FROM names a, names b, (VALUES ('tree'), ('stack')) m(model))"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = v.events(spark, sf_dir).select(F.col("event_type").alias("dataset"))
    return runs.evaluation_plan(names, ["tree", "stack"], cross=True)


@query("evaluation_plan", f"WITH {PLAN} SELECT * FROM plan")
def evaluation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(
    "run_ids",
    f"""WITH {PLAN} SELECT train_dataset, model, fold, 'kfold_' || model || '_train-' || CAST(i AS VARCHAR) || '_fold ' || CAST(fold AS VARCHAR)
  || '_test-' || CAST(i AS VARCHAR) AS run_id FROM names JOIN plan ON d = train_dataset AND d = test_dataset, (SELECT CAST(range AS INTEGER) AS fold FROM range(0, 5))""",
)
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = v.events(spark, sf_dir).select(F.col("event_type").alias("dataset"))
    plan = runs.evaluation_plan(names, ["tree", "stack"], cross=False, folds=5)
    return plan.select("train_dataset", "model", "fold", "run_id")


@query(
    "pending_runs",
    f"WITH {PLAN} SELECT * FROM plan WHERE NOT (train_dataset < test_dataset AND model = 'tree')",
)
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    done = plan.where("train_dataset < test_dataset and model = 'tree'").select("run_id")
    return runs.pending_runs(plan, done)


@query(
    "merge_train_test",
    """WITH test AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, 'u' || CAST(user_id // 2 * 2 AS VARCHAR) AS train_run_id,
  count(*) AS n, CASE WHEN user_id % 3 > 0 THEN max(value) END AS top FROM events GROUP BY user_id),
train AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, max(value) AS top, min(value) AS low FROM events WHERE user_id < 100 GROUP BY user_id)
SELECT t.run_id, t.train_run_id, t.n, coalesce(t.top, r.top) AS top, r.low FROM test t LEFT JOIN train r ON t.train_run_id = r.run_id""",
)
def merge_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.events(spark, sf_dir)
    u = F.col("user_id")

    def rid(c):
        return F.concat(F.lit("u"), c.cast("string"))

    test = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("m")).select(
        rid(u).alias("run_id"),
        rid(u - u % 2).alias("train_run_id"),
        "n",
        F.when(u % 3 > 0, F.col("m")).alias("top"),
    )
    train = e.where(u < 100).groupBy("user_id").agg(F.max("value").alias("top"), F.min("value").alias("low")).select(
        rid(u).alias("run_id"), "top", "low"
    )
    return report.merge_train_test(test, train)


@query(
    "dataset_names",
    """WITH r AS (SELECT event_id AS row_id, user_id % 7 AS i FROM events)
SELECT row_id, i, CASE WHEN i < 5 THEN 'NATION_' || CAST(i AS VARCHAR) ELSE 'Dataset_' || CAST(i AS VARCHAR) END AS dataset_name FROM r""",
)
def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = v.table(spark, sf_dir, "nation").where("n_nationkey < 5").select(
        F.col("n_nationkey").cast("bigint").alias("dataset_index"), F.col("n_name").alias("name")
    )
    rows = v.events(spark, sf_dir).select(F.col("event_id").alias("row_id"), (F.col("user_id") % 7).alias("i"))
    return report.dataset_names(rows, names, "i")


@query(
    "metric_metadata_lookup",
    f"""WITH {META}, k AS (SELECT event_id AS row_id, CASE event_type WHEN 'view' THEN 'test_accuracy' WHEN 'click' THEN 'test_avg_ram_mb'
  WHEN 'error' THEN 'train_runtime_s' WHEN 'signup' THEN 'test_max_cpu_percent' ELSE 'test_own_metric' END AS metric_key, value / 65537 AS value FROM events)
SELECT k.row_id, k.metric_key, coalesce(a.display_name, b.display_name, 'Own Metric') AS display_name,
  coalesce(a.category, b.category, 'other') AS category, coalesce(a.unit, b.unit, 'unknown') AS unit,
  coalesce(a.higher_is_better, b.higher_is_better) AS higher_is_better,
  CASE WHEN abs(k.value) < 0.001 AND k.value <> 0 THEN k.value ELSE round(k.value, 5) END AS shown_value
FROM k LEFT JOIN meta a ON k.metric_key = a.metric_key LEFT JOIN meta b ON regexp_replace(k.metric_key, '^(train_|test_)', '') = b.metric_key""",
)
def metric_metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (
        F.when(F.col("event_type") == "view", "test_accuracy")
        .when(F.col("event_type") == "click", "test_avg_ram_mb")
        .when(F.col("event_type") == "error", "train_runtime_s")
        .when(F.col("event_type") == "signup", "test_max_cpu_percent")
        .otherwise("test_own_metric")
    )
    rows = v.events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), key.alias("metric_key"), (F.col("value") / 65537).alias("value")
    )
    return report.with_metadata(rows).drop("value")


@query(
    "metrics_visible",
    """WITH k AS (SELECT event_id AS row_id, CASE event_type WHEN 'view' THEN 'test_y_true' WHEN 'click' THEN 'run_id'
  WHEN 'error' THEN 'train_runtime_s' ELSE 'test_accuracy' END AS metric_key, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM events)
SELECT row_id, metric_key, value, CASE WHEN metric_key LIKE 'train%' THEN 'train' ELSE 'test' END AS phase,
  regexp_replace(metric_key, '^(train_|test_)', '') AS base_key
FROM k WHERE metric_key NOT IN ('test_y_true', 'run_id') AND value IS NOT NULL""",
)
def metrics_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    key = F.when(t == "view", "test_y_true").when(t == "click", "run_id").when(t == "error", "train_runtime_s")
    rows = v.events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"),
        key.otherwise("test_accuracy").alias("metric_key"),
        F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"),
    )
    return report.visible_metrics(rows)


# ---- comparisons ---------------------------------------------------------

PAIRS = f"""{v.RESULTS}, pairs AS (
  SELECT a.train_dataset, a.model, a.test_dataset, a.metric_key, a.attack, c.value AS clean_value, a.value AS adversarial_value
  FROM results a JOIN results c ON a.train_dataset = c.train_dataset AND a.model = c.model AND a.test_dataset = c.test_dataset
   AND a.metric_key = c.metric_key AND c.attack IS NULL WHERE a.attack IS NOT NULL)"""

DROPS = f"""{PAIRS}, drops AS (
  SELECT {KEYS}, metric_key, attack, round(clean_value, 5) AS clean_value, round(adversarial_value, 5) AS adversarial_value,
    round(clean_value - adversarial_value, 5) + 0 AS absolute_drop,
    round(CASE WHEN clean_value > 0 THEN (clean_value - adversarial_value) / clean_value * 100 ELSE 0 END, 5) + 0 AS relative_drop_percent
  FROM pairs WHERE metric_key IN ('test_accuracy', 'test_f1_score', 'test_roc_auc'))"""


@query("clean_vs_adversarial", f"WITH {PAIRS} SELECT * FROM pairs")
def clean_vs_adversarial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.clean_vs_adversarial(v.results(spark, sf_dir))


@query("performance_drop", f"WITH {DROPS} SELECT * FROM drops")
def performance_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.performance_drop(v.results(spark, sf_dir))


@query(
    "robustness_summary",
    f"""WITH {DROPS} SELECT {KEYS}, metric_key, round(avg(relative_drop_percent), 5) + 0 AS avg_drop_percent,
  round(max(relative_drop_percent), 5) + 0 AS max_drop_percent, round(min(relative_drop_percent), 5) + 0 AS min_drop_percent
FROM drops GROUP BY ALL""",
)
def robustness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.robustness_summary(report.performance_drop(v.results(spark, sf_dir)))


@query(
    "run_overview",
    f"""WITH {v.RESULTS}, t AS (SELECT DISTINCT {KEYS}, attack FROM results)
SELECT CASE WHEN bool_or(attack IS NULL AND train_dataset <> test_dataset) THEN 'cross_dataset' ELSE 'single_dataset' END AS evaluation_type,
  string_agg(DISTINCT model, ',' ORDER BY model) AS models,
  (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT train_dataset AS d FROM t UNION SELECT test_dataset FROM t)) AS datasets,
  count(*) FILTER (WHERE attack IS NULL) AS total_test_runs, string_agg(DISTINCT attack, ',' ORDER BY attack) AS attacks_used,
  count(*) FILTER (WHERE attack IS NOT NULL) AS total_adversarial_tests FROM t""",
)
def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_overview(v.results(spark, sf_dir))


@query(
    "metrics_by_category",
    f"""WITH {META}, {v.RESULTS}
SELECT {KEYS}, category, count(*) AS n_metrics,
  string_agg(metric_key || '=' || printf('%.5f', CASE WHEN abs(value) < 0.001 AND value <> 0 THEN value ELSE round(value, 5) END), ';' ORDER BY metric_key) AS metrics
FROM results JOIN meta USING (metric_key) WHERE attack IS NULL GROUP BY {KEYS}, category""",
)
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metrics_by_category(v.results(spark, sf_dir))


@query(
    "train_test_matrix",
    f"""WITH {v.RESULTS} SELECT model, train_dataset, max(value) FILTER (WHERE test_dataset = 'D0') AS "D0",
  max(value) FILTER (WHERE test_dataset = 'D1') AS "D1", max(value) FILTER (WHERE test_dataset = 'D2') AS "D2"
FROM results WHERE attack IS NULL AND metric_key = 'test_accuracy' GROUP BY model, train_dataset""",
)
def train_test_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.train_test_matrix(v.results(spark, sf_dir), "accuracy", ["D0", "D1", "D2"])


SERIES = f"""{v.RESULTS}, series AS (SELECT metric_key, model, CASE WHEN train_dataset <> test_dataset
  THEN train_dataset || ' -> ' || test_dataset ELSE test_dataset END AS dataset_label, value FROM results WHERE attack IS NULL)"""


@query("comparison_series", f"WITH {SERIES} SELECT * FROM series")
def comparison_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.comparison_series(v.results(spark, sf_dir))


@query(
    "model_resource_avg",
    f"WITH {SERIES} SELECT metric_key, model, round(avg(value), 5) AS avg_value FROM series GROUP BY metric_key, model",
)
def model_resource_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.model_average(v.results(spark, sf_dir))


@query(
    "model_sizes",
    """SELECT event_type AS model, arg_min(value, event_id) FILTER (WHERE event_id % 4 > 0) AS model_size_mb FROM events GROUP BY event_type""",
)
def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = v.events(spark, sf_dir).select(
        F.col("event_type").alias("model"),
        F.col("event_id").alias("run_order"),
        F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("model_size_mb"),
    )
    return report.model_sizes(sizes)


@query(
    "comparison_groups",
    f"""WITH {META}, {v.RESULTS}, present AS (SELECT DISTINCT metric_key FROM results)
SELECT comparison_group, chart_type, string_agg(metric_key, ',' ORDER BY metric_key) AS metrics
FROM present JOIN meta USING (metric_key) WHERE comparison_group IS NOT NULL AND chart_type IS NOT NULL GROUP BY ALL""",
)
def comparison_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.comparison_groups(v.results(spark, sf_dir))


@query(
    "report_summary",
    f"""WITH {v.RESULTS} SELECT model, '{{"model":"' || model || '","tests":' || CAST(count(DISTINCT (train_dataset, test_dataset)) AS VARCHAR) || ',"metrics":'
  || CAST(count(DISTINCT metric_key) AS VARCHAR) || '}}' AS report FROM results WHERE attack IS NULL GROUP BY model""",
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = v.results(spark, sf_dir).where("attack is null")
    counted = clean.groupBy("model").agg(
        F.count_distinct(F.struct("train_dataset", "test_dataset")).alias("tests"),
        F.count_distinct("metric_key").alias("metrics"),
    )
    path = scratch_path(spark, "report")
    write_report(counted.select("model", "tests", "metrics"), path)
    written = spark.read.text(path).select(F.col("value").alias("report"))
    return written.select(F.get_json_object("report", "$.model").alias("model"), "report")


@query("nested_report")
def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nested_report(v.results(spark, sf_dir))


@query("nested_report_losses", f"WITH {DROPS} SELECT * FROM drops")
def nested_report_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The losses under attack as they stand in the nested report, read back from its JSON."""
    loss = "struct<metric_key:string,clean_value:double,adversarial_value:double,absolute_drop:double,relative_drop_percent:double>"
    kind = f"array<struct<dataset:string,adversarial_performance:array<struct<attack:string,performance_drop:array<{loss}>>>>>"
    nested = report.nested_report(v.results(spark, sf_dir)).select("train_dataset", "model", F.inline(F.from_json("tested_on", kind)))
    tests = nested.select("train_dataset", "model", F.col("dataset").alias("test_dataset"), F.inline("adversarial_performance"))
    losses = tests.select("train_dataset", "model", "test_dataset", "attack", F.inline("performance_drop"))
    return losses.select(*report.performance_drop(v.results(spark, sf_dir)).columns)
