"""Comparison tables over the long metrics table.

``results`` holds (train_dataset, model, test_dataset, fold, attack, metric_key,
value); attack is NULL on clean runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions.scalars import display_name, format_value
from flowgauge.operators.small import attach

# Metric key, display name, category, unit, higher is better, comparison group, chart type.
METRIC_METADATA = [
    ("test_accuracy", "Accuracy", "detection", "ratio", True, "detection_performance", "grouped_bar"),
    ("test_confusion_matrix", "Confusion Matrix", "detection", None, None, None, None),
    ("test_confusion_matrix_normalized", "Confusion Matrix (Normalized)", "detection", None, None, None, None),
    ("test_f1_score", "F1 Score", "detection", "ratio", True, "detection_performance", "grouped_bar"),
    ("test_f1_score_macro", "F1 Score (Macro)", "detection", "ratio", True, "detection_performance", "grouped_bar"),
    ("test_precision_score", "Precision", "detection", "ratio", True, None, None),
    ("test_precision_score_macro", "Precision (Macro)", "detection", "ratio", True, None, None),
    ("test_recall_score", "Recall", "detection", "ratio", True, None, None),
    ("test_recall_score_macro", "Recall (Macro)", "detection", "ratio", True, None, None),
    ("test_matthews_correlation_coefficient", "MCC", "detection", "ratio", True, "detection_performance", "grouped_bar"),
    ("test_intrusion_detection_capability", "IDC", "detection", "ratio", True, "detection_performance", "grouped_bar"),
    ("test_intrusion_detection_capability_binary", "IDC (Binary)", "detection", "ratio", True, "detection_performance", "grouped_bar"),
    ("test_roc_auc", "ROC AUC", "detection", "ratio", True, "detection_performance", "grouped_bar"),
    ("test_pr_auc", "PR-AUC (Average Precision)", "detection", "ratio", True, "detection_performance", "grouped_bar"),
    ("test_fppv", "FPPV", "detection", "FP/GB", False, None, None),
    ("test_fp_per_million", "FP per Million Samples", "detection", "FP/1M samples", False, None, None),
    ("test_mttd_samples", "MTTD (samples)", "detection", "samples", False, None, None),
    ("test_attack_instances_total", "Attack Instances (Total)", "detection", None, None, None, None),
    ("test_attack_instances_detected", "Attack Instances (Detected)", "detection", None, True, None, None),
    ("test_attack_instances_undetected", "Attack Instances (Undetected)", "detection", None, False, None, None),
    ("test_robustness_index", "Robustness Index", "other", "ratio", True, "robustness", "grouped_bar"),
    ("test_time_per_sample_ms", "Time per Data Sample", "runtime", "ms/sample", False, "time_per_sample", "horizontal_bar"),
    ("test_throughput_samples_per_s", "Throughput", "runtime", "samples/s", True, "throughput", "horizontal_bar"),
    ("train_model_retrain_cost", "Retrain Cost", "resource", None, False, "retrain_cost", "horizontal_bar"),
    ("train_model_retrain_time_cost", "Retrain Time Cost", "resource", "weighted seconds", False, None, None),
    ("train_model_retrain_resource_cost", "Retrain Resource Cost", "resource", None, False, None, None),
    ("runtime_s", "Runtime", "runtime", "seconds", False, "test_runtime", "horizontal_bar"),
    ("avg_cpu_percent", "Avg CPU", "resource", "percent", False, "cpu_load", "horizontal_bar"),
    ("max_cpu_percent", "Max CPU", "resource", "percent", False, "cpu_load", "horizontal_bar"),
    ("min_cpu_percent", "Min CPU", "resource", "percent", None, None, None),
    ("cpu_sample_count", "CPU Samples", "resource", None, None, None, None),
    ("avg_ram_mb", "Avg RAM", "resource", "MB", False, "ram_usage", "horizontal_bar"),
    ("max_ram_mb", "Max RAM", "resource", "MB", False, "ram_usage", "horizontal_bar"),
    ("min_ram_mb", "Min RAM", "resource", "MB", None, None, None),
    ("ram_sample_count", "RAM Samples", "resource", None, None, None, None),
]

# Keys that never appear in a report.
INTERNAL_KEYS = [
    "run_id",
    "train_run_id",
    "train_dataset_index",
    "test_dataset_index",
    "train_fold",
    "test_fold",
    "train_ids_plugin",
    "test_ids_plugin",
    "train_dataset_indices",
    "test_dataset_indices",
    "evaluation_scope",
    "test_y_true",
    "test_y_pred",
    "test_y_proba",
    "is_adversarial",
    "test_attack_name",
    "test_n_samples",
    "test_data_size_gb",
]

# Metrics whose loss under attack is reported; the wider list adds precision and recall.
DROP_METRICS = ["test_accuracy", "test_f1_score", "test_roc_auc"]
ALL_DROP_METRICS = [*DROP_METRICS, "test_precision_score", "test_recall_score"]

RUN_KEYS = ["train_dataset", "model", "test_dataset", "fold"]


def metadata_frame(spark: SparkSession) -> DataFrame:
    schema = (
        "metric_key string, display_name string, category string, unit string, "
        "higher_is_better boolean, comparison_group string, chart_type string"
    )
    return spark.createDataFrame(METRIC_METADATA, schema)


def visible_metrics(results: DataFrame, key: str = "metric_key", value: str = "value") -> DataFrame:
    """Drop internal keys and absent values; split the phase prefix off the key."""
    shown = results.where(~F.col(key).isin(INTERNAL_KEYS) & F.col(value).isNotNull())
    phase = F.when(F.col(key).startswith("train_"), "train").otherwise("test")
    return shown.withColumn("phase", phase).withColumn("base_key", F.regexp_replace(key, "^(train_|test_)", ""))


def with_metadata(results: DataFrame, value: str = "value") -> DataFrame:
    """Name, category, unit and direction of each metric: by key, then by key without prefix, else inferred."""
    meta = metadata_frame(results.sparkSession)
    exact = meta.select(*[F.col(c).alias(f"m_{c}") for c in meta.columns])
    bare = meta.select(*[F.col(c).alias(f"b_{c}") for c in meta.columns])
    base = F.regexp_replace("metric_key", "^(train_|test_)", "")
    # the metadata is a fixed list of a few dozen rows
    joined = results.join(F.broadcast(exact), F.col("metric_key") == F.col("m_metric_key"), "left").join(
        F.broadcast(bare), base == F.col("b_metric_key"), "left"
    )
    known = F.col("m_metric_key").isNotNull()

    def pick(c: str) -> Column:
        return F.when(known, F.col(f"m_{c}")).otherwise(F.col(f"b_{c}"))

    found = known | F.col("b_metric_key").isNotNull()
    return joined.select(
        *results.columns,
        F.when(found, pick("display_name")).otherwise(display_name("metric_key")).alias("display_name"),
        F.when(found, pick("category")).otherwise("other").alias("category"),
        F.when(found, pick("unit")).otherwise("unknown").alias("unit"),
        pick("higher_is_better").alias("higher_is_better"),
        format_value(F.col(value)).alias("shown_value"),
    )


def merge_train_test(test: DataFrame, train: DataFrame) -> DataFrame:
    """Each test record with the metrics of the run that trained its model; test values win, unmatched stay."""
    taken = [c for c in train.columns if c != "run_id"]
    t = train.select(F.col("run_id").alias("__id"), *[F.col(c).alias(f"__t_{c}") for c in taken])
    joined = test.join(t, test["train_run_id"] == t["__id"], "left")
    cols = [F.coalesce(c, f"__t_{c}").alias(c) if c in taken else F.col(c) for c in test.columns]
    cols += [F.col(f"__t_{c}").alias(c) for c in taken if c not in test.columns]
    return joined.select(*cols)


def dataset_names(results: DataFrame, names: DataFrame, index: str) -> DataFrame:
    """Name of a dataset index, ``Dataset_<i>`` when it has none; ``names`` is one row per dataset."""
    lookup = names.select(F.col("dataset_index").alias(index), F.col("name").alias("__name"))
    joined = attach(results, lookup, [index])
    fallback = F.concat(F.lit("Dataset_"), F.col(index).cast("string"))
    return joined.withColumn("dataset_name", F.coalesce("__name", fallback)).drop("__name")


def _keys(results: DataFrame) -> list[str]:
    return [k for k in RUN_KEYS if k in results.columns]


def clean_vs_adversarial(results: DataFrame) -> DataFrame:
    """Clean and attacked value of each metric, matched on dataset pair, model and fold."""
    keys = _keys(results)
    clean = results.where("attack is null").select(*keys, "metric_key", F.col("value").alias("clean_value"))
    adv = results.where("attack is not null").select(*keys, "metric_key", "attack", F.col("value").alias("adversarial_value"))
    a, c = adv.alias("a"), clean.alias("c")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "metric_key"]]
    return a.join(c, on).select(*[f"a.{k}" for k in [*keys, "metric_key", "attack"]], "clean_value", "adversarial_value")


def performance_drop(results: DataFrame, all_metrics: bool = False) -> DataFrame:
    """Absolute loss and loss in percent of the clean value (0 unless that is positive)."""
    wanted = ALL_DROP_METRICS if all_metrics else DROP_METRICS
    pairs = clean_vs_adversarial(results.where(F.col("metric_key").isin(wanted)))
    drop = F.col("clean_value") - F.col("adversarial_value")
    relative = F.when(F.col("clean_value") > 0, F.try_divide(drop, F.col("clean_value")) * 100).otherwise(0.0)
    return pairs.select(
        *[c for c in pairs.columns if not c.endswith("_value")],
        F.round("clean_value", 5).alias("clean_value"),
        F.round("adversarial_value", 5).alias("adversarial_value"),
        F.round(drop, 5).alias("absolute_drop"),
        F.round(relative, 5).alias("relative_drop_percent"),
    )


def robustness_summary(drops: DataFrame) -> DataFrame:
    d = F.col("relative_drop_percent")
    return drops.groupBy(*_keys(drops), "metric_key").agg(
        F.round(F.avg(d), 5).alias("avg_drop_percent"),
        F.round(F.max(d), 5).alias("max_drop_percent"),
        F.round(F.min(d), 5).alias("min_drop_percent"),
    )


def run_overview(results: DataFrame) -> DataFrame:
    """Models, datasets (trained or tested on), number of tests and attacks, single or cross evaluation."""
    tests = results.select(*_keys(results), "attack").distinct()
    clean = F.col("attack").isNull()
    cross = F.coalesce(F.bool_or(F.when(clean, F.col("train_dataset") != F.col("test_dataset"))), F.lit(False))
    return tests.agg(
        F.when(cross, "cross_dataset").otherwise("single_dataset").alias("evaluation_type"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
        F.array_join(
            F.sort_array(F.array_distinct(F.concat(F.collect_set("train_dataset"), F.collect_set("test_dataset")))), ","
        ).alias("datasets"),
        F.count_if(clean).alias("total_test_runs"),
        F.array_join(F.sort_array(F.collect_set("attack")), ",").alias("attacks_used"),
        F.count_if(~clean).alias("total_adversarial_tests"),
    )


def metrics_by_category(results: DataFrame) -> DataFrame:
    """Clean metrics of each run as one text per category, ordered by key."""
    shown = with_metadata(visible_metrics(results.where("attack is null")))
    keys = _keys(results)
    pair = F.struct("metric_key", F.concat_ws("=", F.col("metric_key"), F.format_string("%.5f", F.col("shown_value"))).alias("t"))
    grouped = shown.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n_metrics"), F.sort_array(F.collect_list(pair)).alias("p"))
    return grouped.select(*keys, "category", "n_metrics", F.array_join(F.transform("p", lambda x: x["t"]), ";").alias("metrics"))


def train_test_matrix(results: DataFrame, metric: str, tests: list[str]) -> DataFrame:
    """Rows are training sets, columns test sets, NULL where not run; needs two test sets."""
    if len(tests) < 2:
        raise ValueError("a train-test matrix needs at least two test datasets")
    picked = results.where(F.col("attack").isNull() & F.col("metric_key").isin(metric, f"test_{metric}"))
    # duplicates (folds) keep the last one
    last = F.max_by("value", "fold") if "fold" in results.columns else F.max("value")
    return picked.groupBy("model", "train_dataset").pivot("test_dataset", tests).agg(last)


def comparison_series(results: DataFrame) -> DataFrame:
    """Clean value per metric, model and dataset label (``A -> B`` across datasets)."""
    cross = F.col("train_dataset") != F.col("test_dataset")
    label = F.when(cross, F.concat("train_dataset", F.lit(" -> "), "test_dataset")).otherwise(F.col("test_dataset"))
    return results.where("attack is null").select("metric_key", "model", label.alias("dataset_label"), "value")


def model_average(results: DataFrame) -> DataFrame:
    """Mean over datasets per metric and model."""
    return comparison_series(results).groupBy("metric_key", "model").agg(F.round(F.avg("value"), 5).alias("avg_value"))


def model_sizes(sizes: DataFrame, order: str = "run_order") -> DataFrame:
    """First known size of each model."""
    known = sizes.where("model_size_mb is not null")
    return known.groupBy("model").agg(F.min_by("model_size_mb", order).alias("model_size_mb"))


def comparison_groups(results: DataFrame) -> DataFrame:
    """Metrics present in the results per comparison group and chart type."""
    meta = metadata_frame(results.sparkSession).where("comparison_group is not null and chart_type is not null")
    present = results.select("metric_key").distinct().join(F.broadcast(meta), "metric_key")
    return present.groupBy("comparison_group", "chart_type").agg(
        F.array_join(F.sort_array(F.collect_list("metric_key")), ",").alias("metrics")
    )


def nested_report(results: DataFrame) -> DataFrame:
    """One JSON text per (training set, model): tests with clean metrics, attacks, losses and their summary."""
    if "fold" in results.columns:
        results = results.fillna(-1, ["fold"])
    named = with_metadata(visible_metrics(results))
    slug = F.lower(F.replace("display_name", F.lit(" "), F.lit("_")))
    keys = _keys(results)
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(slug.alias("k"), F.col("shown_value").alias("v")))))
    by_category = named.groupBy(*keys, "attack", "category").agg(entries.alias("m"))
    per_run = by_category.groupBy(*keys, "attack").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.map_entries("m").alias("e"))))).alias("by_cat")
    )
    per_run = per_run.select(*keys, "attack", F.transform_values("by_cat", lambda k, v: F.map_from_entries(v)).alias("metrics"))
    drops = performance_drop(results)
    losses = drops.groupBy(*keys, "attack").agg(
        F.sort_array(
            F.collect_list(F.struct("metric_key", "clean_value", "adversarial_value", "absolute_drop", "relative_drop_percent"))
        ).alias("performance_drop")
    )
    summary = robustness_summary(drops).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("metric_key", "avg_drop_percent", "max_drop_percent", "min_drop_percent"))).alias("robustness_summary")
    )
    clean = per_run.where("attack is null").select(*keys, F.col("metrics").alias("clean_performance"))
    attacked = (
        per_run.where("attack is not null")
        .join(losses, [*keys, "attack"], "left")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("attack", F.to_json("metrics").alias("metrics"), "performance_drop"))).alias("adversarial_performance"))
    )
    tests = clean.join(attacked, keys, "left").join(summary, keys, "left")
    test = F.struct(
        F.col("test_dataset").alias("dataset"),
        (F.col("train_dataset") != F.col("test_dataset")).alias("is_cross_dataset"),
        F.to_json("clean_performance").alias("clean_performance"),
        "adversarial_performance",
        "robustness_summary",
    )
    return tests.groupBy("train_dataset", "model").agg(F.to_json(F.sort_array(F.collect_list(test))).alias("tested_on"))
