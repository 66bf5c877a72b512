"""Time headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
data and cores. Each query runs BENCH_RUNS times (default 3) after one warm-up
of the session; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "flagship",
    "label_time_windows",
    "label_time_windows_bucketed",
    "remove_nan_rows",
    "drop_duplicate_rows",
    "scale_min_max",
    "scale_standard",
    "encode_label",
    "impute_median",
    "preprocess_chain",
    "correlation_matrix",
    "split_stratified",
    "split_kfold",
    "split_timestamp",
    "split_cross_dataset",
    "split_benign_train",
    "confusion_matrix",
    "roc_auc",
    "pr_auc",
    "mttd",
    "metrics_long",
    "performance_drop",
    "attack_noise",
    "adversarial_accuracy",
    "robustness_curve",
    "anomaly_zscore_percentile",
    "assemble_flows",
    "stream_confusion",
    "metrics_long_multiclass",
    "csv_to_split",
    "detect_decision_tree",
    "detect_tree_stack",
    "detect_mlp",
    "detect_cluster_routed",
    "anomaly_pca",
    "stream_mttd",
    "stream_flows",
    "stream_flows_active",
    "label_time_windows_long",
    "stream_scored_sliding",
    "attack_fgsm_network",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    from flowgauge import catalog
    from flowgauge.session import local_session

    spark = local_session("flowgauge-bench", cpus, **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "flow_detection_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
