"""Detection, ranking, time-to-detect, cost and robustness metrics per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.catalog import views as v
from flowgauge.catalog.registry import query
from flowgauge.operators import metrics as m
from flowgauge.operators import perturb

# ---- SQL fragments -------------------------------------------------------

COUNTS = """counts AS (
  SELECT run_id, CAST(count(*) AS DOUBLE) AS n,
         CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS DOUBLE) AS tn,
         CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp
  FROM preds GROUP BY run_id)"""


def h(p: str) -> str:
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN -(({p}) * log2({p}) + (1 - ({p})) * log2(1 - ({p}))) ELSE 0 END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"


ACC = "round((tp + tn) / n, 5)"
PREC = f"round({ratio('tp', 'tp + fp')}, 5)"
REC = f"round({ratio('tp', 'tp + fn')}, 5)"
F1 = f"round({ratio('2 * tp', '2 * tp + fp + fn')}, 5)"
MCC = """round(greatest(0, coalesce((tp * tn - fp * fn) /
  nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)), 5)"""
BASE_H = h("(tp + fn) / n")
IDC = f"""round(CASE WHEN ({BASE_H}) = 0 THEN 0 ELSE (({BASE_H})
  - ((tp + fp) / n * ({h('(' + ratio('tp', 'tp + fp') + ')')}) + (tn + fn) / n * ({h('(' + ratio('tn', 'tn + fn') + ')')})))
  / ({BASE_H}) END, 5)"""

CURVE = """points AS (
  SELECT run_id, score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg
  FROM preds GROUP BY run_id, score),
curve AS (
  SELECT run_id, score, pos, neg, CAST(sum(pos) OVER w AS DOUBLE) AS cp, CAST(sum(neg) OVER w AS DOUBLE) AS cn,
         CAST(sum(pos) OVER (PARTITION BY run_id) AS DOUBLE) AS tp, CAST(sum(neg) OVER (PARTITION BY run_id) AS DOUBLE) AS tn
  FROM points WINDOW w AS (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""

AUC = "round(sum((cp - pos / CAST(2 AS DOUBLE)) * neg) / (any_value(tp) * any_value(tn)), 5)"
AP = "round(sum(pos * (cp / (cp + cn))) / any_value(tp), 5)"

ISLANDS = """o AS (SELECT run_id, row_id, y_true, y_pred, row_number() OVER w AS rn, lag(y_true) OVER w AS prev
      FROM preds WINDOW w AS (PARTITION BY run_id ORDER BY row_id)),
g AS (SELECT *, sum(CASE WHEN y_true = 1 AND coalesce(prev, 0) = 0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY run_id ORDER BY rn) AS island FROM o),
inst AS (SELECT run_id, island, min(rn) AS s, min(rn) FILTER (WHERE y_pred = 1) AS f FROM g WHERE y_true = 1 GROUP BY run_id, island),
det AS (SELECT run_id, round(coalesce(avg(f - s), CAST('Infinity' AS DOUBLE)), 5) AS mttd_samples, count(*) AS attack_instances_total,
      count(f) AS attack_instances_detected, count(*) - count(f) AS attack_instances_undetected FROM inst GROUP BY run_id)"""

# ---- counts --------------------------------------------------------------


@query(
    "confusion_matrix",
    f"""WITH {v.PREDS_MULTI}, c AS (SELECT DISTINCT run_id, unnest([y_true, y_pred]) AS k FROM preds_multi),
pairs AS (SELECT run_id, y_true, y_pred, count(*) AS n FROM preds_multi GROUP BY ALL)
SELECT a.run_id, a.k AS y_true, b.k AS y_pred, coalesce(p.n, 0) AS n FROM c a JOIN c b ON a.run_id = b.run_id
LEFT JOIN pairs p ON p.run_id = a.run_id AND p.y_true = a.k AND p.y_pred = b.k""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.confusion(v.preds_multi(spark, sf_dir))


@query(
    "confusion_matrix_normalized",
    f"""WITH {v.PREDS_MULTI}, c AS (SELECT DISTINCT run_id, unnest([y_true, y_pred]) AS k FROM preds_multi),
pairs AS (SELECT run_id, y_true, y_pred, count(*) AS n FROM preds_multi GROUP BY ALL),
f AS (SELECT a.run_id, a.k AS y_true, b.k AS y_pred, coalesce(p.n, 0) AS n FROM c a JOIN c b ON a.run_id = b.run_id
LEFT JOIN pairs p ON p.run_id = a.run_id AND p.y_true = a.k AND p.y_pred = b.k)
SELECT run_id, y_true, y_pred, round(coalesce(n / CAST(nullif(sum(n) OVER (PARTITION BY run_id, y_true), 0) AS DOUBLE), 0), 5) AS share FROM f""",
)
def confusion_matrix_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.confusion_normalized(v.preds_multi(spark, sf_dir))


@query("accuracy", f"WITH {v.PREDS_MULTI} SELECT run_id, round(avg(CAST(y_true = y_pred AS INTEGER)), 5) AS accuracy FROM preds_multi GROUP BY run_id")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.accuracy(v.preds_multi(spark, sf_dir))


def _count_metric(name: str, column: str, expression: str) -> None:
    @query(name, f"WITH {v.PREDS}, {COUNTS} SELECT run_id, {expression} AS {column} FROM counts")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return m.count_metrics(v.preds(spark, sf_dir)).select("run_id", column)


_count_metric("precision_binary", "precision_score", PREC)
_count_metric("recall_binary", "recall_score", REC)
_count_metric("f1_binary", "f1_score", F1)
_count_metric("mcc_binary", "matthews_correlation_coefficient", MCC)
_count_metric("intrusion_detection_capability", "intrusion_detection_capability", IDC)
_count_metric("fp_per_million", "fp_per_million", "round(fp / n * 1e6, 5)")

CLASS_CELLS = """c AS (SELECT DISTINCT run_id, unnest([y_true, y_pred]) AS k FROM preds_multi),
k AS (SELECT c.run_id, c.k, CAST(count(*) FILTER (WHERE y_true = k AND y_pred = k) AS DOUBLE) AS tp,
        CAST(count(*) FILTER (WHERE y_true <> k AND y_pred = k) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE y_true = k AND y_pred <> k) AS DOUBLE) AS fn
      FROM c JOIN preds_multi p ON c.run_id = p.run_id GROUP BY c.run_id, c.k)"""
CLASS_COUNTS = f"{v.PREDS_MULTI}, {CLASS_CELLS}"


def _macro_metric(name: str, column: str, expression: str) -> None:
    @query(name, f"WITH {CLASS_COUNTS} SELECT run_id, round(avg({expression}), 5) AS {column} FROM k GROUP BY run_id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return m.macro_metrics(v.preds_multi(spark, sf_dir)).select("run_id", column)


_macro_metric("precision_macro", "precision_score_macro", ratio("tp", "tp + fp"))
_macro_metric("recall_macro", "recall_score_macro", ratio("tp", "tp + fn"))
_macro_metric("f1_macro", "f1_score_macro", ratio("2 * tp", "2 * tp + fp + fn"))


@query(
    "mcc_multiclass",
    f"""WITH {CLASS_COUNTS}, s AS (SELECT run_id, sum(tp) AS c, sum(tp + fn) AS s, sum((tp + fp) * (tp + fn)) AS pt,
       sum((tp + fp) * (tp + fp)) AS pp, sum((tp + fn) * (tp + fn)) AS tt FROM k GROUP BY run_id)
SELECT run_id, round(greatest(0, coalesce((c * s - pt) / nullif(sqrt(s * s - pp) * sqrt(s * s - tt), 0), 0)), 5)
  AS matthews_correlation_coefficient FROM s""",
)
def mcc_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mcc_multiclass(v.preds_multi(spark, sf_dir))


@query(
    "fp_per_volume",
    f"""WITH {v.PREDS} SELECT run_id, round(count(*) FILTER (WHERE y_true = 0 AND y_pred = 1)
  / (CAST(sum(floor(value) + 40) AS DOUBLE) / CAST(1073741824 AS DOUBLE)), 5) AS fppv FROM preds GROUP BY run_id""",
)
def fp_per_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = v.preds(spark, sf_dir).withColumn("bytes", F.floor("value") + 40)
    return m.fp_per_volume(sized, "bytes")


# ---- rankings ------------------------------------------------------------


@query("roc_auc", f"WITH {v.PREDS}, {CURVE} SELECT run_id, {AUC} AS roc_auc FROM curve GROUP BY run_id")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ranking_metrics(m.score_curve(v.preds(spark, sf_dir))).select("run_id", "roc_auc")


@query("pr_auc", f"WITH {v.PREDS}, {CURVE} SELECT run_id, {AP} AS pr_auc FROM curve GROUP BY run_id")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ranking_metrics(m.score_curve(v.preds(spark, sf_dir))).select("run_id", "pr_auc")


@query(
    "roc_points",
    f"WITH {v.PREDS}, {CURVE} SELECT run_id, score AS threshold, round(cn / tn, 6) AS fpr, round(cp / tp, 6) AS tpr FROM curve",
)
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.roc_points(m.score_curve(v.preds(spark, sf_dir)))


@query(
    "pr_points",
    f"""WITH {v.PREDS}, {CURVE} SELECT run_id, score AS threshold, round(cp / tp, 6) AS recall,
  round(cp / (cp + cn), 6) AS precision, round(tp / (tp + tn), 6) AS baseline FROM curve""",
)
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pr_points(m.score_curve(v.preds(spark, sf_dir)))


# ---- order and cost ------------------------------------------------------


@query("mttd", f"WITH {v.PREDS}, {ISLANDS} SELECT * FROM det")
def mttd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.time_to_detect(v.preds(spark, sf_dir))


RUN_TIMES = f"""{v.PREDS}, times AS (
  SELECT run_id, sum(value) / CAST(1000 AS DOUBLE) AS runtime_s, count(*) AS n FROM preds GROUP BY run_id)"""


@query(
    "time_per_sample",
    f"""WITH {RUN_TIMES} SELECT run_id, round(runtime_s / n * 1000, 6) AS time_per_sample_ms,
  round(n / runtime_s, 5) AS throughput_samples_per_s FROM times""",
)
def time_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = v.preds(spark, sf_dir).groupBy("run_id").agg(
        (F.sum("value") / 1000.0).alias("runtime_s"), F.count(F.lit(1)).alias("n")
    )
    return m.time_per_sample(times, F.col("runtime_s"), F.col("n"))


@query(
    "retrain_cost",
    f"""WITH {v.PREDS}, c AS (SELECT run_id, sum(value) / CAST(1000 AS DOUBLE) AS t, avg(value) AS cpu, max(value) * 100 AS mb FROM preds GROUP BY run_id)
SELECT run_id, round(t + CAST(0.000001 AS DOUBLE) * (cpu * mb), 5) AS model_retrain_cost, round(t, 5) AS model_retrain_time_cost,
  round(CAST(0.000001 AS DOUBLE) * (cpu * mb), 5) AS model_retrain_resource_cost FROM c""",
)
def retrain_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = v.preds(spark, sf_dir).groupBy("run_id").agg(
        (F.sum("value") / 1000.0).alias("t"), F.avg("value").alias("cpu"), (F.max("value") * 100).alias("mb")
    )
    return m.retrain_cost(costs, F.col("t"), F.col("cpu"), F.col("mb"))


@query(
    "resource_summary",
    f"""WITH {v.DIRTY}, {v.FINITE}, s AS (SELECT u AS run, coalesce(cat, 'none') AS phase, value AS cpu, value * 10 AS ram FROM finite)
SELECT run, phase, round(avg(cpu), 3) AS avg_cpu_percent, round(max(cpu), 5) AS max_cpu_percent, round(min(cpu), 5) AS min_cpu_percent,
  count(cpu) AS cpu_sample_count, round(avg(ram), 5) AS avg_ram_mb, round(max(ram), 5) AS max_ram_mb,
  round(min(ram), 5) AS min_ram_mb, count(ram) AS ram_sample_count FROM s GROUP BY run, phase""",
)
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.functions.scalars import fold_missing

    d = fold_missing(v.dirty(spark, sf_dir))
    samples = d.select(
        F.col("u").alias("run"),
        F.coalesce("cat", F.lit("none")).alias("phase"),
        F.col("value").alias("cpu"),
        (F.col("value") * 10).alias("ram"),
    )
    return m.resource_summary(samples, ["run", "phase"], "cpu", "ram")


# ---- robustness ----------------------------------------------------------

MARGIN = "CAST(-0.6 AS DOUBLE) + CAST(2 AS DOUBLE) * {x1} + CAST(-1 AS DOUBLE) * {x2} + CAST(0.5 AS DOUBLE) * {x3}"


def margin_sql(x1: str = "x1", x2: str = "x2", x3: str = "x3") -> str:
    return "(" + MARGIN.format(x1=x1, x2=x2, x3=x3) + ")"


def fgsm_sql(eps: str) -> list[str]:
    side = f"CASE WHEN {margin_sql()} >= 0 THEN -1 ELSE 1 END"
    return [f"least(greatest({c} + {eps} * ({s} * {side}), 0), 1)" for c, s in (("x1", 1), ("x2", -1), ("x3", 1))]


EPS = perturb.DEFAULT_EPSILONS
EPS_SQL = ", ".join(f"(CAST({e} AS DOUBLE))" for e in [0.0, *EPS])
ROBUST = f"""{v.UNIT}, eps(epsilon) AS (VALUES {EPS_SQL}),
moved AS (SELECT run_id, target_label, epsilon,
  {', '.join(f"CASE WHEN epsilon > 0 THEN {e} ELSE {c} END AS {c}" for c, e in zip(v.FEATURES, fgsm_sql('epsilon')))} FROM unit, eps),
curve AS (SELECT run_id, round(epsilon, 6) AS epsilon,
  round(avg(CAST(target_label = CAST({margin_sql()} >= 0 AS INTEGER) AS INTEGER)), 5) AS accuracy FROM moved GROUP BY run_id, epsilon)"""


@query("robustness_curve", f"WITH {ROBUST} SELECT run_id, epsilon, accuracy FROM curve")
def robustness_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = perturb.sweep_linear(v.unit(spark, sf_dir), v.WEIGHTS, v.BIAS)
    hit = (perturb.linear_margin(v.WEIGHTS, v.BIAS) >= 0).cast("int")
    scored = moved.withColumn("y_true", F.col("target_label")).withColumn("y_pred", hit)
    return perturb.robustness_curve(scored, ["run_id"])


@query(
    "robustness_index",
    f"""WITH {ROBUST}, p AS (SELECT run_id, epsilon, accuracy, lag(epsilon) OVER w AS e0, lag(accuracy) OVER w AS a0
  FROM curve WINDOW w AS (PARTITION BY run_id ORDER BY epsilon))
SELECT run_id, round(sum((accuracy + a0) / 2 * (epsilon - e0)) / (max(epsilon) - min(epsilon)), 5) AS robustness_index FROM p GROUP BY run_id""",
)
def robustness_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.robustness_index(robustness_curve(spark, sf_dir))


# ---- all metrics ---------------------------------------------------------

LONG = f"""{v.PREDS}, {COUNTS}, {CURVE}, {ISLANDS}, metrics AS (
  SELECT run_id, 'test_accuracy' AS metric_key, CAST({ACC} AS DOUBLE) AS value FROM counts
  UNION ALL SELECT run_id, 'test_precision_score', {PREC} FROM counts
  UNION ALL SELECT run_id, 'test_recall_score', {REC} FROM counts
  UNION ALL SELECT run_id, 'test_f1_score', {F1} FROM counts
  UNION ALL SELECT run_id, 'test_matthews_correlation_coefficient', {MCC} FROM counts
  UNION ALL SELECT run_id, 'test_intrusion_detection_capability', {IDC} FROM counts
  UNION ALL SELECT run_id, 'test_fp_per_million', round(fp / n * 1e6, 5) FROM counts
  UNION ALL SELECT run_id, 'test_confusion_matrix_tn', tn FROM counts
  UNION ALL SELECT run_id, 'test_confusion_matrix_fp', fp FROM counts
  UNION ALL SELECT run_id, 'test_confusion_matrix_fn', fn FROM counts
  UNION ALL SELECT run_id, 'test_confusion_matrix_tp', tp FROM counts
  UNION ALL SELECT run_id, 'test_fppv', round(count(*) FILTER (WHERE y_true = 0 AND y_pred = 1)
    / (CAST(sum(floor(value) + 40) AS DOUBLE) / CAST(1073741824 AS DOUBLE)), 5) FROM preds GROUP BY run_id
  UNION ALL SELECT run_id, 'test_roc_auc', {AUC} FROM curve GROUP BY run_id
  UNION ALL SELECT run_id, 'test_pr_auc', {AP} FROM curve GROUP BY run_id
  UNION ALL SELECT run_id, 'test_mttd_samples', mttd_samples FROM det
  UNION ALL SELECT run_id, 'test_attack_instances_total', attack_instances_total FROM det
  UNION ALL SELECT run_id, 'test_attack_instances_detected', attack_instances_detected FROM det
  UNION ALL SELECT run_id, 'test_attack_instances_undetected', attack_instances_undetected FROM det)"""


@query("metrics_long", f"WITH {LONG} SELECT run_id, metric_key, value FROM metrics")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.metrics_long(v.preds(spark, sf_dir).withColumn("n_bytes", F.floor("value") + 40))


# the multiclass predictions with a score, and the same rows with binarised labels
PREDS_NAMED = f"""{v.PREDS_MULTI}, named AS (
  SELECT p.*, CAST(floor(least(e.value, 100)) AS DOUBLE) / CAST(100 AS DOUBLE) AS score
  FROM preds_multi p JOIN events e ON p.row_id = e.event_id),
preds AS (SELECT run_id, row_id, CAST(y_true <> 'view' AS INTEGER) AS y_true, CAST(y_pred <> 'view' AS INTEGER) AS y_pred, score FROM named)"""

MULTI_LONG = f"""{PREDS_NAMED}, {COUNTS}, {CURVE}, {ISLANDS}, {CLASS_CELLS},
s AS (SELECT run_id, sum(tp) AS c, sum(tp + fn) AS s, sum((tp + fp) * (tp + fn)) AS pt,
      sum((tp + fp) * (tp + fp)) AS pp, sum((tp + fn) * (tp + fn)) AS tt FROM k GROUP BY run_id),
metrics AS (
  SELECT run_id, 'test_accuracy' AS metric_key, round(avg(CAST(y_true = y_pred AS INTEGER)), 5) AS value FROM named GROUP BY run_id
  UNION ALL SELECT run_id, 'test_precision_score_macro', round(avg({ratio('tp', 'tp + fp')}), 5) FROM k GROUP BY run_id
  UNION ALL SELECT run_id, 'test_recall_score_macro', round(avg({ratio('tp', 'tp + fn')}), 5) FROM k GROUP BY run_id
  UNION ALL SELECT run_id, 'test_f1_score_macro', round(avg({ratio('2 * tp', '2 * tp + fp + fn')}), 5) FROM k GROUP BY run_id
  UNION ALL SELECT run_id, 'test_matthews_correlation_coefficient',
    round(greatest(0, coalesce((c * s - pt) / nullif(sqrt(s * s - pp) * sqrt(s * s - tt), 0), 0)), 5) FROM s
  UNION ALL SELECT run_id, 'test_intrusion_detection_capability_binary', {IDC} FROM counts
  UNION ALL SELECT run_id, 'test_fp_per_million', round(fp / n * 1e6, 5) FROM counts
  UNION ALL SELECT run_id, 'test_roc_auc', {AUC} FROM curve GROUP BY run_id
  UNION ALL SELECT run_id, 'test_pr_auc', {AP} FROM curve GROUP BY run_id
  UNION ALL SELECT run_id, 'test_mttd_samples', mttd_samples FROM det
  UNION ALL SELECT run_id, 'test_attack_instances_total', attack_instances_total FROM det
  UNION ALL SELECT run_id, 'test_attack_instances_detected', attack_instances_detected FROM det
  UNION ALL SELECT run_id, 'test_attack_instances_undetected', attack_instances_undetected FROM det)"""


@query("metrics_long_multiclass", f"WITH {MULTI_LONG} SELECT run_id, metric_key, value FROM metrics")
def metrics_long_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = v.preds(spark, sf_dir).select("row_id", "score")
    return m.metrics_long(v.preds_multi(spark, sf_dir).join(scores, "row_id"), benign="view")


@query(
    "custom_metric",
    f"""WITH {v.PREDS} SELECT run_id, 'alarm_rate' AS metric_key, round(avg(y_pred), 5) AS value FROM preds GROUP BY run_id
UNION ALL SELECT run_id, 'brier', round(avg((score - y_true) * (score - y_true)), 5) FROM preds GROUP BY run_id""",
)
def custom_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User metrics plug in as functions predictions -> (run_id, metric_key, value)."""

    def alarm_rate(p: DataFrame) -> DataFrame:
        rate = F.round(F.avg("y_pred"), 5).alias("value")
        return p.groupBy("run_id").agg(rate).select("run_id", F.lit("alarm_rate").alias("metric_key"), "value")

    def brier(p: DataFrame) -> DataFrame:
        gap = F.col("score") - F.col("y_true")
        out = p.groupBy("run_id").agg(F.round(F.avg(gap * gap), 5).alias("value"))
        return out.select("run_id", F.lit("brier").alias("metric_key"), "value")

    return m.metrics_long(v.preds(spark, sf_dir), {"alarm_rate": alarm_rate, "brier": brier})
