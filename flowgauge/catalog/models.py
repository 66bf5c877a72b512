"""Detectors, anomaly scores, perturbations and flow assembly."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.catalog import views as v
from flowgauge.catalog.data import cdf_sql
from flowgauge.catalog.measures import fgsm_sql, margin_sql
from flowgauge.catalog.registry import query
from flowgauge.functions.scalars import fold_missing
from flowgauge.operators import detectors, flows, metrics, perturb, splits
from flowgauge.operators.fitted import fit_min_max
from flowgauge.operators.labeling import label_from_column, label_time_windows
from flowgauge.session import durable

# ---- detectors -----------------------------------------------------------


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = v.unit(spark, sf_dir).withColumn("target_label", (F.col("x1") + F.col("x3") > 0.8).cast("int"))
    # learners read their training rows many times
    s = durable(splits.split_stratified(u, "target_label", 0.3, 42))
    return s.where("split = 'train'"), s.where("split = 'test'")


def _detect(spark: SparkSession, sf_dir: str, detector) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    fitted = detector.fit(train, v.FEATURES, "target_label")
    scored = fitted.transform(test).withColumn("y_true", F.col("target_label"))
    return scored.select("row_id", "run_id", "y_true", "y_pred", F.round("score", 6).alias("score"))


@query("detect_decision_tree")
def detect_decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, detectors.detector("Decision_Tree", max_depth=6))


@query("detect_tree_stack")
def detect_tree_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = {"max_depth": 5, "forest_trees": 5, "boost_rounds": 3, "stack_rounds": 3}
    return _detect(spark, sf_dir, detectors.detector("tree_stack", **small))


@query("detect_mlp")
def detect_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, detectors.detector("feed_forward", layers=(16, 8), max_iter=30))


@query("detect_cluster_routed")
def detect_cluster_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detect(spark, sf_dir, detectors.detector("cluster_routed", clusters=4, forest_trees=5, layers=(8,)))


# rows and attacks of the test part, by the quotas of the stratified split
TEST_PART = f"""{v.UNIT}, c AS (SELECT CAST(x1 + x3 > 0.8 AS INTEGER) AS y, count(*) AS n FROM unit GROUP BY 1),
q AS (SELECT y, n, sum(n) OVER () AS total, CAST(ceil(CAST(0.3 AS DOUBLE) * sum(n) OVER ()) AS BIGINT) AS test FROM c),
f AS (SELECT *, n * test // total AS base, n * test % total AS rest FROM q),
part AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f)"""


@query(
    "detector_properties",
    f"""WITH {TEST_PART}, p AS (SELECT sum(quota) AS n, sum(quota) FILTER (WHERE y = 1) AS attacks FROM part)
SELECT detector, CAST(n AS BIGINT) AS n_rows, CAST(attacks AS BIGINT) AS n_attacks, TRUE AS beats_majority, TRUE AS scores_in_range
FROM p, (VALUES ('decision_tree'), ('tree_stack'), ('feed_forward'), ('cluster_routed'), ('surrogate')) t(detector)""",
)
def detector_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every learner: it scores each test row once, within [0, 1], and beats the larger class."""
    train, test = _train_test(spark, sf_dir)
    named = {
        "decision_tree": {"max_depth": 6},
        "tree_stack": {"max_depth": 5, "forest_trees": 5, "boost_rounds": 3, "stack_rounds": 3},
        "feed_forward": {"layers": (16, 8), "max_iter": 30},
        "cluster_routed": {"clusters": 4, "forest_trees": 5, "layers": (8,), "n_arms": 2},
    }
    parts = []
    for name, params in named.items():
        scored = detectors.detector(name, **params).fit(train, v.FEATURES, "target_label").transform(test)
        parts.append(scored.select(F.lit(name).alias("detector"), F.col("target_label").alias("y"), "y_pred", "score"))
    weights, bias = perturb.fit_surrogate(train, v.FEATURES)
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-perturb.linear_margin(weights, bias)))
    stand_in = test.withColumn("score", chance).withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))
    parts.append(stand_in.select(F.lit("surrogate").alias("detector"), F.col("target_label").alias("y"), "y_pred", "score"))
    right, attacks, n = F.avg((F.col("y") == F.col("y_pred")).cast("double")), F.sum("y"), F.count(F.lit(1))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("detector")
        .agg(
            n.alias("n_rows"),
            attacks.alias("n_attacks"),
            (right > F.greatest(attacks / n, F.lit(1.0) - attacks / n)).alias("beats_majority"),
            F.bool_and(F.col("score").between(0.0, 1.0)).alias("scores_in_range"),
        )
    )


@query("anomaly_pca")
def anomaly_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCA reconstruction error over the embedding values; label 0 plays the benign class."""
    e = v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    )
    det = detectors.AnomalyDetector(method="percentile", components=8, benign=0)
    fitted = det.fit(e, [f"e{i}" for i in range(64)], "label")
    return fitted.transform(e).select("row_id", "label", "y_pred", F.round("score", 6).alias("score"))


@query(
    "anomaly_pca_properties",
    """SELECT count(*) AS n_rows, count_if(label = 0) AS n_benign, TRUE AS scores_in_range, TRUE AS alarms_above, TRUE AS share_of_benign FROM embeddings""",
)
def anomaly_pca_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of reconstruction errors: every row is scored within [0, 1], alarms have the greater scores, and about
    a twentieth of the benign rows, which the threshold was taken from, raise one."""
    scored = anomaly_pca(spark, sf_dir)
    benign, alarm = F.col("label") == 0, F.col("y_pred") == 1
    share = F.count_if(benign & alarm) / F.count_if(benign)
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(benign).alias("n_benign"),
        F.bool_and(F.col("score").between(0.0, 1.0)).alias("scores_in_range"),
        (F.min(F.when(alarm, F.col("score"))) >= F.max(F.when(~alarm, F.col("score")))).alias("alarms_above"),
        (F.abs(share - 0.05) <= F.greatest(F.lit(0.01), F.lit(2.0) / F.count_if(benign))).alias("share_of_benign"),
    )


ANOMALY = f"""{v.FLOWS}, x AS (SELECT row_id, CASE WHEN label_raw IN ('view', 'click', 'signup') THEN 0 ELSE 1 END AS y,
  value, CAST(src AS DOUBLE) AS src, CAST(dst AS DOUBLE) AS dst FROM flows),
fit AS (SELECT avg(value) AS m1, stddev_pop(value) AS s1, avg(src) AS m2, stddev_pop(src) AS s2, avg(dst) AS m3,
  stddev_pop(dst) AS s3 FROM x WHERE y = 0),
r AS (SELECT row_id, y, sqrt((((value - m1) / s1) * ((value - m1) / s1) + ((src - m2) / s2) * ((src - m2) / s2)
  + ((dst - m3) / s3) * ((dst - m3) / s3)) / 3) AS rmse FROM x, fit),
d AS (SELECT avg(ln(rmse + CAST(1e-10 AS DOUBLE))) AS m, stddev_pop(ln(rmse + CAST(1e-10 AS DOUBLE))) AS s,
  quantile_cont(rmse, 0.95) AS q FROM r WHERE y = 0 AND rmse > 0)"""


def _anomaly(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    x = v.flows(spark, sf_dir).withColumn("y", F.when(F.col("label_raw").isin(*v.BENIGN), 0).otherwise(1))
    fitted = detectors.AnomalyDetector(method=method, sigma=1.5).fit(x, ["value", "src", "dst"], "y")
    scored = fitted.transform(x)
    return scored.select("row_id", "y", F.round("score", 6).alias("score"), "y_pred")


@query(
    "anomaly_zscore_sigma",
    f"""WITH {ANOMALY} SELECT row_id, y, round({cdf_sql('((ln(rmse) - m) / s)')}, 6) AS score,
  CASE WHEN rmse > exp(m + CAST(1.5 AS DOUBLE) * s) THEN 1 ELSE 0 END AS y_pred FROM r, d""",
)
def anomaly_zscore_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomaly(spark, sf_dir, "sigma")


@query(
    "anomaly_zscore_percentile",
    f"""WITH {ANOMALY} SELECT row_id, y, round({cdf_sql('((ln(rmse) - m) / s)')}, 6) AS score,
  CASE WHEN rmse > q THEN 1 ELSE 0 END AS y_pred FROM r, d""",
)
def anomaly_zscore_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomaly(spark, sf_dir, "percentile")


@query(
    "nearest_center",
    """WITH c AS (SELECT label AS k, i, avg(CAST(x AS DOUBLE)) AS c FROM
  (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
d AS (SELECT e.vec_id, c.k, sum((CAST(e.x AS DOUBLE) - c.c) * (CAST(e.x AS DOUBLE) - c.c)) AS d FROM e JOIN c ON e.i = c.i GROUP BY e.vec_id, c.k)
SELECT vec_id, CAST(arg_min(k, d) AS INTEGER) AS cluster FROM d GROUP BY vec_id""",
)
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres are the mean vectors of the ten labels."""
    e = v.table(spark, sf_dir, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("cs")).orderBy("label").collect()
    centers = [[p["c"] for p in r["cs"]] for r in rows]
    vector = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", detectors.nearest_center(vector, centers).alias("cluster"))


@query(
    "cluster_arm_rewards",
    f"""WITH {v.PREDS}, c AS (SELECT p.*, user_id % 5 AS cluster FROM preds p JOIN events ON event_id = row_id)
SELECT cluster, {', '.join(f"coalesce(round(avg(CAST(CAST(value >= {t} AS INTEGER) = y_true AS INTEGER)) FILTER (WHERE y_true = {a}), 6), 0) AS arm_{a}" for a, t in enumerate((20, 40, 60)))}
FROM c GROUP BY cluster""",
)
def cluster_arm_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.events(spark, sf_dir).select(
        (F.col("user_id") % 5).alias("cluster"), F.col("event_type").isin(*v.ATTACKS).cast("int").alias("y"), "value"
    )
    arms = [(F.col("value") >= t).cast("int") for t in (20, 40, 60)]
    got = detectors.cluster_arm_rewards(rows, "cluster", F.col("y"), arms)
    return got.select("cluster", *[F.round(f"arm_{a}", 6).alias(f"arm_{a}") for a in range(3)])


# ---- perturbations -------------------------------------------------------


def _shown(df: DataFrame, columns: list[str] = v.FEATURES) -> DataFrame:
    return df.select("row_id", *[(F.round(c, 6) + 0.0).alias(c) for c in columns])


def _noise_sql(std: float) -> list[str]:
    return [f"least(greatest({c} + CAST({std} AS DOUBLE) * {v.normal_sql('7', repr(c), 'row_id')}, 0), 1)" for c in v.FEATURES]


def _rounded_sql(expressions: list[str]) -> str:
    return ", ".join(f"round({e}, 6) + 0 AS {c}" for e, c in zip(expressions, v.FEATURES))


@query("attack_noise", f"WITH {v.UNIT} SELECT row_id, {_rounded_sql(_noise_sql(0.1))} FROM unit")
def attack_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = v.unit(spark, sf_dir)
    return _shown(perturb.perturb(u, perturb.noise(v.FEATURES, 0.1, seed=7), "noise"))


@query(
    "attack_junk_constant",
    f"WITH {v.UNIT} SELECT row_id, round(least(x1 + CAST(0.25 AS DOUBLE), 1), 6) AS x1, round(x2, 6) AS x2, round(least(x3 + CAST(0.25 AS DOUBLE), 1), 6) AS x3 FROM unit",
)
def attack_junk_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = v.unit(spark, sf_dir)
    return _shown(perturb.perturb(u, perturb.junk(u, ["x1", "x3", "x9"], amount=0.25, clip=(None, 1.0)), "junk"))


@query(
    "attack_junk_random",
    f"""WITH {v.UNIT} SELECT row_id, round(x1 + (CAST(0 AS DOUBLE) + CAST(1024 AS DOUBLE) * {v.uniform_sql('3', "'x1'", 'row_id')}), 6) AS x1,
  round(x2, 6) AS x2, round(x3 + (CAST(0 AS DOUBLE) + CAST(1024 AS DOUBLE) * {v.uniform_sql('3', "'x3'", 'row_id')}), 6) AS x3 FROM unit""",
)
def attack_junk_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = v.unit(spark, sf_dir)
    return _shown(perturb.perturb(u, perturb.junk(u, ["x1", "x3"], mode="random", seed=3), "junk"))


@query(
    "attack_junk_percentage",
    f"WITH {v.UNIT} SELECT row_id, round(x1 * CAST(1.1 AS DOUBLE), 6) AS x1, round(x2, 6) AS x2, round(x3 * CAST(1.1 AS DOUBLE), 6) AS x3 FROM unit",
)
def attack_junk_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = v.unit(spark, sf_dir)
    return _shown(perturb.perturb(u, perturb.junk(u, ["x1", "x3"], mode="percentage"), "junk"))


@query("attack_fgsm_linear", f"WITH {v.UNIT} SELECT row_id, {_rounded_sql(fgsm_sql('CAST(0.1 AS DOUBLE)'))} FROM unit")
def attack_fgsm_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = v.unit(spark, sf_dir)
    return _shown(perturb.perturb(u, perturb.fgsm_linear(v.WEIGHTS, v.BIAS, 0.1), "fgsm"))


#: Fixed weights of a network of three inputs, two hidden units and two classes.
NETWORK = [([[1.5, -2.0, 0.75], [-0.5, 1.25, 2.0]], [0.1, -0.6]), ([[0.9, -1.1], [-0.4, 1.3]], [0.05, -0.2])]


def _network_sql() -> str:
    """The same network written out: hidden units, class scores, and the gradient's sign by each input."""

    def total(weights: list[float], names: list[str], bias: float) -> str:
        return " + ".join([*[f"CAST({w} AS DOUBLE) * {n}" for w, n in zip(weights, names)], f"CAST({bias} AS DOUBLE)"])

    (w1, b1), (w2, b2) = NETWORK
    hidden = ", ".join(f"1 / (1 + exp(-({total(w, v.FEATURES, b)}))) AS h{k}" for k, (w, b) in enumerate(zip(w1, b1)))
    scores = ", ".join(f"{total(w, ['h0', 'h1'], b)} AS o{k}" for k, (w, b) in enumerate(zip(w2, b2)))
    slopes = ", ".join(
        " + ".join(f"CAST({(w2[1][k] - w2[0][k]) * w1[k][j]} AS DOUBLE) * h{k} * (1 - h{k})" for k in range(2)) + f" AS g{j}" for j in range(3)
    )
    moved = [f"least(greatest({c} + CAST(0.1 AS DOUBLE) * sign(g{j}) * CASE WHEN o0 >= o1 THEN 1 ELSE -1 END, 0), 1)" for j, c in enumerate(v.FEATURES)]
    return f"""WITH {v.UNIT}, h AS (SELECT *, {hidden} FROM unit), o AS (SELECT *, {scores}, {slopes} FROM h)
SELECT row_id, {_rounded_sql(moved)} FROM o"""


@query("attack_fgsm_network", _network_sql())
def attack_fgsm_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gradient step through a network's own layers."""
    network = perturb.Network(v.FEATURES, [(np.array(w), np.array(b)) for w, b in NETWORK])
    u = v.unit(spark, sf_dir)
    return _shown(perturb.perturb(u, perturb.fgsm_network(v.FEATURES, network, 0.1), "fgsm"))


@query("attack_fgsm_surrogate")
def attack_fgsm_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    weights, bias = perturb.fit_surrogate(train, v.FEATURES)
    return _shown(perturb.perturb(test, perturb.fgsm_linear(weights, bias, 0.1), "fgsm"))


@query(
    "attack_surrogate_properties",
    f"""WITH {TEST_PART} SELECT CAST(sum(quota) AS BIGINT) AS n_rows, TRUE AS steps_or_edges, TRUE AS margin_moves_to_zero FROM part""",
)
def attack_surrogate_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a gradient step: each feature moves by the step or to an edge, and no row gains margin for its own label."""
    train, test = _train_test(spark, sf_dir)
    weights, bias = perturb.fit_surrogate(train, v.FEATURES)
    cells = perturb.fgsm_linear(weights, bias, 0.1)
    own, moved = perturb.linear_margin(weights, bias), reduce(lambda a, b: a + b, [F.lit(w) * cells[c] for c, w in weights.items()], F.lit(bias))
    gap = [F.abs(cells[c] - F.col(c)) for c in v.FEATURES]
    edge = [(g - 0.1 < 1e-9) & ((F.abs(g - 0.1) < 1e-9) | cells[c].isin(0.0, 1.0)) for c, g in zip(v.FEATURES, gap)]
    side = F.when(own >= 0, 1.0).otherwise(-1.0)
    return test.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(reduce(lambda a, b: a & b, edge)).alias("steps_or_edges"),
        F.bool_and(side * moved <= side * own + 1e-9).alias("margin_moves_to_zero"),
    )


def _accuracy_sql(name: str, expressions: list[str]) -> str:
    hit = margin_sql(*[f"({e})" for e in expressions])
    return f"SELECT '{name}' AS attack, round(avg(CAST(target_label = CAST({hit} >= 0 AS INTEGER) AS INTEGER)), 5) AS accuracy FROM unit"


@query(
    "adversarial_accuracy",
    f"WITH {v.UNIT} "
    + " UNION ALL ".join(
        _accuracy_sql(n, e)
        for n, e in (
            ("clean", v.FEATURES),
            ("noise", _noise_sql(0.2)),
            ("junk", ["x1 + CAST(0.25 AS DOUBLE)", "x2", "x3"]),
            ("fgsm", fgsm_sql("CAST(0.1 AS DOUBLE)")),
        )
    ),
)
def adversarial_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attacks in one scan and one scoring job."""
    u = v.unit(spark, sf_dir)
    attacks = {
        "noise": perturb.noise(v.FEATURES, 0.2, seed=7),
        "junk": perturb.junk(u, ["x1"], amount=0.25),
        "fgsm": perturb.fgsm_linear(v.WEIGHTS, v.BIAS, 0.1),
    }
    copies = perturb.stack_attacks(u, v.FEATURES, attacks, clean="clean")
    hit = (perturb.linear_margin(v.WEIGHTS, v.BIAS) >= 0).cast("int")
    scored = copies.select("attack", F.col("target_label").alias("y_true"), hit.alias("y_pred"))
    return metrics.accuracy(scored, ["attack"])


# ---- flows from packets --------------------------------------------------

IDLE_MS, ACTIVE_MS = 6 * 3600 * 1000, 12 * 3600 * 1000

# packets marked with their flow, by full windows
MARKED = f"""{v.PACKETS},
k AS (SELECT *, least(src, dst) AS lo, greatest(src, dst) AS hi, src <= dst AS fwd FROM packets),
g AS (SELECT *, lag(ts_ms) OVER (PARTITION BY lo, hi ORDER BY ts_ms, pkt_id) AS prev FROM k),
s AS (SELECT *, CASE WHEN prev IS NULL OR ts_ms - prev > {IDLE_MS} THEN ts_ms END AS op FROM g),
t AS (SELECT *, max(op) OVER (PARTITION BY lo, hi ORDER BY ts_ms, pkt_id ROWS UNBOUNDED PRECEDING) AS start FROM s),
u AS (SELECT *, (ts_ms - start) // {ACTIVE_MS} AS cut FROM t),
m AS (SELECT *, ts_ms - lag(ts_ms) OVER w AS gap, first_value(src) OVER w AS first_src, first_value(dst) OVER w AS first_dst FROM u
      WINDOW w AS (PARTITION BY lo, hi, start, cut ORDER BY ts_ms, pkt_id ROWS UNBOUNDED PRECEDING)),
md AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY lo, hi, start, cut, fwd ORDER BY ts_ms, pkt_id) AS dgap FROM m)"""


def _stats_sql(value: str, cond: str, prefix: str, suffix: str) -> str:
    flt = f"FILTER (WHERE {cond})" if cond else ""
    return (
        f"min({value}) {flt} AS {prefix}_min_{suffix}, round(avg({value}) {flt}, 6) AS {prefix}_mean_{suffix}, "
        f"round(coalesce(stddev_samp({value}) {flt}, CASE WHEN count({value}) {flt} > 0 THEN 0 END), 6) AS {prefix}_stddev_{suffix}, "
        f"max({value}) {flt} AS {prefix}_max_{suffix}"
    )


def side_sql(prefix: str, cond: str, gap: str) -> str:
    flt = f"FILTER (WHERE {cond})" if cond else ""
    also = f" AND {cond}" if cond else ""
    return f"""min(ts_ms) {flt} AS {prefix}_first_seen_ms, max(ts_ms) {flt} AS {prefix}_last_seen_ms,
  max(ts_ms) {flt} - min(ts_ms) {flt} AS {prefix}_duration_ms, count(*) {flt} AS {prefix}_packets,
  CAST(coalesce(sum(size) {flt}, 0) AS BIGINT) AS {prefix}_bytes, {_stats_sql('size', cond, prefix, 'ps')}, {_stats_sql(gap, cond, prefix, 'piat_ms')},
  count(*) FILTER (WHERE syn{also}) AS {prefix}_syn_packets, count(*) FILTER (WHERE fin{also}) AS {prefix}_fin_packets"""


@query(
    "assemble_flows",
    f"""WITH {MARKED}
SELECT min(pkt_id) AS flow_id, first_src AS src, first_dst AS dst, {side_sql('bidirectional', '', 'gap')},
  {side_sql('src2dst', 'src = first_src', 'dgap')}, {side_sql('dst2src', 'src <> first_src', 'dgap')}
FROM md GROUP BY lo, hi, start, cut, first_src, first_dst""",
)
def assemble_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = flows.assemble_flows(
        v.packets(spark, sf_dir), ["src"], ["dst"], flags=["syn", "fin"], idle_ms=IDLE_MS, active_ms=ACTIVE_MS
    )
    return got.select(*[F.round(c, 6).alias(c) if "_mean_" in c or "_stddev_" in c else F.col(c) for c in got.columns])


# ---- the whole way -------------------------------------------------------


@query(
    "flagship",
    f"""WITH {v.FLOWS},
labelled AS (SELECT row_id, CAST(src AS DOUBLE) AS src, CAST(dst AS DOUBLE) AS dst, CASE WHEN row_id % 17 = 0 THEN NULL ELSE value END AS value,
  {v.WINDOW_LABEL} AS period, label_raw AS attack_category, CASE WHEN label_raw IN ('view', 'click', 'signup') THEN 0 ELSE 1 END AS target_label FROM flows),
cleaned AS (SELECT * FROM labelled WHERE value IS NOT NULL),
lims AS (SELECT min(src) AS a1, max(src) AS b1, min(dst) AS a2, max(dst) AS b2, min(value) AS a3, max(value) AS b3 FROM cleaned),
scaled AS (SELECT row_id, period, target_label, (src - a1) / (b1 - a1) AS src, (dst - a2) / (b2 - a2) AS dst, (value - a3) / (b3 - a3) AS value FROM cleaned, lims),
base AS (SELECT 'all' AS dataset, row_id, target_label AS y FROM scaled),
counted AS (SELECT dataset, y, n, n_all, CAST(ceil(0.3 * CAST(n_all AS DOUBLE)) AS BIGINT) AS n_test FROM (
  SELECT dataset, y, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_all FROM base GROUP BY dataset, y)),
shares AS (SELECT *, (n * n_test) // n_all AS whole, (n * n_test) % n_all AS rest FROM counted),
quotas AS (SELECT y, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= n_test - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {v.h52('42', 'row_id')}, row_id) AS r FROM base),
preds AS (SELECT 'linear|' || s.period AS run_id, s.target_label AS y_true,
    round(1 / (1 + exp(-(CAST(3 AS DOUBLE) * s.value - CAST(0.4 AS DOUBLE) * s.src + CAST(0.2 AS DOUBLE) * s.dst - CAST(0.5 AS DOUBLE)))), 6) AS score
  FROM ranked k JOIN quotas q ON k.y = q.y JOIN scaled s ON s.row_id = k.row_id WHERE k.r <= q.quota),
p AS (SELECT run_id, y_true, score, CAST(score >= CAST(0.5 AS DOUBLE) AS INTEGER) AS y_pred FROM preds),
counts AS (SELECT run_id, count(*) AS n, CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp FROM p GROUP BY run_id),
points AS (SELECT run_id, score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM p GROUP BY run_id, score),
curve AS (SELECT run_id, pos, neg, CAST(sum(pos) OVER w AS DOUBLE) AS cp, CAST(sum(pos) OVER (PARTITION BY run_id) AS DOUBLE) AS tp,
  CAST(sum(neg) OVER (PARTITION BY run_id) AS DOUBLE) AS tn FROM points WINDOW w AS (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
auc AS (SELECT run_id, round(sum((cp - pos / CAST(2 AS DOUBLE)) * neg) / nullif(any_value(tp) * any_value(tn), 0), 5) AS roc_auc FROM curve GROUP BY run_id)
SELECT c.run_id, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, c.n,
  round((tp + tn) / n, 5) AS accuracy, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 5) AS f1_score, roc_auc
FROM counts c JOIN auc USING (run_id)""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label by column and time window, clean, scale, split, score with fixed weights, measure the test rows."""
    f = v.flows(spark, sf_dir).withColumn("value", F.when(F.col("row_id") % 17 != 0, F.col("value")))
    f = label_time_windows(f, v.WINDOWS, "ts", "src", "dst", out="period")
    f = label_from_column(f, "label_raw", v.BENIGN, drop=True)
    kept = fold_missing(f).where("value is not null")
    scaled = fit_min_max(kept, ["src", "dst", "value"]).transform(kept)
    test = splits.split_stratified(scaled, "target_label", 0.3, 42).where("split = 'test'")
    margin = 3.0 * F.col("value") - 0.4 * F.col("src") + 0.2 * F.col("dst") - 0.5
    preds = test.select(
        F.concat(F.lit("linear|"), "period").alias("run_id"),
        F.col("target_label").alias("y_true"),
        F.round(1.0 / (1.0 + F.exp(-margin)), 6).alias("score"),
    ).withColumn("y_pred", (F.col("score") >= 0.5).cast("int"))
    # predictions are a stored table that all metrics read
    preds = durable(preds)
    counts = metrics.count_metrics(preds).select("run_id", "tn", "fp", "fn", "tp", "n", "accuracy", "f1_score")
    auc = metrics.ranking_metrics(metrics.score_curve(preds)).select("run_id", "roc_auc")
    return counts.join(auc, "run_id")



