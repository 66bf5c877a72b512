"""Detection metrics of many runs in a few grouped jobs.

Everything that follows from counts or from the ranking of scores can be read from
one cube of the predictions: a row per (run, true class, predicted class, score)
with its number of rows. Time to detect has its own order and its own pass.
Operators take predictions or a cube; a cube has a column ``__rows``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.functions.scalars import BENIGN_NAME, attack_flag, safe_ratio
from flowgauge.operators.prefix import running_sums, with_range_bucket
from flowgauge.session import durable

RUN = "run_id"

# rows that a row of a cube stands for, and the bytes of all of them
ROWS, BYTES = "__rows", "__bytes"

# ---- counts --------------------------------------------------------------


def count_cube(preds: DataFrame, bytes_column: str = "n_bytes") -> DataFrame:
    """Rows and bytes per (run, true class, predicted class, score); combined before the shuffle, stored once."""
    keys = [RUN, "y_true", "y_pred", *(["score"] if "score" in preds.columns else [])]
    sizes = [F.sum(F.col(bytes_column).cast("double")).alias(BYTES)] if bytes_column in preds.columns else []
    return durable(preds.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS), *sizes))


def count_of(preds: DataFrame, cond: Column | None = None) -> Column:
    """Number of rows, or of those that meet a condition, over predictions or a cube."""
    if ROWS not in preds.columns:
        return F.count(F.lit(1)) if cond is None else F.count_if(cond)
    if cond is None:
        return F.coalesce(F.sum(ROWS), F.lit(0))
    return F.coalesce(F.sum(F.when(cond, F.col(ROWS))), F.lit(0))


def flags(preds: DataFrame, benign: str = BENIGN_NAME) -> tuple[Column, Column]:
    """Whether a row is an attack, and whether it raised an alarm; labels are numbers or class names."""
    t, p = (attack_flag(F.col(c), preds.schema[c].dataType, benign) for c in ("y_true", "y_pred"))
    return t, p


def is_multiclass(preds: DataFrame) -> bool:
    return isinstance(preds.schema["y_true"].dataType, T.StringType)


def binary_counts(preds: DataFrame, keys: list[str] | None = None, benign: str = BENIGN_NAME) -> DataFrame:
    """tn, fp, fn, tp and n per run; a missing cell is 0."""
    t, p = flags(preds, benign)
    return preds.groupBy(*(keys or [RUN])).agg(
        count_of(preds, ~t & ~p).alias("tn"),
        count_of(preds, ~t & p).alias("fp"),
        count_of(preds, t & ~p).alias("fn"),
        count_of(preds, t & p).alias("tp"),
        count_of(preds).alias("n"),
    )


def accuracy(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    hit = F.col("y_true") == F.col("y_pred")
    share = F.try_divide(count_of(preds, hit).cast("double"), count_of(preds, hit.isNotNull()).cast("double"))
    return preds.groupBy(*(keys or [RUN])).agg(F.round(share, 5).alias("accuracy"))


def confusion(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of every (true, predicted) class pair of a run, zero where none."""
    keys = keys or [RUN]
    pairs = preds.groupBy(*keys, "y_true", "y_pred").agg(count_of(preds).alias("n"))
    # the class list of a run is built from the pair counts, not from rows
    sides = pairs.select(*keys, F.explode(F.array("y_true", "y_pred")).alias("c"))
    classes = sides.groupBy(*keys).agg(F.array_sort(F.collect_set("c")).alias("cs"))
    grid = classes.select(*keys, F.explode("cs").alias("y_true"), "cs").select(
        *keys, "y_true", F.explode("cs").alias("y_pred")
    )
    full = grid.join(pairs, [*keys, "y_true", "y_pred"], "left")
    return full.select(*keys, "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_normalized(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of each true class (5 decimals); a class with no rows gives 0."""
    keys = keys or [RUN]
    row_total = F.sum("n").over(Window.partitionBy(*keys, "y_true"))
    share = F.coalesce(safe_ratio(F.col("n"), row_total), F.lit(0.0))
    return confusion(preds, keys).select(*keys, "y_true", "y_pred", F.round(share, 5).alias("share"))


def _or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(safe_ratio(num, den), F.lit(0.0))


def precision_of(tp: Column, fp: Column) -> Column:
    return _or_zero(tp, tp + fp)


def recall_of(tp: Column, fn: Column) -> Column:
    return _or_zero(tp, tp + fn)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return _or_zero(tp * 2, tp * 2 + fp + fn)


def mcc_of(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Matthews correlation; negative values count as 0."""
    a, b, c, d = (x.cast("double") for x in (tp + fp, tp + fn, tn + fp, tn + fn))
    top = tp.cast("double") * tn.cast("double") - fp.cast("double") * fn.cast("double")
    root = F.sqrt(a) * F.sqrt(b) * F.sqrt(c) * F.sqrt(d)
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(top, root), F.lit(0.0)))


def entropy_of(p: Column) -> Column:
    """Binary entropy in bits, 0 at both ends."""
    inner = (p > 0) & (p < 1)
    q = F.lit(1.0) - p
    return F.when(inner, -(p * F.log2(F.when(inner, p)) + q * F.log2(F.when(inner, q)))).otherwise(0.0)


def capability_of(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Share of the label's entropy that the alarms explain."""
    n = tn + fp + fn + tp
    base = entropy_of(_or_zero(tp + fn, n))
    left = _or_zero(tp + fp, n) * entropy_of(_or_zero(tp, tp + fp)) + _or_zero(tn + fn, n) * entropy_of(
        _or_zero(tn, tn + fn)
    )
    return F.when(base == 0, 0.0).otherwise(F.try_divide(base - left, base))


def count_metrics(preds: DataFrame, keys: list[str] | None = None, benign: str = BENIGN_NAME) -> DataFrame:
    """All binary count-based metrics of every run from one aggregate."""
    keys = keys or [RUN]
    tn, fp, fn, tp, n = (F.col(c) for c in ("tn", "fp", "fn", "tp", "n"))
    return binary_counts(preds, keys, benign).select(
        *keys,
        "tn",
        "fp",
        "fn",
        "tp",
        "n",
        F.round(_or_zero(tp + tn, n), 5).alias("accuracy"),
        F.round(precision_of(tp, fp), 5).alias("precision_score"),
        F.round(recall_of(tp, fn), 5).alias("recall_score"),
        F.round(f1_of(tp, fp, fn), 5).alias("f1_score"),
        F.round(mcc_of(tn, fp, fn, tp), 5).alias("matthews_correlation_coefficient"),
        F.round(capability_of(tn, fp, fn, tp), 5).alias("intrusion_detection_capability"),
        F.round(safe_ratio(fp, n) * 1e6, 5).alias("fp_per_million"),
    )


def class_counts(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn per class of a run, over the union of true and predicted classes."""
    keys = keys or [RUN]
    pairs = preds.groupBy(*keys, "y_true", "y_pred").agg(count_of(preds).alias("n"))
    hit = F.col("y_true") == F.col("y_pred")
    sides = pairs.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("y_true").alias("class"),
                    F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                    F.lit(0).cast("bigint").alias("fp"),
                    F.when(hit, 0).otherwise(F.col("n")).alias("fn"),
                ),
                F.struct(
                    F.col("y_pred").alias("class"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
                    F.lit(0).cast("bigint").alias("fn"),
                ),
            )
        ),
    )
    return sides.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def macro_metrics(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Unweighted class means of precision, recall and F1."""
    keys = keys or [RUN]
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return class_counts(preds, keys).groupBy(*keys).agg(
        F.round(F.avg(precision_of(tp, fp)), 5).alias("precision_score_macro"),
        F.round(F.avg(recall_of(tp, fn)), 5).alias("recall_score_macro"),
        F.round(F.avg(f1_of(tp, fp, fn)), 5).alias("f1_score_macro"),
    )


def mcc_multiclass(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Multiclass Matthews correlation, negative values as 0; DOUBLE arithmetic throughout."""
    keys = keys or [RUN]
    per = class_counts(preds, keys).select(
        *keys,
        F.col("tp").cast("double").alias("c"),
        (F.col("tp") + F.col("fn")).cast("double").alias("t"),
        (F.col("tp") + F.col("fp")).cast("double").alias("p"),
    )
    s = per.groupBy(*keys).agg(
        F.sum("c").alias("c"),
        F.sum("t").alias("s"),
        F.sum(F.col("p") * F.col("t")).alias("pt"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"),
    )
    ss = F.col("s") * F.col("s")
    root = F.sqrt(ss - F.col("pp")) * F.sqrt(ss - F.col("tt"))
    value = F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("pt"), root), F.lit(0.0))
    return s.select(*keys, F.round(F.greatest(F.lit(0.0), value), 5).alias("matthews_correlation_coefficient"))


def fp_per_volume(
    preds: DataFrame, bytes_column: str, keys: list[str] | None = None, benign: str = BENIGN_NAME
) -> DataFrame:
    """False positives per GB (1024^3 bytes) of a given byte volume; NULL when the volume is 0."""
    t, p = flags(preds, benign)
    fp = count_of(preds, ~t & p)
    gb = F.sum(F.col(bytes_column).cast("double")) / float(1024**3)
    return preds.groupBy(*(keys or [RUN])).agg(F.round(F.try_divide(fp.cast("double"), gb), 5).alias("fppv"))


# ---- rankings ------------------------------------------------------------


def score_curve(
    preds: DataFrame, keys: list[str] | None = None, buckets: int | None = None, benign: str = BENIGN_NAME
) -> DataFrame:
    """Running positives and negatives per distinct score, from the highest down.

    Equal scores are merged before the shuffle, so one score shared by a third
    of all rows is one row per map task. The merged scores are stored once; the
    buckets of the running sums are counted on them.
    """
    keys = keys or [RUN]
    attack, _ = flags(preds, benign)
    merged = durable(
        preds.where("score is not null")
        .groupBy(*keys, "score")
        .agg(count_of(preds, attack).alias("pos"), count_of(preds, ~attack).alias("neg"))
    )
    return running_sums(merged, keys, "score", ["pos", "neg"], descending=True, buckets=buckets)


def roc_points(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return curve.select(
        *(keys or [RUN]),
        F.col("score").alias("threshold"),
        F.round(safe_ratio(F.col("cum_neg"), F.col("total_neg")), 6).alias("fpr"),
        F.round(safe_ratio(F.col("cum_pos"), F.col("total_pos")), 6).alias("tpr"),
    )


def pr_points(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Recall, precision per threshold and the share of positives as the baseline."""
    return curve.select(
        *(keys or [RUN]),
        F.col("score").alias("threshold"),
        F.round(safe_ratio(F.col("cum_pos"), F.col("total_pos")), 6).alias("recall"),
        F.round(safe_ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")), 6).alias("precision"),
        F.round(safe_ratio(F.col("total_pos"), F.col("total_pos") + F.col("total_neg")), 6).alias("baseline"),
    )


def ranking_metrics(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve (ties by trapezoid) and average precision (no interpolation)."""
    pos, neg, up, upn = F.col("pos"), F.col("neg"), F.col("cum_pos"), F.col("cum_neg")
    both = F.first("total_pos").cast("double") * F.first("total_neg").cast("double")
    area = F.try_divide(F.sum((up - pos / 2.0) * neg), both)
    ap = F.sum(pos * safe_ratio(up, up + upn))
    recall_base = F.first("total_pos").cast("double")
    return curve.groupBy(*(keys or [RUN])).agg(
        F.round(area, 5).alias("roc_auc"),
        F.round(F.coalesce(F.try_divide(ap, recall_base), F.lit(0.0)), 5).alias("pr_auc"),
    )


# ---- time to detect ------------------------------------------------------


def segment_summaries(
    preds: DataFrame,
    order: str = "row_id",
    keys: list[str] | None = None,
    buckets: int | None = None,
    benign: str = BENIGN_NAME,
) -> DataFrame:
    """One row per (run, range bucket) that its neighbours can be combined with.

    Attack rows between two benign ones are an instance. A bucket tells of the
    instances inside it their number, how many are detected and their summed delay;
    of the attack rows before its first and after its last benign row, which may go
    on beside it, their number and the rows before the first hit. ``benign`` is
    whether it has a benign row at all. Rows are sorted once.
    """
    keys = keys or [RUN]
    t, p = (F.coalesce(f, F.lit(False)) for f in flags(preds, benign))
    rows = with_range_bucket(preds.select(*keys, order, t.alias("__t"), p.alias("__p")), order, buckets)
    part = [*keys, "bucket"]
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    calm, one = (~F.col("__t")).cast("bigint"), F.col("__t").cast("bigint")
    placed = rows.select(
        *part, "__t", "__p", F.sum(calm).over(upto).alias("__k"), F.sum(one).over(upto).alias("__at"), F.sum(calm).over(Window.partitionBy(*part)).alias("__last")
    )
    # the last benign row stays, so that every bucket that has one tells of its end
    pieces = (
        placed.where("__t or __k = __last")
        .groupBy(*part, "__k", "__last")
        .agg(F.count_if("__t").alias("__n"), (F.min(F.when(F.col("__t") & F.col("__p"), F.col("__at"))) - F.min(F.when(F.col("__t"), F.col("__at")))).alias("__f"))
    )
    k, n, f = F.col("__k"), F.col("__n"), F.col("__f")
    lead, tail = k == 0, (k == F.col("__last")) & (k > 0)
    inner = ~lead & ~tail
    return pieces.groupBy(*part).agg(
        F.max(k > 0).alias("benign"),
        F.coalesce(F.max(F.when(lead, n)), F.lit(0)).alias("lead_rows"),
        F.max(F.when(lead, f)).alias("lead_delay"),
        F.coalesce(F.max(F.when(tail, n)), F.lit(0)).alias("tail_rows"),
        F.max(F.when(tail, f)).alias("tail_delay"),
        F.count_if(inner).alias("instances"),
        F.count(F.when(inner, f)).alias("detected"),
        F.coalesce(F.sum(F.when(inner, f)), F.lit(0)).alias("delays"),
    )


def time_to_detect(
    preds: DataFrame,
    order: str = "row_id",
    keys: list[str] | None = None,
    buckets: int | None = None,
    benign: str = BENIGN_NAME,
) -> DataFrame:
    """Mean rows until the first hit of detected instances, and instance counts; infinite if none is detected.

    Summaries of neighbouring buckets are put together in one scan of them: the end
    of a bucket and the start of the next are one instance, over any number of
    buckets without a benign row.
    """
    keys = keys or [RUN]
    found = segment_summaries(preds, order, keys, buckets, benign)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.lit(0).alias("__side"), F.col("lead_rows").alias("__n"), F.col("lead_delay").alias("__f"), F.col("instances"), F.col("detected"), F.col("delays")
        ),
        F.struct(
            F.lit(1).alias("__side"), F.col("tail_rows").alias("__n"), F.col("tail_delay").alias("__f"), none.alias("instances"), none.alias("detected"), none.alias("delays")
        ),
    )
    ends = found.select(*keys, "bucket", "benign", F.inline(sides)).where("benign or __side = 0")
    along = Window.partitionBy(*keys).orderBy("bucket", "__side")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows the last benign row of a bucket starts a new instance; anything else goes on
    chained = ends.select(
        "*", F.sum("__side").over(upto).alias("__head"), (F.sum("__n").over(upto) - F.col("__n")).alias("__before")
    )
    joined = chained.groupBy(*keys, "__head").agg(
        F.sum("__n").alias("__n"),
        (F.min(F.when(F.col("__f").isNotNull(), F.col("__before") + F.col("__f"))) - F.min("__before")).alias("__f"),
        *[F.sum(c).alias(c) for c in ("instances", "detected", "delays")],
    )
    total = F.sum("instances") + F.count_if(F.col("__n") > 0)
    detected = F.sum("detected") + F.count("__f")
    mean = F.try_divide((F.sum("delays") + F.coalesce(F.sum("__f"), none)).cast("double"), detected.cast("double"))
    return joined.groupBy(*keys).agg(
        F.round(F.coalesce(mean, F.lit(float("inf"))), 5).alias("mttd_samples"),
        total.alias("attack_instances_total"),
        detected.alias("attack_instances_detected"),
        (total - detected).alias("attack_instances_undetected"),
    )


# ---- cost ----------------------------------------------------------------


def time_per_sample(times: DataFrame, runtime: Column, n: Column) -> DataFrame:
    """Milliseconds per row and rows per second; NULL if time or rows are 0 or absent."""
    ok = (runtime > 0) & (n > 0)
    return times.select(
        RUN,
        F.when(ok, F.round(F.try_divide(runtime, n.cast("double")) * 1000.0, 6)).alias("time_per_sample_ms"),
        F.when(ok, F.round(F.try_divide(n.cast("double"), runtime), 5)).alias("throughput_samples_per_s"),
    )


def retrain_cost(costs: DataFrame, seconds: Column, cpu: Column, memory_mb: Column) -> DataFrame:
    """1.0 * training seconds + 1e-6 * CPU percent * peak MB, missing parts as 0."""
    time_cost = F.lit(1.0) * F.coalesce(seconds, F.lit(0.0))
    resource = F.lit(1e-6) * (F.coalesce(cpu, F.lit(0.0)) * F.coalesce(memory_mb, F.lit(0.0)))
    return costs.select(
        RUN,
        F.round(time_cost + resource, 5).alias("model_retrain_cost"),
        F.round(time_cost, 5).alias("model_retrain_time_cost"),
        F.round(resource, 5).alias("model_retrain_resource_cost"),
    )


def resource_summary(samples: DataFrame, keys: list[str], cpu: str, ram: str) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.round(F.avg(cpu), 3).alias("avg_cpu_percent"),
        F.round(F.max(cpu), 5).alias("max_cpu_percent"),
        F.round(F.min(cpu), 5).alias("min_cpu_percent"),
        F.count(cpu).alias("cpu_sample_count"),
        F.round(F.avg(ram), 5).alias("avg_ram_mb"),
        F.round(F.max(ram), 5).alias("max_ram_mb"),
        F.round(F.min(ram), 5).alias("min_ram_mb"),
        F.count(ram).alias("ram_sample_count"),
    )


# ---- robustness ----------------------------------------------------------


def robustness_index(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under accuracy over epsilon, divided by the span; the first accuracy if there is no span."""
    keys = keys or [RUN]
    w = Window.partitionBy(*keys).orderBy("epsilon")
    step = (F.col("accuracy") + F.lag("accuracy").over(w)) / 2 * (F.col("epsilon") - F.lag("epsilon").over(w))
    pieces = curve.select(*keys, "epsilon", "accuracy", step.alias("area"))
    span = F.max("epsilon") - F.min("epsilon")
    value = F.coalesce(F.try_divide(F.sum("area"), F.nullif(span, F.lit(0.0))), F.min_by("accuracy", "epsilon"))
    return pieces.groupBy(*keys).agg(F.round(value, 5).alias("robustness_index"))


# ---- all metrics ---------------------------------------------------------

Metric = Callable[[DataFrame], DataFrame]


def to_long(wide: DataFrame, keys: list[str] | None = None, prefix: str = "test_") -> DataFrame:
    """(run, metric_key, value) rows; absent values give no row."""
    keys = keys or [RUN]
    cells = F.array(
        *[
            F.struct(F.lit(f"{prefix}{c}").alias("metric_key"), F.col(c).cast("double").alias("value"))
            for c in wide.columns
            if c not in keys
        ]
    )
    return wide.select(*keys, F.inline(cells)).where("value is not null")


def count_family(preds: DataFrame, benign: str = BENIGN_NAME) -> DataFrame:
    """Metrics that follow from counts. Class names give macro means, the multiclass correlation and,
    of the binarised labels, capability and false positives."""
    wide = count_metrics(preds, benign=benign)
    if not is_multiclass(preds):
        named = wide.withColumnsRenamed({c: f"confusion_matrix_{c}" for c in ("tn", "fp", "fn", "tp")})
        return to_long(named.drop("n"))
    binary = wide.select(
        RUN, F.col("intrusion_detection_capability").alias("intrusion_detection_capability_binary"), "fp_per_million"
    )
    parts = [accuracy(preds), macro_metrics(preds), mcc_multiclass(preds), binary]
    return reduce(DataFrame.unionByName, map(to_long, parts))


def volume_family(preds: DataFrame, benign: str = BENIGN_NAME) -> DataFrame:
    """False positives per GB, where the predictions carry the size of each row as ``n_bytes``."""
    return to_long(fp_per_volume(preds, BYTES if BYTES in preds.columns else "n_bytes", benign=benign))


def built_in(preds: DataFrame, benign: str = BENIGN_NAME) -> dict[str, Metric]:
    """The metric families that the columns of the predictions allow; all but time to detect also read a cube."""
    out: dict[str, Metric] = {"counts": lambda p: count_family(p, benign)}
    if "n_bytes" in preds.columns:
        out["volume"] = lambda p: volume_family(p, benign)
    if "score" in preds.columns:
        out["ranking"] = lambda p: to_long(ranking_metrics(score_curve(p, benign=benign)))
    out["time_to_detect"] = lambda p: to_long(time_to_detect(p, benign=benign))
    return out


def metrics_long(
    preds: DataFrame,
    metrics: dict[str, Metric] | None = None,
    benign: str = BENIGN_NAME,
    names: list[str] | None = None,
) -> DataFrame:
    """Every metric of every run; user metrics are functions predictions -> (run_id, metric_key, value).

    The built-in families read one stored cube of the predictions, time to detect
    the predictions themselves. ``names`` keeps only these metrics, named with or
    without the ``test_`` prefix. Class names among which ``benign`` never occurs
    are refused.
    """
    if metrics is None:
        cube = count_cube(preds)
        if is_multiclass(preds):
            seen = F.lower("y_true") == F.lit(benign.lower())
            row = cube.agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("k")).first()
            if row["n"] and not row["k"]:
                raise ValueError(f"no row has the benign class {benign!r}")
        parts = [m(preds if name == "time_to_detect" else cube) for name, m in built_in(preds, benign).items()]
    else:
        parts = [m(preds) for m in metrics.values()]
    out = reduce(DataFrame.unionByName, parts)
    if names is None:
        return out
    return out.where(F.col("metric_key").isin(*names, *[f"test_{n}" for n in names]))
