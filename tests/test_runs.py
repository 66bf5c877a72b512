"""Inputs, whole runs, stores and reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.catalog import views
from flowgauge.operators import collect, detectors, metrics, perturb, report, runs
from flowgauge.operators.fitted import FittedChain, Step, fit_chain
from flowgauge.plans.dataset import SplitPlan, dataset_report, prepare, preprocess, split
from flowgauge.plans.evaluation import Attack, Evaluation, results_of, runtime_results
from flowgauge.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_load_dataset(spark, tmp_path):
    (tmp_path / "day1").mkdir()
    (tmp_path / "day1" / "a.csv").write_text(" Flow Dur , Label \n1, BENIGN \nNaN,DoS\nInfinity,DoS\n")
    (tmp_path / "day1" / "b.csv").write_text("Flow Dur,Label,Extra.Col\n2.5,BENIGN,x\n,PortScan,y\n")
    (tmp_path / "day1" / "notes.txt").write_text("skip me")
    (tmp_path / "flood.csv").write_text("Flow Dur\n7\n8\n")
    subs = [
        readers.SubFile(str(tmp_path / "day1"), label_column="Label", benign=("BENIGN",), label_mapping={"DoS": "dos"}),
        readers.SubFile(str(tmp_path / "flood.csv"), attack_type="flood"),
        readers.SubFile(str(tmp_path / "missing.csv"), attack_type="x"),
    ]
    df = readers.load_dataset(spark, subs)
    got = {(r["Flow Dur"], r["attack_category"], r["target_label"], r["Extra.Col"]) for r in df.collect()}
    assert got == {
        (1.0, "BENIGN", 0, None),
        (None, "dos", 1, None),
        (float("inf"), "dos", 1, None),
        (2.5, "BENIGN", 0, "x"),
        (None, "PortScan", 1, "y"),
        (7.0, "flood", 1, None),
        (8.0, "flood", 1, None),
    }
    named = readers.load_dataset(spark, subs, {"Flow Dur": "duration"})
    assert named.columns == ["duration", "attack_category", "target_label"]
    with pytest.raises(readers.NoDataLoaded):
        readers.load_dataset(spark, [readers.SubFile(str(tmp_path / "nope"))])


def test_row_ids_are_stable(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(5).write.parquet(path)
    one = {r["id"]: r["row_id"] for r in readers.row_ids(spark.read.parquet(path)).collect()}
    two = {r["id"]: r["row_id"] for r in readers.row_ids(spark.read.parquet(path)).repartition(3).collect()}
    assert one == two and len(set(one.values())) == 1000


def test_chain_round_trip(spark, tmp_path):
    d = views.dirty(spark, SF)
    steps = [Step("cast_numeric", ("txt",)), Step("impute_median", ("value",)), Step("one_hot", ("cat",)), Step("standard", ("txt",)), Step("none")]
    chain = fit_chain(d, steps)
    chain.save(spark, str(tmp_path / "chain"))
    again = FittedChain.load(spark, str(tmp_path / "chain"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(chain.transform(d)) == key(again.transform(d))
    with pytest.raises(ValueError):
        fit_chain(d, [Step("remove_single_value_rows")])


def test_fit_on_training_rows_only(spark):
    d = spark.createDataFrame([(1, 0.0, "train"), (2, 10.0, "train"), (3, 20.0, "test")], "row_id bigint, v double, split string")
    chain = fit_chain(d, [Step("min_max", ("v",))], fit_on=F.col("split") == "train")
    assert sorted(r["v"] for r in chain.transform(d).collect()) == [0.0, 1.0, 2.0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    u = views.unit(spark, SF)
    rows = u.withColumn("target_label", (F.col("x1") + F.col("x3") > 0.8).cast("int")).withColumn(
        "attack_category", F.when(F.col("target_label") == 1, "attack").otherwise("benign")
    )
    tables = {f"D{i}": rows.where(F.col("run_id") == f"m{i}").drop("run_id") for i in range(2)}
    steps = {n: [Step("remove_nan_rows"), Step("min_max", ("x1", "x2", "x3")), Step("remove_duplicate_rows")] for n in tables}
    path, prepared = prepare(spark, tables, steps, SplitPlan("cross_dataset"), root, "cafe0000")
    return root, path, prepared


def test_prepare_and_report(spark, stored):
    root, _, prepared = stored
    table = sinks.read_splits(spark, root, "cafe0000")
    plan = sinks.test_rows(table.where("dataset = 'D0'"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    rep = dataset_report(table, "target_label")
    meta = {(r["dataset"], r["split"]): r["n_rows"] for r in rep["metadata"].collect()}
    assert sum(meta.values()) == table.count()
    log = prepared["D0"].step_table("r").orderBy("ord").collect()
    assert [r["action"] for r in log] == ["remove_nan_rows", "min_max", "remove_duplicate_rows"]
    assert int(log[0]["detail"]["rows_after"]) > 0


def test_evaluation_end_to_end(spark, stored):
    root, _, _ = stored
    table = sinks.read_splits(spark, root, "cafe0000")
    attacks = [Attack("noise", "noise", {"std": 0.2, "seed": 1}), Attack("junk", "junk", {"amount": 0.5}), Attack("fgsm", "gradient", {"eps": 0.2})]
    ev = Evaluation(
        spark, table, ["x1", "x2", "x3"], "target_label", {"tree": detectors.decision_tree(5)}, root, "cafe0000",
        cross=True, attacks=attacks, epsilons=[0.05, 0.3],
    )
    preds = ev.run()
    n_test = sinks.test_rows(table).count()
    assert preds.count() == 2 * n_test * 4
    res = results_of(preds)
    drops = report.performance_drop(res).where("metric_key = 'test_accuracy'").collect()
    assert len(drops) == 2 * 2 * 3
    clean = res.where("attack is null and metric_key = 'test_accuracy'").collect()
    assert all(r["value"] > 0.8 for r in clean)
    nested = {(r["train_dataset"], r["model"]): json.loads(r["tested_on"]) for r in report.nested_report(res).collect()}
    assert set(nested) == {("D0", "tree"), ("D1", "tree")}
    assert len(nested[("D0", "tree")][0]["adversarial_performance"]) == 3
    curve = ev.curves()
    assert sorted({r["epsilon"] for r in curve.collect()}) == [0.0, 0.05, 0.3]
    assert curve.select("train_dataset", "test_dataset").distinct().count() == 4
    full = ev.results()
    index = full.where("metric_key = 'test_robustness_index'").collect()
    assert len(index) == 4 and all(r["attack"] is None and 0 <= r["value"] <= 1 for r in index)
    assert ev.ledger.stage() == "complete" and ev.results().count() == full.count()
    assert {r["metric_key"] for r in ev.results(names=["accuracy", "fp_per_million"]).collect()} == {"test_accuracy", "test_fp_per_million"}
    config = json.loads(spark.read.text(f"{root}/config/{ev.key}").collect()[0]["value"])
    assert [a["name"] for a in config["attacks"]] == ["noise", "junk", "fgsm"] and config["data"] == "cafe0000"
    before = len(ev.times)
    assert ev.run().count() == preds.count() and len(ev.times) == before
    phases = {(run, phase) for run, phase, _ in ev.times}
    assert ("cross_tree_train-0", "train") in phases and ("cross_tree_train-0|D1", "test") in phases
    timed = {r["metric_key"] for r in runtime_results(preds, ev.times).collect()}
    assert {"train_runtime_s", "test_throughput_samples_per_s", "train_model_retrain_cost"} <= timed


def test_kfold_train_only_and_junk_strength(spark, tmp_path):
    u = views.unit(spark, SF).withColumn("target_label", (F.col("x1") + F.col("x3") > 0.8).cast("int"))
    table = split({"D0": u.drop("run_id")}, SplitPlan("k_fold", n_splits=2))
    args = (spark, table, ["x1", "x2", "x3"], "target_label", {"z": detectors.AnomalyDetector()}, str(tmp_path), "beef0000")
    assert Evaluation(*args, train_only=True).run() is None
    ev = Evaluation(*args, attacks=[Attack("junk", "junk", {"amount": 4.0, "strength": 1.0})], epsilons=[0.5])
    preds = ev.run()
    assert {p for _, p, _ in ev.times} == {"test"}
    assert preds.where("attack is null").count() == u.count()
    assert {r["fold"] for r in preds.select("fold").distinct().collect()} == {0, 1}
    curve = ev.curves().collect()
    assert sorted(r["epsilon"] for r in curve) == [0.0, 0.0, 0.5, 0.5]
    with pytest.raises(ValueError):
        Evaluation(*args, cross=True).run()


def test_csv_files_to_report(spark, tmp_path):
    (tmp_path / "day").mkdir()
    for k in range(2):
        lines = [f"{i % 17},{i * 0.5},{'BENIGN' if i % 3 else 'DoS'}" for i in range(60 * k, 60 * k + 60)]
        (tmp_path / "day" / f"{k}.csv").write_text("A,B,Label\n" + "\n".join(lines) + "\n")
    files = [readers.SubFile(str(tmp_path / "day"), label_column="Label", benign=("BENIGN",))]
    steps = {"D0": [Step("min_max"), Step("label"), Step("one_hot"), Step("remove_duplicate_rows")]}
    prepare(spark, {"D0": files}, steps, SplitPlan(), str(tmp_path / "run"), "abcd0000")
    table = sinks.read_splits(spark, str(tmp_path / "run"), "abcd0000")
    assert table.count() == 120 and table.select("row_id").distinct().count() == 120
    rep = dataset_report(table, "target_label")
    assert {(r["split"], r["n_rows"]) for r in rep["metadata"].collect()} == {("train", 84), ("test", 36)}
    written = sinks.read_report(spark, str(tmp_path / "run"), "abcd0000", "metadata")
    assert {(r["split"], r["n_rows"]) for r in written.collect()} == {("train", 84), ("test", 36)}
    steps = {r["action"]: r["detail"] for r in sinks.read_report(spark, str(tmp_path / "run"), "abcd0000", "steps").collect()}
    assert steps["remove_duplicate_rows"]["rows_after"] == "120" and steps["label"]["rows_after"] is None


def test_neighbouring_fits_share_a_pass(spark, monkeypatch):
    from flowgauge.operators import fitted

    passes = []
    real = fitted.fit_together
    monkeypatch.setattr(fitted, "fit_together", lambda df, jobs: passes.append([m for m, _ in jobs]) or real(df, jobs))
    df = spark.createDataFrame([(1, 1.0, 2.0, None), (2, 3.0, 6.0, 5.0)], "row_id bigint, a double, b double, c double")
    steps = [Step("min_max", ("a",)), Step("standard", ("b",)), Step("impute_mean", ("c",)), Step("min_max", ("c",))]
    chain = fit_chain(df, steps)
    assert passes == [["min_max", "standard", "impute_mean"], ["min_max"]]
    got = sorted((r["a"], r["b"], r["c"]) for r in chain.transform(df).collect())
    assert got == [(0.0, -1.0, 0.0), (1.0, 1.0, 0.0)]


def test_whole_numbers_keep_their_digits(spark):
    from flowgauge.operators.fitted import fit_impute_most_frequent

    big = 2**60 + 1
    df = spark.createDataFrame([(big,), (big,), (2**60,), (None,)], "a bigint")
    assert sorted(r["a"] for r in fit_impute_most_frequent(df, ["a"]).transform(df).collect()) == [2**60, big, big, big]


def test_changed_attacks_are_scored_anew(spark, tmp_path):
    u = views.unit(spark, SF).withColumn("target_label", (F.col("x1") + F.col("x3") > 0.8).cast("int"))
    table = split({"D0": u.drop("run_id")}, SplitPlan())

    def evaluation(std):
        det = {"tree": detectors.decision_tree(3)}
        return Evaluation(spark, table, ["x1", "x3"], "target_label", det, str(tmp_path), "d", attacks=[Attack("n", "noise", {"std": std, "seed": 1})])

    one, same, two = evaluation(0.1), evaluation(0.1), evaluation(0.5)
    assert one.key == same.key != two.key and one.train_key == two.train_key
    assert one.run().count() == two.run().count()
    assert any(p == "train" for _, p, _ in one.times) and not any(p == "train" for _, p, _ in two.times)
    assert same.run().count() and not same.times
    same.clear()
    assert same.ledger.stage() is None and same.run().count() and same.times


def test_class_names_end_to_end(spark, tmp_path):
    u = views.unit(spark, SF).withColumn("cls", F.when(F.col("x1") < 0.4, "BENIGN").when(F.col("x3") < 0.5, "dos").otherwise("scan"))
    table = split({"D0": u.drop("run_id")}, SplitPlan(target="cls"))
    dets = {"tree": detectors.decision_tree(4), "routed": detectors.ClusterRouted(clusters=3, forest_trees=3, n_arms=4)}
    ev = Evaluation(spark, table, ["x1", "x2", "x3"], "cls", dets, str(tmp_path), "d", attacks=[Attack("g", "gradient", {"eps": 0.1})])
    res = {(r["model"], r["metric_key"]): r["value"] for r in ev.results().where("attack is null").collect()}
    for model in dets:
        assert res[model, "test_accuracy"] > 0.6 and res[model, "test_roc_auc"] > 0.8
        assert (model, "test_f1_score_macro") in res and (model, "test_intrusion_detection_capability_binary") in res
        assert (model, "test_mttd_samples") in res
    preds = ev.run().where("attack is null")
    assert preds.where("score > 0 and score < 1 and model = 'routed'").count() > 0
    with pytest.raises(ValueError, match="no class"):
        detectors.decision_tree(3, benign="normal").fit(table, ["x1"], "cls")
    with pytest.raises(ValueError, match="no class"):
        detectors.ClusterRouted(benign="normal").fit(table, ["x1"], "cls")
    with pytest.raises(ValueError, match="benign class"):
        results_of(preds, benign="normal")


def test_sweep_without_attack_is_refused(spark, stored):
    root, _, _ = stored
    table = sinks.read_splits(spark, root, "cafe0000")
    ev = Evaluation(spark, table, ["x1"], "target_label", {}, root, "x", epsilons=[0.1])
    with pytest.raises(ValueError):
        ev.run()


def test_model_store(spark, stored, tmp_path):
    root, _, _ = stored
    table = sinks.read_splits(spark, root, "cafe0000").where("dataset = 'D0'")
    features = ["x1", "x2", "x3"]
    store = runs.ModelStore(spark, str(tmp_path / "models"), "hash1")
    key = lambda df: sorted((r["row_id"], r["y_pred"]) for r in df.collect())
    for name, det in (
        ("tree", detectors.decision_tree(4)),
        ("net", detectors.FeedForward((8, 4), max_iter=10)),
        ("routed", detectors.ClusterRouted(clusters=3, forest_trees=3)),
        ("z", detectors.AnomalyDetector()),
        ("pca", detectors.AnomalyDetector("percentile", components=2)),
    ):
        fitted = det.fit(table, features, "target_label")
        store.save(fitted, name, "D0")
        loaded = store.load(detectors.LOADERS, name, "D0")
        assert key(loaded.transform(table)) == key(fitted.transform(table))
        assert store.size_mb(name, "D0") > 0
    other = runs.ModelStore(spark, str(tmp_path / "models"), "hash2")
    assert other.load(detectors.LOADERS, "tree", "D0") is None
    assert other.load(detectors.LOADERS, "tree", "D0", force=True) is not None
    assert store.load(detectors.LOADERS, "absent", "D0") is None
    with pytest.raises(KeyError):
        detectors.detector("nothing")


def test_multiclass_detector(spark):
    p = views.unit(spark, SF).withColumn("cls", F.when(F.col("x1") < 0.3, "benign").when(F.col("x3") < 0.5, "dos").otherwise("scan"))
    for det in (detectors.decision_tree(6), detectors.TreeStack(max_depth=5, forest_trees=5)):
        out = det.fit(p, ["x1", "x2", "x3"], "cls").transform(p)
        rows = out.select("cls", "y_pred", "score", F.col("proba")["benign"].alias("pb")).collect()
        assert sum(r["cls"] == r["y_pred"] for r in rows) / len(rows) > 0.9
        assert all(abs(r["score"] + r["pb"] - 1) < 1e-9 for r in rows)


def test_ledger_and_plan(spark, tmp_path):
    led = runs.Ledger(spark, str(tmp_path / "ledger"), "h")
    assert led.stage() is None and led.completed().count() == 0
    led.add("a")
    led.set_stage("in_progress")
    led.set_stage("complete")
    assert led.stage() == "complete"
    assert [r["run_id"] for r in led.completed().collect()] == ["a"]
    with pytest.raises(ValueError):
        led.set_stage("odd")
    ds = spark.createDataFrame([("x",), ("y",)], "dataset string")
    assert runs.evaluation_plan(ds, ["m"], cross=True).count() == 4
    assert runs.evaluation_plan(ds, ["m"], cross=False).count() == 2
    assert runs.evaluation_plan(ds, ["m"], cross=True, train_only=True).count() == 2
    with pytest.raises(ValueError):
        runs.evaluation_plan(ds, ["m"], cross=True, folds=3)
    assert runs.config_hash({"b": 1, "a": [2]}) == runs.config_hash({"a": [2], "b": 1})


def test_cell_types(spark, tmp_path):
    cells = {
        "i": ["1", "-5", "n/a", "7"], "l": ["1", "9999999999", "", "2"], "d": ["1", "2.5", "inf", "1e3"], "b": ["true", "False", "NA", "true"],
        "day": ["2024-01-01", "2024-02-30", "2024-03-01", ""], "date": ["2024-01-01", "2024-02-29", "", "2023-01-01"],
        "t": ["2024-01-01 10:00:00", "2024-01-02", "", "2024-01-03T01:02:03.5"], "s": ["a", "1", "2", "3"], "none": ["", "NaN", "null", ""], "zip": ["007", "1d", "2", "3"],
    }
    lines = [",".join(cells), *[",".join(r) for r in zip(*cells.values())]]
    (tmp_path / "a b.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "empty.csv").write_text("")
    df = readers.read_any(spark, str(tmp_path))
    kinds = dict(df.dtypes)
    assert kinds == {"i": "int", "l": "bigint", "d": "double", "b": "boolean", "day": "string", "date": "date", "t": "timestamp", "s": "string", "none": "string", "zip": kinds["zip"]}
    rows = df.collect()
    assert [r["d"] for r in rows] == [1.0, 2.5, float("inf"), 1000.0] and [r["i"] for r in rows] == [1, -5, None, 7]
    assert all(r["none"] is None for r in rows) and [r["b"] for r in rows] == [True, False, None, True]
    odd = tmp_path / "odd.csv"
    odd.write_text('"x, y",x,X,\n1,2,3,4\n')
    assert readers.read_csv(spark, str(odd)).columns == spark.read.option("header", True).csv(str(odd)).columns


def test_row_counts_of_steps_come_from_the_write(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 5), None if i % 7 == 0 else 1.0) for i in range(100)], "row_id bigint, a double, b double")
    steps = [Step("remove_nan_rows"), Step("min_max", ("a",)), Step("remove_duplicate_rows")]
    sc = spark.sparkContext
    for path, jobs in ((str(tmp_path / "p"), 0), (None, 1)):
        done = preprocess(df, steps, path=path)
        before = set(sc.statusTracker().getJobIdsForGroup("steps"))
        sc.setJobGroup("steps", "steps")
        log = done.step_table("r")
        ran = set(sc.statusTracker().getJobIdsForGroup("steps")) - before
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert bool(ran) == bool(jobs)
        counts = {r["action"]: r["detail"].get("rows_after") for r in log.collect()}
        assert counts == {"remove_nan_rows": str(sum(i % 7 != 0 for i in range(100))), "min_max": None, "remove_duplicate_rows": str(done.table.count())}


def test_collectors_of_phases(spark, monkeypatch):
    class Rows:
        def start(self, spark, group):
            self.group = group

        def stop(self, spark, group):
            return {"same_group": float(group == self.group)}

    monkeypatch.setitem(collect.COLLECTORS, "mine", Rows)
    used = collect.Resources(spark, ("wall", "tasks", "mine"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "outer")
    with used.phase("r1", "train"):
        spark.range(0, 200_000, 1, 5).repartition(3).selectExpr("sum(id * id)").collect()
    with pytest.raises(ZeroDivisionError), used.phase("r1", "test"):
        1 / 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "outer"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r["phase"], r["collector"], r["metric_key"]): r["value"] for r in used.table().collect()}
    assert got["train", "tasks", "tasks"] >= 8 and got["train", "tasks", "task_s"] > 0 and got["train", "tasks", "shuffle_mb"] > 0
    assert got["test", "tasks", "jobs"] == 0 and got["test", "mine", "same_group"] == 1 and got["train", "wall", "runtime_s"] > 0
    summary = {r["phase"]: r for r in metrics.resource_summary(used.samples(), ["run_id", "phase"], "cpu", "ram").collect()}
    assert summary["train"]["max_cpu_percent"] > 0 and summary["test"]["cpu_sample_count"] == 1
    with pytest.raises(KeyError, match="nope"):
        collect.Resources(spark, ("nope",))


def test_gradient_of_the_own_network(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.random((300, 3)) * [1.0, 5.0, 1.0]
    y = (x[:, 0] * 5 + x[:, 1] > 5).astype(int)
    rows = [(i, *map(float, r), int(t), "D0", "train" if i % 3 else "test") for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id bigint, x1 double, x2 double, x3 double, target_label int, dataset string, split string")
    features = ["x1", "x2", "x3"]
    fitted = detectors.FeedForward((3, 5, 4), max_iter=30).fit(df, features, "target_label")
    net = detectors.network_of(fitted)
    scored = fitted.transform(df).orderBy("row_id").collect()
    assert np.allclose(net.chances(x)[:, 1], [r["proba"]["1"] for r in scored], atol=1e-9)
    # against differences of the loss
    own = net.chances(x).argmax(axis=1)
    signs = net.steps(x)
    for j in range(3):
        low, high = x.copy(), x.copy()
        low[:, j] -= 1e-5
        high[:, j] += 1e-5
        slope = [np.log(net.chances(low)[k, c]) - np.log(net.chances(high)[k, c]) for k, c in enumerate(own)]
        clear = np.abs(slope) > 1e-9
        assert clear.sum() > 200 and (np.sign(slope)[clear] == signs[clear, j]).all()
    odd = df.withColumn("x2", F.when(F.col("row_id") == 5, F.lit(None)).when(F.col("row_id") == 6, float("nan")).otherwise(F.col("x2")))
    moved = {r["row_id"]: r for r in perturb.perturb(odd, perturb.fgsm_network(features, net, 0.1, (None, None)), "g").collect()}
    assert all(abs(moved[i]["x1"] - x[i, 0] - 0.1 * signs[i, 0]) < 1e-12 for i in range(300) if i not in (5, 6)) and moved[5]["x1"] == x[5, 0]
    # an evaluation follows the network and needs no stand-in; its report is on disk
    monkeypatch.setattr(perturb, "fit_surrogate", lambda *a, **k: pytest.fail("a stand-in was fitted"))
    ev = Evaluation(spark, df, features, "target_label", {"net": detectors.FeedForward((3, 5, 4), max_iter=30)}, str(tmp_path), "fade0000", attacks=[Attack("fgsm", "gradient", {"eps": 0.3, "clip": (None, None)})])
    res = ev.results()
    value = {r["attack"]: r["value"] for r in res.where("metric_key = 'test_accuracy'").collect()}
    assert value["fgsm"] < value[None] - 0.1
    written = sinks.read_report(spark, str(tmp_path), ev.key, "nested").collect()
    assert json.loads(written[0]["tested_on"])[0]["adversarial_performance"][0]["attack"] == "fgsm"
    spent = {(r["phase"], r["metric_key"]) for r in sinks.read_report(spark, str(tmp_path), ev.key, "resources").collect()}
    assert {("train", "task_s"), ("test", "runtime_s")} <= spent
    assert detectors.network_of(detectors.AnomalyDetector().fit(df, features, "target_label")) is None
