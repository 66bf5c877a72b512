"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], con) == []


@pytest.mark.parametrize("name", ["pipeline_steps", "nested_report", "lr_feature_selection", "attack_fgsm_surrogate"])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["detect_decision_tree", "detect_tree_stack", "detect_mlp", "detect_cluster_routed"])
def test_detectors_beat_the_majority(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    n = len(rows)
    share = sum(r["y_true"] for r in rows) / n
    right = sum(r["y_true"] == r["y_pred"] for r in rows) / n
    assert right > max(share, 1 - share)
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_pca_scores(spark):
    rows = QUERIES["anomaly_pca"](spark, SF).collect()
    benign = [r["y_pred"] for r in rows if r["label"] == 0]
    assert 0 < sum(benign) <= 0.1 * len(benign) + 1
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
