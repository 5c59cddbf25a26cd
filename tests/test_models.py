"""Model searches: jobs of a task, and metrics of constant predictions."""

import uuid

import pytest

from eventloom.operators import metrics as X
from eventloom.plans import load
from eventloom.plans import modelling as P


def jobs_of(spark, run):
    """``run()`` and the number of Spark jobs it started."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_metrics_of_constant_predictions_have_no_correlation(spark):
    df = spark.createDataFrame([("a", float(i), 2.0) for i in range(5)] + [("b", float(i), 2.0 * i) for i in range(5)], "k string, y double, p double")
    got = {r["k"]: r for r in X.regression_metrics(df, ["k"], "y", "p").collect()}
    assert got["a"]["pearson_correlation"] is None and got["a"]["spearman_correlation"] is None
    assert got["a"]["mae"] == pytest.approx(1.2) and got["a"]["median_absolute_error"] == 1.0
    assert got["b"]["pearson_correlation"] == pytest.approx(1.0) and got["b"]["spearman_correlation"] == pytest.approx(1.0)


def test_a_model_search_reads_its_predictions_once_for_all_sets(spark, monkeypatch):
    kept = {}
    run = P.run_task

    def keep(*args, **kwargs):
        kept.update(run(*args, **kwargs))
        return kept

    monkeypatch.setattr(P, "run_task", keep)
    sf = "/root/testdata/sf0.001"
    rows, jobs = jobs_of(spark, lambda: load()["intensity_models"].build(spark, sf).collect())
    assert jobs < 130
    # the metrics are those of the predictions
    by = {}
    for r in kept["predictions"].where("set_name = 'test'").collect():
        by.setdefault(r["model_name"], []).append((r["y_true"], r["y_pred"]))
    assert {r["model_name"] for r in rows} == set(by) == {"dummy_regressor", "linear_regression", "ridge", "tweedie_regressor"}
    for r in rows:
        y = by[r["model_name"]]
        mean = sum(a for a, _ in y) / len(y)
        square = sum((a - b) ** 2 for a, b in y)
        assert r["error"] is None and r["test_mae"] == pytest.approx(sum(abs(a - b) for a, b in y) / len(y))
        assert r["test_rmse"] == pytest.approx((square / len(y)) ** 0.5) and r["test_r2"] == pytest.approx(1 - square / sum((a - mean) ** 2 for a, _ in y))
    assert kept["bias"]().where("bias_dimension = 'borough'").count() > 0
