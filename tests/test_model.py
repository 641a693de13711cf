"""Modelling: split, folds, scaler, AUC, training and persistence."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from suitewise.operators import features as E
from suitewise.operators import modeling as M
from suitewise.operators.risk import classification_metrics, roc_auc
from suitewise.sources import fixtures as X


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_auc_with_ties_equals_pairwise_count(spark, seed):
    rnd = random.Random(seed)
    rows = [(round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, label bigint")
    got = roc_auc(df).collect()[0]["roc_auc"]
    assert got == pytest.approx(brute_auc([r[0] for r in rows], [r[1] for r in rows]), abs=1e-12)


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label bigint, prediction bigint")
    r = classification_metrics(df).collect()[0]
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_split_and_folds_exact_class_counts(spark):
    rows = [(i, i % 4 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "exec_id bigint, pos boolean").select(
        "exec_id", F.col("pos").cast("bigint").alias("label"))
    counts = {(r[0], r[1]): r[2] for r in M.stratified_split(df).groupBy("split", "label").count().collect()}
    assert counts == {("test", 1): 50, ("train", 1): 200, ("test", 0): 150, ("train", 0): 600}
    folds = {(r[0], r[1]): r[2] for r in M.assign_folds(df, 5).groupBy("fold", "label").count().collect()}
    assert set(folds.values()) == {50, 150}


def test_population_scaler_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    s = M.apply_population_scaler(df, M.fit_population_scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in s] == [(-1.0, 0.0), (1.0, 0.0)]


def test_unknown_algorithm_raises():
    with pytest.raises(ValueError):
        M.make_classifier("svm")


def test_train_score_save_load(spark):
    hist = X.model_history(spark, SF_SMALL)
    rows = E.point_in_time_features(hist)
    model, metrics = M.train(rows, "logistic_regression")
    m = {r["split"]: r for r in metrics.collect()}
    assert m["test"]["roc_auc"] > 0.6          # the model history carries signal
    feats = E.serving_features(hist)
    before = {r[0]: r[1] for r in M.failure_probability(model, feats).select(E.KEY, "failure_probability").collect()}
    path = tempfile.mkdtemp(prefix="suitewise-model-", dir="/tmp") + "/m"
    M.save_model(model, path)
    after = {r[0]: r[1] for r in M.failure_probability(M.load_model(path), feats)
             .select(E.KEY, "failure_probability").collect()}
    assert before == after and len(before) > 0


def test_missing_model_raises():
    with pytest.raises(FileNotFoundError):
        M.load_model("/tmp/suitewise-no-such-model")


def test_untrained_model_raises_and_classes_stand_in_for_probabilities(spark):
    rows = [(f"t::{i}", i, *[float((i * (k + 3)) % 7) for k in range(len(E.FEATURE_NAMES))], float(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, ", ".join([f"{E.KEY} string", "exec_id bigint", *[f"{c} double" for c in E.FEATURE_NAMES],
                                                "label double"]))
    with pytest.raises(ValueError, match="not trained"):
        M.failure_probability(None, df)
    with pytest.raises(ValueError, match="not trained"):
        M.failure_probability(M.make_pipeline("logistic_regression"), df)
    scored = M.failure_probability(M.fit(df, "linear_svc"), df).collect()
    assert len(scored) == 80 and {r["failure_probability"] for r in scored} <= {0.0, 1.0}
    assert all(r["failure_probability"] == r["prediction"] for r in scored)


def _labelled(spark, n):
    return spark.range(n).select(F.concat(F.lit("t::"), (F.col("id") % 9).cast("string")).alias(E.KEY), F.col("id").alias("exec_id"),
                                 *[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(E.FEATURE_NAMES)],
                                 (F.col("id") % 4 == 0).cast("int").alias("label"))


def test_training_rows_lie_in_even_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_A_TASK", 100, raising=False)
    fitted, evaluated, fit, evaluate = [], [], M.fit, M.evaluate
    monkeypatch.setattr(M, "fit", lambda rows, *a, **k: fitted.append(rows) or fit(rows, *a, **k))
    monkeypatch.setattr(M, "evaluate", lambda scored: evaluated.append(scored) or evaluate(scored))
    _, metrics = M.train(_labelled(spark, 1000), "logistic_regression")
    sizes = [r["count"] for r in fitted[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 800 and max(sizes) <= 100
    # the metrics go over scores that were written, not over the model again
    plan = evaluated[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "UDF" not in plan
    assert {r["split"]: r["n"] for r in metrics.collect()} == {"train": 800, "test": 200}


def test_folds_lie_in_even_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_A_TASK", 100, raising=False)
    fitted, fit = [], M.fit
    monkeypatch.setattr(M, "fit", lambda rows, *a, **k: fitted.append(rows) or fit(rows, *a, **k))
    M.cross_validate(_labelled(spark, 600), "logistic_regression", k=2)
    for rows in fitted:
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 300 and max(sizes) <= 100


def test_folds_are_fitted_from_kept_columns_and_scored_before_these_are_dropped(spark, monkeypatch):
    cached, fit = [], M.fit

    def fitted(rows, *a, **k):
        cached.append("InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString())
        return fit(rows, *a, **k)

    monkeypatch.setattr(M, "fit", fitted)
    result = M.cross_validate(_labelled(spark, 300), "logistic_regression", k=3)
    assert cached == [True] * 3
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "InMemoryRelation" not in plan
    assert result.collect()[0]["accuracy_mean"] is not None


def test_number_of_training_parts():
    assert [M.training_tasks(n, 8) for n in (0, 39_999, 40_000, 100_000, 1_000_000, 10_000_000)] == [1, 1, 2, 5, 8, 80]
