"""Queries for modelling (F), model scores (F13, G1) and the model-driven selection (H9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from suitewise.operators import features as E
from suitewise.operators import modeling as M
from suitewise.plans.inputs import Inputs
from suitewise.plans.oracle_fixtures import with_ctes
from suitewise.plans.registry import register
from suitewise.session import ensure_checkpoint_dir

_COLS = E.FEATURE_NAMES


def _scaled_sql() -> str:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}__mean, stddev_pop(CAST({c} AS DOUBLE)) AS {c}__std"
                      for c in _COLS)
    cols = ", ".join(f"round((CAST(m.{c} AS DOUBLE) - s.{c}__mean) / CASE WHEN s.{c}__std = 0 THEN 1.0 "
                     f"ELSE s.{c}__std END, 6) AS {c}" for c in _COLS)
    matrix = """SELECT t.full_test_name, t.exec_id, f.historical_failure_rate, f.recent_failures, f.avg_execution_time,
  f.execution_time_variance, f.code_change_frequency, t.lines_changed, t.functions_changed,
  CASE WHEN t.lines_changed > 0 AND NOT t.passed THEN 1.0 ELSE 0.0 END AS test_coupling,
  CAST(t.is_flaky AS BIGINT) AS is_flaky, t.run_id - f.first_run_id AS test_age,
  CAST(t.coverage AS DOUBLE) AS coverage, f.failure_streak, f.time_since_last_failure
FROM th t JOIN ptf f USING (full_test_name)"""
    return with_ctes(["th", "ptf"], f"""
SELECT m.full_test_name, m.exec_id, {cols}
FROM ({matrix}) m, (SELECT {stats} FROM ({matrix}) x) s""")


@register("scaled_features", _scaled_sql())
def scaled_features(spark, sf_dir):
    m = E.feature_matrix(Inputs(spark, sf_dir).history)
    return M.apply_population_scaler(m, M.fit_population_scaler(m), digits=6)


def _labelled_rows(spark, sf_dir):
    return E.training_rows(Inputs(spark, sf_dir).history)


_SPLIT_SQL = with_ctes(["th"], """
SELECT s.split, c.label, CASE WHEN s.split = 'test' THEN CAST(ceil(c.n * 0.2) AS BIGINT)
  ELSE c.n - CAST(ceil(c.n * 0.2) AS BIGINT) END AS n
FROM (SELECT CAST(CASE WHEN passed THEN 0 ELSE 1 END AS BIGINT) AS label, count(*) AS n FROM th GROUP BY 1) c,
  (VALUES ('train'), ('test')) s(split)""")


@register("split_counts", _SPLIT_SQL)
def split_counts(spark, sf_dir):
    s = M.stratified_split(_labelled_rows(spark, sf_dir), "label", 0.2, 42)
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("split_report", with_ctes(["th"], """
SELECT sum(n - CAST(ceil(n * 0.2) AS BIGINT)) AS train_rows, sum(CAST(ceil(n * 0.2) AS BIGINT)) AS test_rows,
  CAST(sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS failure_rate
FROM (SELECT CAST(CASE WHEN passed THEN 0 ELSE 1 END AS BIGINT) AS label, count(*) AS n FROM th GROUP BY 1) c"""))
def split_report(spark, sf_dir):
    s = M.stratified_split(_labelled_rows(spark, sf_dir), "label", 0.2, 42)
    return M.split_report(s).select(F.col("train_rows").cast("bigint").alias("train_rows"),
                                    F.col("test_rows").cast("bigint").alias("test_rows"), "failure_rate")


@register("fold_sizes", with_ctes(["th"], """
SELECT CAST((rn - 1) % 5 AS INTEGER) AS fold, label, count(*) AS n FROM (
  SELECT CAST(CASE WHEN passed THEN 0 ELSE 1 END AS BIGINT) AS label,
    row_number() OVER (PARTITION BY passed ORDER BY exec_id) AS rn FROM th) x GROUP BY 1, 2"""))
def fold_sizes(spark, sf_dir):
    f = M.assign_folds(_labelled_rows(spark, sf_dir), 5, "label", 42)
    return f.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


_RANKED = """SELECT exec_id, passed, row_number() OVER (PARTITION BY passed ORDER BY md5('42:' || exec_id), exec_id) AS rn,
  count(*) OVER (PARTITION BY passed) AS n FROM th"""


@register("split_rows", with_ctes(["th"], f"""
SELECT exec_id, CAST(CASE WHEN passed THEN 0 ELSE 1 END AS BIGINT) AS label,
  CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM ({_RANKED}) x"""))
def split_rows(spark, sf_dir):
    return M.stratified_split(_labelled_rows(spark, sf_dir), "label", 0.2, 42).select("exec_id", "label", "split")


@register("fold_rows", with_ctes(["th"], f"""
SELECT exec_id, CAST(CASE WHEN passed THEN 0 ELSE 1 END AS BIGINT) AS label, CAST((rn - 1) % 5 AS INTEGER) AS fold
FROM ({_RANKED}) x"""))
def fold_rows(spark, sf_dir):
    return M.assign_folds(_labelled_rows(spark, sf_dir), 5, "label", 42).select("exec_id", "label", "fold")


def _train_rows(spark, sf_dir):
    return E.point_in_time_features(Inputs(spark, sf_dir).model_history)


def _train_split(spark, sf_dir):
    rows = M.materialised_for_training(_train_rows(spark, sf_dir), M.stratified_split)
    return rows.where(F.col("split") == "train")


def _model_scores(spark, sf_dir, algorithm):
    i = Inputs(spark, sf_dir)
    model = M.fit(_train_split(spark, sf_dir), algorithm)
    feats = E.serving_features(i.model_history, i.change_map)  # T8: the current change sizes of a test's file
    return M.failure_probability(model, feats).select(E.KEY, "failure_probability")


@register("rf_scores")
def rf_scores(spark, sf_dir):
    return _model_scores(spark, sf_dir, "random_forest")


@register("gbt_scores")
def gbt_scores(spark, sf_dir):
    return _model_scores(spark, sf_dir, "gradient_boosting")


@register("lr_scores")
def lr_scores(spark, sf_dir):
    return _model_scores(spark, sf_dir, "logistic_regression")


@register("train_metrics")
def train_metrics(spark, sf_dir):
    _, metrics = M.train(_train_rows(spark, sf_dir), "random_forest")
    return metrics


@register("feature_importance")
def feature_importance(spark, sf_dir):
    model, _ = M.train(_train_rows(spark, sf_dir), "random_forest")
    return M.feature_importance(model, spark)


@register("cross_validation")
def cross_validation(spark, sf_dir):
    return M.cross_validate(_train_rows(spark, sf_dir), "logistic_regression", k=5)


@register("failure_probability")
def failure_probability(spark, sf_dir):
    """Scores of a stored logistic model, read back, and the classes of one without probabilities."""
    i = Inputs(spark, sf_dir)
    train = _train_split(spark, sf_dir)
    feats = E.serving_features(i.model_history, i.change_map)
    out = None
    for algorithm in ("logistic_regression", "linear_svc"):
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{algorithm}-{uuid.uuid4().hex}"
        M.save_model(M.fit(train, algorithm), path)
        scored = M.failure_probability(M.load_model(path), feats).select(
            F.lit(algorithm).alias("model"), E.KEY, "failure_probability", "prediction")
        out = scored if out is None else out.unionByName(scored)
    return out


@register("batch_scores")
def batch_scores(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    model = M.fit(_train_split(spark, sf_dir), "random_forest")
    feats = E.default_features(i.candidates, i.model_history, changes=i.change_map)
    return M.failure_probability(model, feats).select(E.KEY, "has_history", "failure_probability")


@register("select_tests_model")
def select_tests_model(spark, sf_dir):
    from suitewise.plans.flagship import selection_plan
    probs = rf_scores(spark, sf_dir)
    return selection_plan(spark, sf_dir, min_tests=5, max_tests=40, probabilities=probs,
                          history=Inputs(spark, sf_dir).model_history)
