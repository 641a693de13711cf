"""Queries over the history: catalog facts (A) and features (E)."""

from __future__ import annotations

import uuid


from suitewise.operators import catalog as A
from suitewise.operators import features as E
from suitewise.plans.inputs import Inputs
from suitewise.plans.oracle_fixtures import with_ctes
from suitewise.plans.registry import register
from suitewise.session import ensure_checkpoint_dir
from suitewise.sources.history import read_history, write_history


@register("history_scan", with_ctes(["th"], "SELECT * FROM th"))
def history_scan(spark, sf_dir):
    return Inputs(spark, sf_dir).history


@register("history_read", with_ctes(["th"], """
SELECT * REPLACE (CAST(execution_time AS DECIMAL(12,3)) AS execution_time, CAST(coverage AS DECIMAL(5,3)) AS coverage)
FROM th"""))
def history_read(spark, sf_dir):
    """The history written as a table (A2) and read back by name (A1)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    write_history(Inputs(spark, sf_dir).history, path)
    return read_history(spark, path)


@register("history_metadata", with_ctes(["th"], """
SELECT count(DISTINCT run_id) AS num_runs, count(DISTINCT full_test_name) AS num_tests,
  count(DISTINCT test_file) AS num_test_files, count(DISTINCT source_file) AS num_source_files,
  count(*) AS total_records,
  CAST(count_if(passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS overall_pass_rate,
  list_sort(list_distinct(list(test_file))) AS test_files,
  list_sort(list_distinct(list(source_file))) AS source_files
FROM th"""))
def history_metadata(spark, sf_dir):
    return A.history_metadata(Inputs(spark, sf_dir).history)


@register("history_stats", with_ctes(["th"], """
SELECT count(*) AS total_records, count(DISTINCT full_test_name) AS unique_tests,
  count(DISTINCT run_id) AS num_runs,
  CAST(count_if(passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS pass_rate_pct,
  CAST(sum(execution_time) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_execution_time
FROM th"""))
def history_stats(spark, sf_dir):
    return A.history_stats(Inputs(spark, sf_dir).history)


@register("history_preview", with_ctes(["th"], """
SELECT exec_id, run_id, full_test_name, passed, CAST(execution_time AS DOUBLE) AS execution_time
FROM th ORDER BY run_ts, exec_id LIMIT 10"""))
def history_preview(spark, sf_dir):
    return A.history_preview(Inputs(spark, sf_dir).history, 10)


@register("test_catalog", with_ctes(["th"], "SELECT DISTINCT full_test_name FROM th"))
def test_catalog(spark, sf_dir):
    return A.test_catalog(Inputs(spark, sf_dir).history)


@register("test_id_parts", with_ctes(["cand"], """
SELECT full_test_name,
  CASE WHEN contains(full_test_name, '::') THEN split_part(full_test_name, '::', 1) ELSE '' END AS test_file,
  string_split(full_test_name, '::')[-1] AS test_name
FROM cand"""))
def test_id_parts(spark, sf_dir):
    return A.test_id_parts(Inputs(spark, sf_dir).candidates)


def _row_feature(name: str, col: str):
    sql = with_ctes(["th", "ptf"], f"""
SELECT t.full_test_name, t.exec_id, f.{col} AS {col}
FROM th t JOIN ptf f USING (full_test_name)""")

    @register(name, sql)
    def q(spark, sf_dir):
        m = E.feature_matrix(Inputs(spark, sf_dir).history)
        return m.select(E.KEY, "exec_id", col)
    return q


_row_feature("feat_failure_rate", "historical_failure_rate")
_row_feature("feat_recent_failures", "recent_failures")
_row_feature("feat_avg_time", "avg_execution_time")
_row_feature("feat_time_std", "execution_time_variance")
_row_feature("feat_change_frequency", "code_change_frequency")
_row_feature("feat_failure_streak", "failure_streak")
_row_feature("feat_since_failure", "time_since_last_failure")


@register("feat_test_age", with_ctes(["th"], """
SELECT full_test_name, exec_id, run_id - min(run_id) OVER (PARTITION BY full_test_name) AS test_age FROM th"""))
def feat_test_age(spark, sf_dir):
    return E.feature_matrix(Inputs(spark, sf_dir).history).select(E.KEY, "exec_id", "test_age")


@register("feat_coupling_row", with_ctes(["th"], """
SELECT full_test_name, exec_id,
  CASE WHEN lines_changed > 0 AND NOT passed THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS test_coupling FROM th"""))
def feat_coupling_row(spark, sf_dir):
    return E.feature_matrix(Inputs(spark, sf_dir).history).select(E.KEY, "exec_id", "test_coupling")


_MATRIX_SQL = """
SELECT t.full_test_name, t.exec_id, f.historical_failure_rate, f.recent_failures, f.avg_execution_time,
  f.execution_time_variance, f.code_change_frequency, t.lines_changed, t.functions_changed,
  CASE WHEN t.lines_changed > 0 AND NOT t.passed THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS test_coupling,
  CAST(t.is_flaky AS BIGINT) AS is_flaky, t.run_id - f.first_run_id AS test_age,
  CAST(t.coverage AS DOUBLE) AS coverage, f.failure_streak, f.time_since_last_failure{extra}
FROM th t JOIN ptf f USING (full_test_name)"""


@register("feat_matrix", with_ctes(["th", "ptf"], _MATRIX_SQL.format(extra="")))
def feat_matrix(spark, sf_dir):
    return E.feature_matrix(Inputs(spark, sf_dir).history)


@register("training_rows", with_ctes(["th", "ptf"], _MATRIX_SQL.format(
    extra=",\n  CAST(CASE WHEN t.passed THEN 0 ELSE 1 END AS BIGINT) AS label")))
def training_rows(spark, sf_dir):
    return E.training_rows(Inputs(spark, sf_dir).history)


@register("rolling_failures", with_ctes(["th"], """
SELECT full_test_name, exec_id,
  CAST(sum(CASE WHEN passed THEN 0 ELSE 1 END) OVER (PARTITION BY full_test_name ORDER BY run_ts, exec_id
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_failures FROM th"""))
def rolling_failures(spark, sf_dir):
    return E.rolling_failures(Inputs(spark, sf_dir).history)


_SERVING_SQL = """
SELECT f.full_test_name, f.historical_failure_rate, f.recent_failures, f.avg_execution_time,
  f.execution_time_variance, f.code_change_frequency,
  CAST(coalesce(c.lines_changed, 0) AS BIGINT) AS lines_changed,
  CAST(coalesce(c.functions_changed, 0) AS BIGINT) AS functions_changed,
  f.test_coupling, f.is_flaky, f.test_age, f.coverage, f.failure_streak, f.time_since_last_failure
FROM ptf f LEFT JOIN cmap c ON c.test_file = split_part(f.full_test_name, '::', 1)"""


@register("serving_features", with_ctes(["ptf", "cmap"], _SERVING_SQL))
def serving_features(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return E.serving_features(i.history, changes=i.change_map)


@register("serving_features_lookback", with_ctes(["th"], """
SELECT full_test_name, count(*) AS test_age,
  CAST(count_if(NOT passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS historical_failure_rate,
  CAST(sum(execution_time) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_execution_time,
  CAST(coalesce(min(rn) FILTER (WHERE NOT passed) - 1, 999) AS BIGINT) AS time_since_last_failure
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY full_test_name
    ORDER BY run_ts DESC, exec_id DESC) AS rn FROM th) x WHERE rn <= 50) r
GROUP BY full_test_name"""))
def serving_features_lookback(spark, sf_dir):
    f = E.per_test_features(Inputs(spark, sf_dir).history, lookback=50)
    return f.select(E.KEY, "test_age", "historical_failure_rate", "avg_execution_time",
                    "time_since_last_failure")


@register("feat_coupling_ratio", with_ctes(["ptf"], "SELECT full_test_name, test_coupling FROM ptf"))
def feat_coupling_ratio(spark, sf_dir):
    return E.per_test_features(Inputs(spark, sf_dir).history).select(E.KEY, "test_coupling")


@register("latest_values", with_ctes(["thr"], """
SELECT full_test_name, is_flaky, lines_changed, functions_changed, passed FROM thr WHERE rn = 1"""))
def latest_values(spark, sf_dir):
    return E.latest_values(Inputs(spark, sf_dir).history)


@register("coupling_flag", with_ctes(["th"], """
SELECT full_test_name, exec_id, CASE WHEN contains(files_changed, source_file) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS test_coupling
FROM th"""))
def coupling_flag(spark, sf_dir):
    return E.coupling_flag(Inputs(spark, sf_dir).history)


@register("default_features", with_ctes(["cand", "ptf", "cmap"], """
SELECT c.full_test_name,
  CASE WHEN f.full_test_name IS NULL THEN 0.05 ELSE f.historical_failure_rate END AS historical_failure_rate,
  CASE WHEN f.full_test_name IS NULL THEN 0 ELSE f.recent_failures END AS recent_failures,
  CASE WHEN f.full_test_name IS NULL THEN 0.1 ELSE f.avg_execution_time END AS avg_execution_time,
  CASE WHEN f.full_test_name IS NULL THEN 0.0 ELSE f.execution_time_variance END AS execution_time_variance,
  CASE WHEN f.full_test_name IS NULL THEN 0.0 ELSE f.code_change_frequency END AS code_change_frequency,
  CAST(coalesce(m.lines_changed, 0) AS BIGINT) AS lines_changed,
  CAST(coalesce(m.functions_changed, 0) AS BIGINT) AS functions_changed,
  CASE WHEN f.full_test_name IS NULL THEN 0.0 ELSE f.test_coupling END AS test_coupling,
  CASE WHEN f.full_test_name IS NULL THEN 0 ELSE f.is_flaky END AS is_flaky,
  CASE WHEN f.full_test_name IS NULL THEN 0 ELSE f.test_age END AS test_age,
  CASE WHEN f.full_test_name IS NULL THEN 0.8 ELSE f.coverage END AS coverage,
  CASE WHEN f.full_test_name IS NULL THEN 0 ELSE f.failure_streak END AS failure_streak,
  CASE WHEN f.full_test_name IS NULL THEN 999 ELSE f.time_since_last_failure END AS time_since_last_failure,
  f.full_test_name IS NOT NULL AS has_history
FROM cand c LEFT JOIN ptf f USING (full_test_name)
LEFT JOIN cmap m ON m.test_file = CASE WHEN contains(c.full_test_name, '::')
  THEN split_part(c.full_test_name, '::', 1) ELSE '' END"""))
def default_features(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return E.default_features(i.candidates, i.history, changes=i.change_map)


@register("failure_scores", with_ctes(["fs"], "SELECT * FROM fs"))
def failure_scores(spark, sf_dir):
    return Inputs(spark, sf_dir).scores


@register("change_map", with_ctes(["cmap"], "SELECT * FROM cmap"))
def change_map(spark, sf_dir):
    return Inputs(spark, sf_dir).change_map


_PIT_SQL = with_ctes(["th"], """
SELECT full_test_name, exec_id, run_id, passed,
  CASE WHEN p > 0 THEN CAST(sf AS DOUBLE) / CAST(p AS DOUBLE) ELSE 0.05 END AS historical_failure_rate,
  CAST(coalesce(rf, 0) AS BIGINT) AS recent_failures,
  CASE WHEN p > 0 THEN CAST(stc AS DOUBLE) / CAST(p AS DOUBLE) / 100.0 ELSE 0.1 END AS avg_execution_time,
  CASE WHEN p >= 2 THEN sqrt(greatest((CAST(stq AS DOUBLE) - CAST(stc AS DOUBLE) * CAST(stc AS DOUBLE) / CAST(p AS DOUBLE))
    / (CAST(p AS DOUBLE) - 1.0), 0.0)) / 100.0 ELSE 0.0 END AS execution_time_variance,
  CASE WHEN p > 0 THEN CAST(sc AS DOUBLE) / CAST(p AS DOUBLE) ELSE 0.0 END AS code_change_frequency,
  lines_changed, functions_changed,
  CASE WHEN p > 0 THEN CAST(scp AS DOUBLE) / CAST(p AS DOUBLE) ELSE 0.0 END AS test_coupling,
  CAST(is_flaky AS BIGINT) AS is_flaky, CAST(p AS BIGINT) AS test_age,
  CASE WHEN p > 0 THEN CAST(scv AS DOUBLE) / CAST(p AS DOUBLE) / 100.0 ELSE 0.8 END AS coverage,
  CAST(least(pos - 1 - coalesce(lp, 0), 10) AS BIGINT) AS failure_streak,
  CAST(CASE WHEN lf IS NULL THEN 999 ELSE pos - 1 - lf END AS BIGINT) AS time_since_last_failure,
  CAST(f AS BIGINT) AS label
FROM (SELECT *, pos - 1 AS p,
    coalesce(sum(f) OVER pw, 0) AS sf, sum(f) OVER (tw ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rf,
    coalesce(sum(tc) OVER pw, 0) AS stc, coalesce(sum(tc * tc) OVER pw, 0) AS stq,
    coalesce(sum(c) OVER pw, 0) AS sc, coalesce(sum(cp) OVER pw, 0) AS scp, coalesce(sum(cv) OVER pw, 0) AS scv,
    max(CASE WHEN passed THEN pos END) OVER pw AS lp, max(CASE WHEN NOT passed THEN pos END) OVER pw AS lf
  FROM (SELECT *, CAST(execution_time * 100 AS BIGINT) AS tc, CAST(coverage * 100 AS BIGINT) AS cv,
      CASE WHEN passed THEN 0 ELSE 1 END AS f, CASE WHEN lines_changed > 0 THEN 1 ELSE 0 END AS c,
      CASE WHEN lines_changed > 0 AND NOT passed THEN 1 ELSE 0 END AS cp,
      row_number() OVER (PARTITION BY full_test_name ORDER BY run_ts, exec_id) AS pos FROM th) b
  WINDOW tw AS (PARTITION BY full_test_name ORDER BY run_ts, exec_id),
    pw AS (tw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x""")


@register("point_in_time_features", _PIT_SQL)
def point_in_time_features(spark, sf_dir):
    return E.point_in_time_features(Inputs(spark, sf_dir).history)
