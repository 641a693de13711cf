"""Streaming queries (S): each drains the events file as a stream (availableNow) and
returns what its sink holds; every one has a batch twin with the same answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitewise.plans.oracle_fixtures import with_ctes
from suitewise.plans import q_sequences  # noqa: F401  (registers login_lockout first)
from suitewise.plans.q_sequences import MAX_REQ, WINDOW_S
from suitewise.plans.registry import ORACLE, register
from suitewise.streaming import streams as S


def _history(spark, sf_dir, closing=None):
    return S.history_stream(spark, sf_dir, "events.parquet", closing)


@register("stream_test_stats", with_ctes(["th"], """
SELECT full_test_name, count(*) AS n,
  CAST(count_if(NOT passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS historical_failure_rate,
  CAST(sum(execution_time) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_execution_time,
  CAST(count_if(lines_changed > 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS code_change_frequency
FROM th GROUP BY full_test_name"""))
def stream_test_stats(spark, sf_dir):
    return S.run_to_table(S.running_test_stats(_history(spark, sf_dir)), "test_stats", "update",
                          ["full_test_name"])


@register("stream_failures_daily", with_ctes(["th"], """
SELECT strftime(run_ts, '%Y-%m-%d') AS day, test_file, count(*) AS runs, count_if(NOT passed) AS failures,
  CAST(0 AS BIGINT) AS late_rows
FROM th GROUP BY 1, 2"""))
def stream_failures_daily(spark, sf_dir):
    return S.daily_failures_with_late(_history(spark, sf_dir), "failures_daily")


@register("stream_streak", with_ctes(["ptf"], """
SELECT full_test_name, failure_streak, time_since_last_failure, CAST(0 AS BIGINT) AS late_rows FROM ptf"""))
def stream_streak(spark, sf_dir):
    end = S.closing_folder(spark)
    return S.run_to_table(S.live_streak(_history(spark, sf_dir, end)), "streak", "update", ["full_test_name"], end)


@register("stream_rate_admit", q_sequences.ADMIT_SQL)
def stream_rate_admit(spark, sf_dir):
    end = S.closing_folder(spark)
    ev = S.event_stream(spark, sf_dir, "events.parquet", closing=end)
    return S.run_to_table(S.stream_rate_admit(ev, MAX_REQ, WINDOW_S), "rate_admit", "append", closing=end)


@register("stream_lockout")
def stream_lockout(spark, sf_dir):
    end = S.closing_folder(spark)
    ev = S.event_stream(spark, sf_dir, "events.parquet", closing=end)
    return S.run_to_table(S.stream_lockout(ev), "lockout", "append", closing=end)


# the stream must give exactly the batch twin's answer (L4)
ORACLE["stream_lockout"] = ORACLE["login_lockout"]


@register("stream_scores")
def stream_scores(spark, sf_dir):
    from suitewise.operators import features as E
    from suitewise.operators import modeling as M
    from suitewise.plans.inputs import Inputs
    i = Inputs(spark, sf_dir)
    rows = M.materialised_for_training(E.point_in_time_features(i.model_history), M.stratified_split)
    model = M.fit(rows.where(F.col("split") == "train"), "logistic_regression")
    base = S._run_dir(spark, "scores")
    S.stream_scores(S.event_stream(spark, sf_dir, "events.parquet"), model, base, f"{base}/checkpoint")
    s = spark.read.parquet(f"{base}/scores")
    latest = s.groupBy(E.KEY).agg(F.max_by("failure_probability", "_batch").alias("failure_probability"))
    return latest
