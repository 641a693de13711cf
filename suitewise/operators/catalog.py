"""Catalog facts about a history table (A3..A6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitewise.operators.features import KEY, ORDER, test_file_of


def history_metadata(history: DataFrame) -> DataFrame:
    """A3: one row; file lists are bounded by the number of files, not rows."""
    return history.agg(
        F.count_distinct("run_id").alias("num_runs"),
        F.count_distinct(KEY).alias("num_tests"),
        F.count_distinct("test_file").alias("num_test_files"),
        F.count_distinct("source_file").alias("num_source_files"),
        F.count(F.lit(1)).alias("total_records"),
        (F.count_if("passed").cast("double") / F.count(F.lit(1)).cast("double")).alias("overall_pass_rate"),
        F.array_sort(F.collect_set("test_file")).alias("test_files"),
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
    )


def history_stats(history: DataFrame) -> DataFrame:
    """A4: records, unique tests, runs, pass rate %, mean time."""
    n = F.count(F.lit(1)).cast("double")
    return history.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(KEY).alias("unique_tests"),
        F.count_distinct("run_id").alias("num_runs"),
        (F.count_if("passed").cast("double") / n * 100.0).alias("pass_rate_pct"),
        (F.sum("execution_time").cast("double") / n).alias("mean_execution_time"),
    )


def history_preview(history: DataFrame, n: int = 10) -> DataFrame:
    """A4 preview: the first ``n`` executions in run order (a top-k, not a scan cap)."""
    return (history.orderBy(*ORDER).limit(n)
            .select("exec_id", "run_id", KEY, "passed",
                    F.col("execution_time").cast("double").alias("execution_time")))


def test_catalog(history: DataFrame) -> DataFrame:
    """A5: distinct test ids."""
    return history.select(KEY).distinct()


def test_id_parts(tests: DataFrame) -> DataFrame:
    """File part (before ``::``, '' if absent) and last part of each id."""
    return tests.select(KEY, test_file_of(F.col(KEY)).alias("test_file"),
                        F.element_at(F.split(F.col(KEY), "::"), -1).alias("test_name"))
