"""History source and the sinks of a selection run.

The history has one fixed schema; readers fail fast on missing columns and a
missing path means "no history" (None), which the caller turns into an error
when history is required. Sinks write through the DataFrame writer; the two
text reports are bounded (one line per selected test, a fixed top-N table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from suitewise.operators.features import KEY
from suitewise.operators.selection import HIGH_TIER, LOW_TIER, ranking_order

HISTORY_SCHEMA = ("exec_id bigint, run_id bigint, run_ts timestamp_ntz, test_file string, test_name string, "
                  "full_test_name string, source_file string, passed boolean, execution_time decimal(12,3), "
                  "coverage decimal(5,3), lines_changed bigint, functions_changed bigint, files_changed string, "
                  "is_flaky boolean")


def read_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """A1: the history table, or None when nothing exists at ``path``.

    Columns are taken by name, in any order. ``timestamp`` may stand for ``run_ts``, and rows without
    ``exec_id`` get one that is unique in the table read.
    """
    try:
        df = spark.read.format(fmt).option("header", True).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if "timestamp" in df.columns and "run_ts" not in df.columns:
        df = df.withColumnRenamed("timestamp", "run_ts")
    if "exec_id" not in df.columns:
        df = df.withColumn("exec_id", F.monotonically_increasing_id())
    missing = [f.split()[0] for f in HISTORY_SCHEMA.split(", ") if f.split()[0] not in df.columns]
    if missing:
        raise ValueError(f"history at {path} lacks columns {missing}")
    return df.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in HISTORY_SCHEMA.split(", ")])


def write_history(history: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """A2: append executions, partitioned by run date so readers prune whole days."""
    out = history.withColumn("run_date", F.to_date("run_ts"))
    writer = out.write.mode(mode).partitionBy("run_date").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_selected(selected: DataFrame, path: str) -> None:
    """One selected test id per line, in rank order (bounded by max_tests)."""
    (selected.orderBy("rank").select(F.col(KEY).alias("value")).coalesce(1)
     .write.mode("overwrite").text(path))


def report_lines(priorities: DataFrame, top_n: int = 20) -> DataFrame:
    """The Markdown report as ordered lines (tier counts + top-N table)."""
    s = F.col("priority_score")
    counts = priorities.agg(F.count(F.lit(1)).alias("n"), F.count_if(s > HIGH_TIER).alias("hi"),
                            F.count_if((s >= LOW_TIER) & (s <= HIGH_TIER)).alias("mid"),
                            F.count_if(s < LOW_TIER).alias("lo"))
    head = counts.select(F.posexplode(F.array(
        F.lit("# Ranked tests"), F.lit(""),
        F.format_string("%d tests scored; %d above the high tier, %d between the tiers, %d below.",
                        F.col("n"), F.col("hi"), F.col("mid"), F.col("lo")), F.lit(""),
        F.lit(f"First {top_n}, by score:"), F.lit(""),
        F.lit("| # | score | P(fail) | test | why |"), F.lit("|-:|-:|-:|:-|:-|"))).alias("_o", "value"))
    head = head.select("value", F.col("_o").cast("bigint").alias("_o"), F.lit(0).alias("_part"))
    top = priorities.orderBy(*ranking_order()).limit(top_n)
    rows = top.select(F.row_number().over(Window.orderBy(*ranking_order())).alias("_r"), "*").select(
        F.format_string("| %d | %.3f | %.3f | `%s` | %s |", F.col("_r"), F.col("priority_score"),
                        F.col("failure_probability"), F.col(KEY), F.col("reason")).alias("value"),
        F.col("_r").cast("bigint").alias("_o"), F.lit(1).alias("_part"))
    return head.unionByName(rows)


def write_report(priorities: DataFrame, path: str, top_n: int = 20) -> None:
    """The Markdown report as one text file."""
    lines = report_lines(priorities, top_n)
    lines.orderBy("_part", "_o").select("value").coalesce(1).write.mode("overwrite").text(path)
