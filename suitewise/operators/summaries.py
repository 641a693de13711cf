"""Mergeable summaries of a test's history (for S6).

``summarise`` gives one row per test from which all serving features (E17)
follow; ``merge`` adds a summary of later rows to one of earlier rows, exactly:
counts and sums add, the spread of times merges by the pairwise formula, the
latest ten outcomes are the first ten of both lists, and the rows after the last
failure start anew where the later part failed. A test whose new rows do not all
come after its old ones (``overlapping``) can't be merged and is summarised again.

Null times and coverages take no part in their sums, as in ``test_stats``; an
empty history gives an empty summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitewise.operators import features as E
from suitewise.operators.features import KEY, ORDER, RECENT_ROWS
from suitewise.session import ensure_checkpoint_dir

_COUNTS = ("n", "failures", "changed_rows", "coupled_rows", "timed_rows", "sum_time", "sum_coverage")


def summarise(history: DataFrame) -> DataFrame:
    """One row per test: counts, sums, spread of times, first and last position, the latest outcomes.

    Writes one checkpoint, of a row per test, when called.
    """
    pos, time = F.struct(*ORDER), F.col("execution_time").cast("double")
    ensure_checkpoint_dir(history.sparkSession)
    stats = E.test_stats(  # written, for each further use would go over all rows again
        history, F.count("execution_time").alias("timed_rows"), F.avg(time).alias("mean_time"),
        F.var_pop(time).alias("var_time"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos")).checkpoint()
    recent = E.last_rows(history, RECENT_ROWS).groupBy(KEY).agg(  # at most RECENT_ROWS rows a test
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "passed"))), lambda r: r["passed"]).alias("recent"))
    since = E.since_last_failure(history, stats)
    return stats.join(recent, KEY).join(since, KEY, "left").select(
        KEY, *_COUNTS, "mean_time", (F.col("var_time") * F.col("timed_rows")).alias("squares_time"), "first_run_id",
        "first_pos", "last_pos", "latest", "recent", F.col("time_since_last_failure").alias("since_failure"))


def overlapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tests (``full_test_name``) of ``new`` with a row that does not come after all rows of ``old``."""
    last = old.select(KEY, F.col("last_pos").alias("old_last"))
    return new.join(last, KEY).where(F.col("first_pos") <= F.col("old_last")).select(KEY)


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Summary of the rows behind both; the rows of a test in ``new`` all come after those in ``old``."""
    def total(name: str) -> Column:
        return F.coalesce(a[name] + b[name], a[name], b[name])

    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, a[KEY] == b[KEY], "full_outer")
    ka, kb = (F.coalesce(s["timed_rows"], F.lit(0)).cast("double") for s in (a, b))
    gap = F.coalesce(a["mean_time"] - b["mean_time"], F.lit(0.0))
    both = ka + kb
    out = {c: total(c).cast(new.schema[c].dataType) for c in _COUNTS}
    out |= {
        KEY: F.coalesce(a[KEY], b[KEY]),
        "mean_time": F.coalesce((a["mean_time"] * ka + b["mean_time"] * kb) / F.nullif(both, F.lit(0.0)),
                                a["mean_time"], b["mean_time"]),
        "squares_time": F.coalesce(a["squares_time"] + b["squares_time"] + gap * gap * ka * kb / F.nullif(both, F.lit(0.0)),
                                   a["squares_time"], b["squares_time"]),
        "first_run_id": F.least(a["first_run_id"], b["first_run_id"]),
        "first_pos": F.least(a["first_pos"], b["first_pos"]),
        "last_pos": F.greatest(a["last_pos"], b["last_pos"]),
        "latest": F.coalesce(b["latest"], a["latest"]),
        "recent": F.slice(F.concat(F.coalesce(b["recent"], F.array()), F.coalesce(a["recent"], F.array())), 1, RECENT_ROWS),
        "since_failure": F.coalesce(b["since_failure"], a["since_failure"] + F.coalesce(b["n"], F.lit(0))),
    }
    return j.select(*[out[c].alias(c) for c in new.columns])


def features_of(summary: DataFrame) -> DataFrame:
    """The 13 model inputs per test, as ``serving_features`` gives them without a change map."""
    n, recent = F.col("n"), F.col("recent")
    std = F.when(F.col("timed_rows") > 1, F.sqrt(F.col("squares_time") / (F.col("timed_rows") - 1)))
    first_pass = F.array_position(recent, True)
    values = {
        "historical_failure_rate": E._ratio(F.col("failures"), n),
        "recent_failures": F.size(F.filter(recent, lambda p: ~p)).cast("bigint"),
        "avg_execution_time": E._ratio(F.col("sum_time"), n),
        "execution_time_variance": F.coalesce(F.round(std, 6), F.lit(0.0)),
        "code_change_frequency": E._ratio(F.col("changed_rows"), n),
        "lines_changed": F.lit(0).cast("bigint"), "functions_changed": F.lit(0).cast("bigint"),
        "test_coupling": E._ratio(F.col("coupled_rows"), n),
        "is_flaky": F.col("latest.is_flaky").cast("bigint"),
        "test_age": n, "coverage": E._ratio(F.col("sum_coverage"), n),
        "failure_streak": F.when(first_pass > 0, first_pass - 1).otherwise(F.size(recent)).cast("bigint"),
        "time_since_last_failure": F.coalesce(F.col("since_failure"), F.lit(E.NEVER_FAILED).cast("bigint")),
    }
    return summary.select(KEY, *[values[c].alias(c) for c in E.FEATURE_NAMES])
