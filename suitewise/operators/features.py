"""History features (family E).

Order inside a test is ``(run_ts, exec_id)``. The per-test values are built
from three skew-tolerant pieces instead of one window over each test's whole
history:

* ``test_stats``: one ``groupBy(full_test_name)``; partial aggregation runs
  map-side, so a test holding a third of all rows still ships one row per map
  task.
* ``last_rows``: ``row_number() <= n`` over the latest rows; Spark plans a
  partial WindowGroupLimit before the exchange, so at most n rows per test and
  map task cross the shuffle.
* ``since_last_failure``: the last failure position per test comes from the
  aggregate; the rows after it are counted by a second partial aggregation
  over history to which that position is attached.

Per-test values are attached to rows (``attach``) without shuffling the rows of
a busy test: at most ``HOT`` tests can hold more than 1 / ``HOT`` of all rows
each, so these go by a broadcast of that proven size; the rest is an equi-join
in which no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitewise.operators.ordered import running_totals

KEY = "full_test_name"
ORDER = ("run_ts", "exec_id")

# Feature order of the model input (fixed values: names and order of the 13 features)
FEATURE_NAMES = (
    "historical_failure_rate", "recent_failures", "avg_execution_time",
    "execution_time_variance", "code_change_frequency", "lines_changed",
    "functions_changed", "test_coupling", "is_flaky", "test_age", "coverage",
    "failure_streak", "time_since_last_failure",
)

# Defaults for a test without history (fixed values)
NEW_TEST_DEFAULTS = {
    "historical_failure_rate": 0.05, "recent_failures": 0, "avg_execution_time": 0.1,
    "execution_time_variance": 0.0, "code_change_frequency": 0.0, "test_coupling": 0.0,
    "is_flaky": 0, "test_age": 0, "coverage": 0.8, "failure_streak": 0,
    "time_since_last_failure": 999,
}

RECENT_ROWS = 10
NEVER_FAILED = 999


def _failed() -> Column:
    return ~F.col("passed")


def _ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / den.cast("double")


def latest_first(key: str = KEY) -> Window:
    return Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in ORDER])


def last_rows(history: DataFrame, n: int, key: str = KEY) -> DataFrame:
    """The latest ``n`` rows of every test with ``rn`` (1 = latest)."""
    rn = F.row_number().over(latest_first(key))
    return history.withColumn("rn", rn).where(F.col("rn") <= n)


def within_lookback(history: DataFrame, lookback: int | None) -> DataFrame:
    """Keep each test's latest ``lookback`` rows (None keeps everything)."""
    if lookback is None:
        return history
    return last_rows(history, lookback).drop("rn")


HOT = 256  # tests with more than 1 / HOT of all rows; there are fewer than HOT of them


def attach(rows: DataFrame, per_test: DataFrame, n: str) -> DataFrame:
    """Rows with the values of their test (inner join on the test id); ``n`` is a test's number of rows.

    Rows of hot tests stay in the tasks that read them.
    """
    all_rows = per_test.agg(F.sum(n)).scalar()
    hot = F.broadcast(per_test.where(F.col(n) * HOT > all_rows))
    rest = per_test.where(F.col(n) * HOT <= all_rows)
    cold = rows.join(hot.select(KEY), KEY, "left_anti")
    return rows.join(hot, KEY).unionByName(cold.join(rest, KEY))


def test_stats(history: DataFrame, *more: Column) -> DataFrame:
    """One row per test: counts, sums and the latest / last-failed positions, and ``more`` aggregates."""
    failed = _failed()
    changed = F.col("lines_changed") > 0
    pos = F.struct(*ORDER)
    return history.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("failures"),
        F.sum("execution_time").alias("sum_time"),
        F.stddev_samp(F.col("execution_time").cast("double")).alias("std_time"),
        F.count_if(changed).alias("changed_rows"),
        F.count_if(changed & failed).alias("coupled_rows"),
        F.sum("coverage").alias("sum_coverage"),
        F.min("run_id").alias("first_run_id"),
        F.max_by(F.struct("is_flaky", "lines_changed", "functions_changed", "passed",
                          "execution_time"), pos).alias("latest"),
        F.max(F.when(failed, pos)).alias("last_failure"),
        *more,
    )


def recent_stats(history: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """recent_failures and failure_streak over the latest ``n`` rows of each test."""
    last = last_rows(history, n)
    return last.groupBy(KEY).agg(
        F.count_if(_failed()).alias("recent_failures"),
        F.coalesce(F.min(F.when(F.col("passed"), F.col("rn"))) - 1,
                   F.count(F.lit(1))).cast("bigint").alias("failure_streak"),
    )


def since_last_failure(history: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows after each test's last failure (tests that failed at least once)."""
    lf = stats.where(F.col("last_failure").isNotNull()).select(
        KEY, F.col("last_failure.run_ts").alias("lf_ts"), F.col("last_failure.exec_id").alias("lf_id"), "n")
    after = (F.col("run_ts") > F.col("lf_ts")) | (
        (F.col("run_ts") == F.col("lf_ts")) & (F.col("exec_id") > F.col("lf_id")))
    return (attach(history.select(KEY, *ORDER), lf, "n")
            .groupBy(KEY).agg(F.count_if(after).alias("time_since_last_failure")))


def per_test_features(history: DataFrame, lookback: int | None = None) -> DataFrame:
    """All per-test values of the serving form (E17, E18, E19, E22) plus facts for H5."""
    h = within_lookback(history, lookback)
    stats = test_stats(h)
    recent = recent_stats(h)
    since = since_last_failure(h, stats)
    n = F.col("n")
    return (stats.join(recent, KEY, "left").join(since, KEY, "left").select(
        KEY,
        _ratio(F.col("failures"), n).alias("historical_failure_rate"),
        F.col("recent_failures"),
        _ratio(F.col("sum_time"), n).alias("avg_execution_time"),
        F.coalesce(F.round(F.col("std_time"), 6), F.lit(0.0)).alias("execution_time_variance"),
        _ratio(F.col("changed_rows"), n).alias("code_change_frequency"),
        _ratio(F.col("coupled_rows"), n).alias("test_coupling"),
        F.col("latest.is_flaky").cast("bigint").alias("is_flaky"),
        n.alias("test_age"),
        _ratio(F.col("sum_coverage"), n).alias("coverage"),
        F.col("failure_streak"),
        F.coalesce(F.col("time_since_last_failure"), F.lit(NEVER_FAILED).cast("bigint"))
        .alias("time_since_last_failure"),
        F.col("latest.lines_changed").alias("last_lines_changed"),
        F.col("first_run_id"),
    ))


def serving_features(history: DataFrame, changes: DataFrame | None = None,
                     lookback: int | None = None) -> DataFrame:
    """The 13 model inputs per test, current change sizes from ``changes``.

    ``changes`` is a (test_file, lines_changed, functions_changed) table keyed by
    the part of the test id before ``::``; absent files give 0, 0.
    """
    f = per_test_features(history, lookback)
    f = f.withColumn("test_file", test_file_of(F.col(KEY)))
    if changes is None:
        f = f.withColumn("lines_changed", F.lit(0).cast("bigint")).withColumn(
            "functions_changed", F.lit(0).cast("bigint"))
    else:
        c = changes.select("test_file", F.col("lines_changed").cast("bigint").alias("lines_changed"),
                           F.col("functions_changed").cast("bigint").alias("functions_changed"))
        f = f.join(c, "test_file", "left").fillna(0, ["lines_changed", "functions_changed"])
    return f.select(KEY, *FEATURE_NAMES)


def test_file_of(test_id: Column) -> Column:
    """Part before ``::``; '' when the id has no ``::``."""
    return F.when(test_id.contains("::"), F.split_part(test_id, F.lit("::"), F.lit(1))).otherwise(F.lit(""))


def default_features(candidates: DataFrame, history: DataFrame,
                     changes: DataFrame | None = None) -> DataFrame:
    """Serving features for every candidate; tests without history get defaults."""
    served = serving_features(history, changes)
    cand = candidates.select(KEY).withColumn("test_file", test_file_of(F.col(KEY)))
    if changes is None:
        cand = cand.withColumn("cur_lines", F.lit(0).cast("bigint")).withColumn(
            "cur_funcs", F.lit(0).cast("bigint"))
    else:
        c = changes.select("test_file", F.col("lines_changed").cast("bigint").alias("cur_lines"),
                           F.col("functions_changed").cast("bigint").alias("cur_funcs"))
        cand = cand.join(c, "test_file", "left").fillna(0, ["cur_lines", "cur_funcs"])
    j = cand.join(served.withColumn("has_history", F.lit(True)), KEY, "left")
    cols = [KEY]
    for name in FEATURE_NAMES:
        if name == "lines_changed":
            cols.append(F.col("cur_lines").alias(name))
        elif name == "functions_changed":
            cols.append(F.col("cur_funcs").alias(name))
        else:
            d = NEW_TEST_DEFAULTS[name]
            default = F.lit(d).cast("double" if isinstance(d, float) else "bigint")
            cols.append(F.when(F.col("has_history"), F.col(name)).otherwise(default).alias(name))
    cols.append(F.coalesce(F.col("has_history"), F.lit(False)).alias("has_history"))
    return j.select(*cols)


def feature_matrix(history: DataFrame) -> DataFrame:
    """E14 (train form), see ``_matrix``."""
    return _matrix(history).drop("passed")


def _matrix(history: DataFrame) -> DataFrame:
    """E14 (train form): per-test values broadcast onto every execution row.

    Mirrors the reference's training matrix: whole-history per-test values
    (T4), row values for lines / functions / coverage / flaky, the row-level
    coupling flag (T3), ``test_age = run_id - first run_id`` (T5) and the real
    per-test streak and runs-since-failure (T1, T2).
    """
    per_test = per_test_features(history).select(
        KEY, "historical_failure_rate", "recent_failures", "avg_execution_time",
        "execution_time_variance", "code_change_frequency", "failure_streak",
        "time_since_last_failure", "first_run_id", F.col("test_age").alias("_rows"))
    rows = history.select(KEY, "exec_id", "run_id", "passed", "lines_changed", "functions_changed",
                          "is_flaky", "coverage")
    j = attach(rows, per_test, "_rows")
    return j.select(
        KEY, "exec_id", "passed", "historical_failure_rate", "recent_failures", "avg_execution_time",
        "execution_time_variance", "code_change_frequency", "lines_changed", "functions_changed",
        F.when((F.col("lines_changed") > 0) & ~F.col("passed"), 1.0).otherwise(0.0).alias("test_coupling"),
        F.col("is_flaky").cast("bigint").alias("is_flaky"),
        (F.col("run_id") - F.col("first_run_id")).alias("test_age"),
        F.col("coverage").cast("double").alias("coverage"),
        "failure_streak", "time_since_last_failure",
    )


def training_rows(history: DataFrame) -> DataFrame:
    """Feature matrix plus label (1 = failed), rows with any null dropped."""
    label = F.when(F.col("passed"), 0).otherwise(1).cast("bigint")
    return _matrix(history).withColumn("label", label).drop("passed").dropna(subset=list(FEATURE_NAMES) + ["label"])


def point_in_time_features(history: DataFrame) -> DataFrame:
    """Per-row features that only see the test's earlier rows (no label leak, T3/T4).

    Used for training. Rate, mean and spread of time, change frequency,
    coupling ratio, coverage and age over the rows strictly before the current
    one; recent failures over the 10 rows before it; the failure streak ending
    just before it (at most 10) and runs since the last earlier failure.

    No window per test: one global order (test, run_ts, exec_id) with a start
    marker per test carries running sums (times and coverage in hundredths, so
    sums are exact integers), the sums at the test's start, and the positions of
    the last failure / pass / start before each row; the value 11 rows back is an
    equi-join lookup on the unique position.
    """
    failed = _failed()
    cents = (F.col("execution_time") * 100).cast("bigint")
    ts_type = history.schema["run_ts"].dataType
    sums = {"_one": F.lit(1), "_f": failed.cast("int"), "_c": (F.col("lines_changed") > 0).cast("int"),
            "_cp": ((F.col("lines_changed") > 0) & failed).cast("int"), "_tc": cents, "_tq": cents * cents,
            "_cv": (F.col("coverage") * 100).cast("bigint")}
    keep = ("exec_id", "run_id", "passed", "lines_changed", "functions_changed", "is_flaky")
    real = history.select(KEY, F.col("run_ts").alias("_t"), F.lit(1).alias("_kind"), *keep,
                          *[v.cast("bigint").alias(k) for k, v in sums.items()],
                          failed.alias("_ff"), F.col("passed").alias("_pf"), F.lit(False).alias("_sf"))
    start = history.select(KEY).distinct().select(
        KEY, F.lit(None).cast(ts_type).alias("_t"), F.lit(0).alias("_kind"),
        *[F.lit(None).cast(history.schema[k].dataType).alias(k) for k in keep],
        *[F.lit(0).cast("bigint").alias(k) for k in sums],
        F.lit(False).alias("_ff"), F.lit(False).alias("_pf"), F.lit(True).alias("_sf"))
    order = [F.col(KEY), F.col("_t").asc_nulls_first(), F.col("_kind"), F.col("exec_id")]
    c = running_totals(real.unionByName(start), order, list(sums), with_index="_pos",
                       last_before=["_ff", "_pf", "_sf"], at_last={"_sf": list(sums)})
    back = c.select(F.col("_pos").alias("_bpos"), F.col("cum__f").alias("_bf"))
    rows = c.where(F.col("_kind") == 1)
    j = rows.join(back, F.greatest(F.col("_pos") - (RECENT_ROWS + 1), F.col("prev__sf")) == F.col("_bpos"))
    prior = {k: F.col(f"cum_{k}") - F.col(k) - F.col(f"_sf_{k}") for k in sums}
    n = prior["_one"]
    nd = n.cast("double")
    has = n > 0

    def share(k, default):
        return F.when(has, prior[k].cast("double") / nd).otherwise(F.lit(default))

    var_cents = (prior["_tq"].cast("double") - prior["_tc"].cast("double") * prior["_tc"].cast("double") / nd) \
        / (nd - 1.0)
    last_pass_or_start = F.greatest(F.coalesce(F.col("prev__pf"), F.lit(0)), F.col("prev__sf"))
    return j.select(
        KEY, "exec_id", "run_id", "passed",
        share("_f", 0.05).alias("historical_failure_rate"),
        (F.col("cum__f") - F.col("_f") - F.col("_bf")).cast("bigint").alias("recent_failures"),
        F.when(has, prior["_tc"].cast("double") / nd / 100.0).otherwise(F.lit(0.1)).alias("avg_execution_time"),
        F.when(n >= 2, F.sqrt(F.greatest(var_cents, F.lit(0.0))) / 100.0).otherwise(F.lit(0.0))
        .alias("execution_time_variance"),
        share("_c", 0.0).alias("code_change_frequency"),
        F.col("lines_changed"), F.col("functions_changed"),
        share("_cp", 0.0).alias("test_coupling"),
        F.col("is_flaky").cast("bigint").alias("is_flaky"),
        n.cast("bigint").alias("test_age"),
        F.when(has, prior["_cv"].cast("double") / nd / 100.0).otherwise(F.lit(0.8)).alias("coverage"),
        F.least(F.col("_pos") - 1 - last_pass_or_start, F.lit(RECENT_ROWS)).cast("bigint").alias("failure_streak"),
        F.when(F.col("prev__ff") > F.col("prev__sf"), F.col("_pos") - 1 - F.col("prev__ff"))
        .otherwise(F.lit(NEVER_FAILED)).cast("bigint").alias("time_since_last_failure"),
        F.col("_f").cast("bigint").alias("label"),
    )


def rolling_failures(history: DataFrame, rows: int = RECENT_ROWS) -> DataFrame:
    """Failures in the current and previous ``rows - 1`` rows of the test.

    Skew-tolerant form of a per-test row frame: one global order (test, run_ts,
    exec_id) with a start marker per test, range partitioned, carries running
    counts c (rows) and f (failures), and both as they were at the test's start.
    For a row, rn = c - c(start) and the result is f - f(row c - rows) when rn >
    rows, else f - f(start); the earlier row is an equi-join on the unique c.
    """
    real = history.select(KEY, F.col("run_ts").alias("_t"), F.lit(1).alias("_kind"),
                          F.col("exec_id").alias("_ref"), F.lit(1).alias("_one"),
                          F.when(_failed(), 1).otherwise(0).alias("_fail"), F.lit(False).alias("_sf"))
    start = history.select(KEY).distinct().select(
        KEY, F.lit(None).cast(history.schema["run_ts"].dataType).alias("_t"), F.lit(0).alias("_kind"),
        F.lit(None).cast("bigint").alias("_ref"), F.lit(0).alias("_one"), F.lit(0).alias("_fail"), F.lit(True).alias("_sf"))
    c = running_totals(real.unionByName(start),
                       [F.col(KEY), F.col("_t").asc_nulls_first(), F.col("_kind"), F.col("_ref")],
                       ["_one", "_fail"], at_last={"_sf": ["_one", "_fail"]})
    body = c.where(F.col("_kind") == 1).select(
        KEY, F.col("_ref").alias("exec_id"), F.col("cum__one").alias("c"), F.col("cum__fail").alias("f"),
        F.col("_sf__one").alias("c0"), F.col("_sf__fail").alias("f0"))
    back = body.select(F.col("c").alias("c_back"), F.col("f").alias("f_back"))
    j = body.join(back, F.col("c") - rows == F.col("c_back"), "left")
    earlier = F.when(F.col("c") - F.col("c0") > rows, F.col("f_back")).otherwise(F.col("f0"))
    return j.select(KEY, "exec_id", (F.col("f") - earlier).cast("bigint").alias("rolling_failures"))


def coupling_flag(history: DataFrame) -> DataFrame:
    """The generator's coupling flag, source_file contained in files_changed."""
    return history.select(KEY, "exec_id",
                          F.when(F.col("files_changed").contains(F.col("source_file")), 1.0)
                          .otherwise(0.0).alias("test_coupling"))


def latest_values(history: DataFrame) -> DataFrame:
    """Values of each test's latest row."""
    s = test_stats(history)
    return s.select(KEY, F.col("latest.is_flaky").alias("is_flaky"),
                    F.col("latest.lines_changed").alias("lines_changed"),
                    F.col("latest.functions_changed").alias("functions_changed"),
                    F.col("latest.passed").alias("passed"))
