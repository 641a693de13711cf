"""Prioritisation and selection (family H).

The per-test loops of the reference become one plan: per-test features
(grouped aggregations), probabilities and impact joined on the test key, then
column arithmetic. Selection only ever needs the top ``max(min_tests,
max_tests)`` tests (scores fall and times are non-negative, so the selected set
is a prefix of the ranking): a distributed top-k (TakeOrderedAndProject),
after which rank and running time are computed over at most that many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitewise.operators.features import KEY, per_test_features, test_file_of
from suitewise.operators.ordered import global_rank

# Weights and labels of the priority score (fixed values)
W_PROBABILITY, W_IMPACT, W_RATE, W_RECENT = 0.4, 0.3, 0.15, 0.15
RECENT_SCALE = 5.0
REASON_FLOOR = 0.5
NEW_TEST_SCORE, NEW_TEST_PROBABILITY, NEW_TEST_TIME = 0.5, 0.5, 0.1
REASONS = ("High failure risk", "Code changes", "Historical failures", "Recent failures")
GENERAL_REASON = "General testing"
NEW_TEST_REASON = "New test"
HIGH_TIER, LOW_TIER = 0.7, 0.3
DEFAULT_MIN_SCORE = 0.3

PRIORITY_COLUMNS = (KEY, "priority_score", "failure_probability", "execution_time",
                    "recent_failures", "lines_changed", "reason")


def recent_share(recent: Column) -> Column:
    return F.least(recent.cast("double") / F.lit(RECENT_SCALE), F.lit(1.0))


def priority_reason(prob: Column, impact: Column, rate: Column, recent: Column) -> Column:
    """H3: the largest factor, first one on ties, when above 0.5."""
    factors = [prob, impact, rate, recent_share(recent)]
    top = F.greatest(*factors)
    pick = F.when(factors[0] == top, REASONS[0])
    for f, label in zip(factors[1:], REASONS[1:]):
        pick = pick.when(f == top, label)
    return F.when(top > F.lit(REASON_FLOOR), pick).otherwise(F.lit(GENERAL_REASON))


def priority_scores(history: DataFrame, probabilities: DataFrame | None = None,
                    impact: DataFrame | None = None, candidates: DataFrame | None = None,
                    lookback: int | None = None) -> DataFrame:
    """H1, H2, H3, H5: one row per candidate test.

    ``probabilities``: (full_test_name, failure_probability); ``impact``:
    (test_file, impact); ``candidates``: (full_test_name) or None for every
    test in history.
    """
    feats = per_test_features(history, lookback).select(
        KEY, "historical_failure_rate", "recent_failures", "avg_execution_time",
        F.col("last_lines_changed").alias("lines_changed"), F.lit(True).alias("has_history"))
    if candidates is not None:
        j = candidates.select(KEY).distinct().join(feats, KEY, "left")
    else:
        j = feats
    if probabilities is not None:
        j = j.join(probabilities.select(KEY, F.col("failure_probability").alias("prob")), KEY, "left")
    else:
        j = j.withColumn("prob", F.lit(None).cast("double"))
    j = j.withColumn("test_file", test_file_of(F.col(KEY)))
    if impact is not None:
        j = j.join(impact.select("test_file", F.col("impact").alias("imp")), "test_file", "left")
    else:
        j = j.withColumn("imp", F.lit(None).cast("double"))
    prob = F.coalesce(F.col("prob"), F.lit(0.0))
    imp = F.coalesce(F.col("imp"), F.lit(0.0))
    rate, recent = F.col("historical_failure_rate"), F.col("recent_failures")
    score = (prob * F.lit(W_PROBABILITY) + imp * F.lit(W_IMPACT) + rate * F.lit(W_RATE)
             + recent_share(recent) * F.lit(W_RECENT))
    old = F.col("has_history").isNotNull()
    return j.select(
        KEY,
        F.when(old, score).otherwise(F.lit(NEW_TEST_SCORE)).alias("priority_score"),
        F.when(old, prob).otherwise(F.coalesce(F.col("prob"), F.lit(NEW_TEST_PROBABILITY)))
        .alias("failure_probability"),
        F.when(old, F.col("avg_execution_time")).otherwise(F.lit(NEW_TEST_TIME)).alias("execution_time"),
        F.when(old, recent).otherwise(F.lit(0).cast("bigint")).alias("recent_failures"),
        F.when(old, F.col("lines_changed")).otherwise(F.lit(0).cast("bigint")).alias("lines_changed"),
        F.when(old, priority_reason(prob, imp, rate, recent)).otherwise(F.lit(NEW_TEST_REASON))
        .alias("reason"),
    )


def ranking_order() -> list[Column]:
    return [F.col("priority_score").desc(), F.col(KEY).asc()]


def priority_ranking(priorities: DataFrame) -> DataFrame:
    """H4: every test with its 1-based rank (distributed global rank)."""
    return global_rank(priorities, ranking_order(), "rank")


def select_tests(priorities: DataFrame, min_tests: int = 5, max_tests: int = 100,
                 min_score: float = DEFAULT_MIN_SCORE, time_budget: float | None = None) -> DataFrame:
    """H6: greedy selection as a prefix rule over the top-k.

    rank <= min_tests always; otherwise rank <= max_tests, score >= min_score
    and running time within the budget (0 or None = no budget).
    """
    k = max(min_tests, max_tests)
    top = priorities.orderBy(*ranking_order()).limit(k)
    w = Window.orderBy(*ranking_order())
    ranked = top.select("*", F.row_number().over(w).cast("bigint").alias("rank"),
                        F.sum("execution_time").over(w.rowsBetween(Window.unboundedPreceding, 0))
                        .alias("cum_time"))
    keep = (F.col("rank") <= min_tests) | (
        (F.col("rank") <= max_tests) & (F.col("priority_score") >= F.lit(min_score)))
    if time_budget:
        keep = (F.col("rank") <= min_tests) | (keep & (F.col("cum_time") <= F.lit(float(time_budget))))
    return ranked.where(keep).select("rank", *PRIORITY_COLUMNS)


def tier_of(score: Column) -> Column:
    return (F.when(score > F.lit(HIGH_TIER), "high")
            .when(score >= F.lit(LOW_TIER), "medium").otherwise("low"))


def selection_summary(priorities: DataFrame, selected: DataFrame) -> DataFrame:
    """H7: one row of counts, reduction and time figures."""
    flags = selected.select(KEY, F.lit(True).alias("sel"))
    j = priorities.join(flags, KEY, "left")
    sel = F.col("sel").isNotNull()
    t = F.col("execution_time")
    s = F.col("priority_score")
    agg = j.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(sel).alias("selected_tests"),
        F.sum(t).alias("t_all"),
        F.sum(F.when(sel, t)).alias("t_sel"),
        F.count_if(sel & (s > F.lit(HIGH_TIER))).alias("high_priority_count"),
        F.count_if(sel & (s >= F.lit(LOW_TIER)) & (s <= F.lit(HIGH_TIER))).alias("medium_priority_count"),
        F.count_if(sel & (s < F.lit(LOW_TIER))).alias("low_priority_count"),
    )
    t_all = F.coalesce(F.col("t_all"), F.lit(0.0))
    t_sel = F.coalesce(F.col("t_sel"), F.lit(0.0))
    return agg.select(
        "total_tests", "selected_tests",
        F.round((F.lit(1.0) - F.try_divide(F.col("selected_tests").cast("double"),
                                             F.col("total_tests").cast("double"))) * 100.0, 6)
        .alias("reduction_percentage"),
        F.round(t_all, 6).alias("total_execution_time_all"),
        F.round(t_sel, 6).alias("total_execution_time_selected"),
        F.round(t_all - t_sel, 6).alias("time_saved"),
        F.round(F.when(t_all > 0, (t_all - t_sel) / t_all * 100.0).otherwise(F.lit(0.0)), 6)
        .alias("time_reduction_percentage"),
        "high_priority_count", "medium_priority_count", "low_priority_count",
    )


def priority_tiers(priorities: DataFrame) -> DataFrame:
    """H8: count per tier, all three tiers present."""
    s = F.col("priority_score")
    one = priorities.agg(
        F.count_if(s > F.lit(HIGH_TIER)).alias("high"),
        F.count_if((s >= F.lit(LOW_TIER)) & (s <= F.lit(HIGH_TIER))).alias("medium"),
        F.count_if(s < F.lit(LOW_TIER)).alias("low"))
    return one.select(F.explode(F.array(
        F.struct(F.lit("high").alias("tier"), F.col("high").alias("n_tests")),
        F.struct(F.lit("medium").alias("tier"), F.col("medium").alias("n_tests")),
        F.struct(F.lit("low").alias("tier"), F.col("low").alias("n_tests")))).alias("t")).select("t.*")


def priority_report(priorities: DataFrame, top_n: int = 20) -> DataFrame:
    """The top ``top_n`` rows of the report table (scores to 3 dp)."""
    top = priorities.orderBy(*ranking_order()).limit(top_n)
    w = Window.orderBy(*ranking_order())
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), KEY,
                      F.round("priority_score", 3).alias("priority"),
                      F.round("failure_probability", 3).alias("failure_prob"), "reason")


def short_name(test_id: Column) -> Column:
    return F.element_at(F.split(test_id, "::"), -1)


def top_tests(priorities: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` tests with short names."""
    top = priorities.orderBy(*ranking_order()).limit(n)
    w = Window.orderBy(*ranking_order())
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"),
                      short_name(F.col(KEY)).alias("test_short"), "priority_score")


def collected_filter(collected: DataFrame, selected: DataFrame, id_col: str = "test_id") -> DataFrame:
    """Keep a collected id when it ends with a selected test's last part."""
    from suitewise.operators.joins import endswith_flag
    parts = selected.select(short_name(F.col(KEY)).alias("suffix")).distinct()
    return endswith_flag(collected.select(id_col), id_col, parts, "suffix", "kept")


def collected_summary(flags: DataFrame) -> DataFrame:
    """H13 totals: kept, skipped, reduction %."""
    return flags.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"),
                     (F.count_if(~F.col("kept")).cast("double") / F.count(F.lit(1)).cast("double") * 100.0)
                     .alias("reduction_percentage"))


def priority_expr(prob: Column, imp: Column, rate: Column, recent: Column) -> Column:
    """H1 score from its four factors (same evaluation order everywhere)."""
    return (prob * F.lit(W_PROBABILITY) + imp * F.lit(W_IMPACT) + rate * F.lit(W_RATE)
            + recent_share(recent) * F.lit(W_RECENT))


def scenario_comparison(history: DataFrame, probabilities: DataFrame, scenario_impact: DataFrame,
                        scenarios: DataFrame, min_tests: int = 5, max_tests: int = 100,
                        min_score: float = DEFAULT_MIN_SCORE, scenario: str = "scenario_id") -> DataFrame:
    """Selection size and reduction per change scenario, plus an 'Average' row.

    Without a time budget the selected set is the first min_tests tests plus
    every test scoring >= min_score up to max_tests, so its size is
    least(total, greatest(min, least(max, n_ge))) with n_ge the number of tests
    at or above the threshold. n_ge per scenario = the count at impact 0 plus a
    correction over the tests that scenario impacts: no tests x scenarios
    product is built, and only impacted (scenario, test) pairs are scored.
    """
    comp = (per_test_features(history).select(KEY, "historical_failure_rate", "recent_failures")
            .join(probabilities.select(KEY, F.col("failure_probability").alias("prob")), KEY, "left")
            .withColumn("test_file", test_file_of(F.col(KEY))))
    prob = F.coalesce(F.col("prob"), F.lit(0.0))
    rate, recent = F.col("historical_failure_rate"), F.col("recent_failures")
    base_score = priority_expr(prob, F.lit(0.0), rate, recent)
    base = comp.agg(F.count(F.lit(1)).alias("total_tests"),
                    F.count_if(base_score >= F.lit(min_score)).alias("n_ge_base"))
    adj = priority_expr(prob, F.col("impact"), rate, recent)
    delta = (scenario_impact.join(comp, "test_file")
             .groupBy(scenario).agg((F.count_if(adj >= F.lit(min_score))
                                     - F.count_if(base_score >= F.lit(min_score))).alias("delta")))
    per = (scenarios.select(scenario).distinct().join(delta, scenario, "left")
           .withColumn("_one", F.lit(1))
           .join(F.broadcast(base.withColumn("_one", F.lit(1))), "_one"))
    n_ge = F.col("n_ge_base") + F.coalesce(F.col("delta"), F.lit(0))
    selected = F.least(F.col("total_tests"), F.greatest(F.lit(min_tests), F.least(F.lit(max_tests), n_ge)))
    rows = per.select(F.col(scenario).cast("string").alias("scenario"), "total_tests",
                      selected.cast("double").alias("selected"),
                      ((F.lit(1.0) - F.try_divide(selected.cast("double"), F.col("total_tests").cast("double")))
                       * 100.0).alias("reduction"))
    avg = rows.agg(F.lit("Average").alias("scenario"), F.lit(None).cast("bigint").alias("total_tests"),
                   F.avg("selected").alias("selected"), F.avg("reduction").alias("reduction"))
    return rows.unionByName(avg)


def scenario_selections(history: DataFrame, probabilities: DataFrame, scenario_impact: DataFrame, scenarios: DataFrame,
                        min_tests: int = 5, max_tests: int = 100, min_score: float = DEFAULT_MIN_SCORE,
                        time_budget: float | None = None, scenario: str = "scenario_id") -> DataFrame:
    """The tests each change scenario selects, with rank and score; optionally under a time budget.

    Impact only raises a score, so a test that a scenario does not touch and that is not among the first k of the
    shared ranking at impact 0 (k = max(min_tests, max_tests)) has k tests before it in every scenario. So a scenario's
    first k are merged from the k shared rows and the first k of its own impacted tests: no tests x scenarios rows,
    at most 2 k rows a scenario. The running time is taken over these, and the rule of ``select_tests`` applied.
    """
    k = max(min_tests, max_tests)
    comp = (per_test_features(history).select(KEY, "historical_failure_rate", "recent_failures",
                                              F.col("avg_execution_time").alias("execution_time"))
            .join(probabilities.select(KEY, F.col("failure_probability").alias("prob")), KEY, "left")
            .withColumn("test_file", test_file_of(F.col(KEY))))
    prob = F.coalesce(F.col("prob"), F.lit(0.0))
    rate, recent = F.col("historical_failure_rate"), F.col("recent_failures")
    shared = (comp.select(KEY, priority_expr(prob, F.lit(0.0), rate, recent).alias("priority_score"), "execution_time")
              .orderBy(*ranking_order()).limit(k).withColumn("_one", F.lit(1)))
    touched = scenario_impact.join(comp, "test_file").select(
        scenario, KEY, priority_expr(prob, F.col("impact"), rate, recent).alias("priority_score"), "execution_time")
    per_scenario = Window.partitionBy(scenario).orderBy(*ranking_order())
    own = touched.withColumn("_n", F.row_number().over(per_scenario)).where(F.col("_n") <= k).drop("_n")
    others = (scenarios.select(scenario).distinct().withColumn("_one", F.lit(1)).join(F.broadcast(shared), "_one").drop("_one")
              .join(touched.select(scenario, KEY), [scenario, KEY], "left_anti"))  # at most k shared rows
    merged = own.unionByName(others).select(
        "*", F.row_number().over(per_scenario).cast("bigint").alias("rank"),
        F.sum("execution_time").over(per_scenario.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_time"))
    keep = (F.col("rank") <= max_tests) & (F.col("priority_score") >= F.lit(min_score))
    if time_budget:
        keep = keep & (F.col("cum_time") <= F.lit(float(time_budget)))
    return merged.where((F.col("rank") <= min_tests) | keep).select(
        F.col(scenario).cast("string").alias("scenario"), "rank", KEY, "priority_score")


def selection_backtest(history: DataFrame, impact: DataFrame, probability_fn,
                       min_tests: int = 5, max_tests: int = 100,
                       min_score: float = DEFAULT_MIN_SCORE) -> DataFrame:
    """Select with the history before the latest run, judge against that run.

    ``probability_fn(history) -> (full_test_name, failure_probability)``.
    Reports tests run, failing tests, how many of them the selection caught
    or missed, recall, and run time of the whole run versus the selection.
    """
    last = history.agg(F.max("run_id").alias("_eval_run")).withColumn("_one", F.lit(1))
    h = history.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").drop("_one")
    past = h.where(F.col("run_id") < F.col("_eval_run")).drop("_eval_run")
    nxt = h.where(F.col("run_id") == F.col("_eval_run"))
    sel = (select_tests(priority_scores(past, probability_fn(past), impact), min_tests, max_tests, min_score)
           .select(KEY, F.lit(True).alias("sel")))
    outcome = nxt.groupBy(KEY).agg((F.count_if(~F.col("passed")) > 0).alias("failed"),
                                   F.sum("execution_time").alias("t"))
    j = outcome.join(sel, KEY, "left").withColumn("sel", F.coalesce("sel", F.lit(False)))
    s, f = F.col("sel"), F.col("failed")
    a = j.agg(F.count(F.lit(1)).alias("tests_run"), F.count_if(f).alias("failing_tests"),
              F.count_if(s).alias("selected_run"), F.count_if(s & f).alias("caught"),
              F.count_if(~s & f).alias("missed"),
              F.sum("t").cast("double").alias("time_all"),
              F.coalesce(F.sum(F.when(s, F.col("t"))), F.lit(0)).cast("double").alias("time_selected"))
    return a.select("*", F.try_divide(F.col("caught").cast("double"), F.col("failing_tests").cast("double"))
                    .alias("recall"), (F.col("time_all") - F.col("time_selected")).alias("time_saved"))


def gate_on_changes(selection: DataFrame, detected: DataFrame) -> DataFrame:
    """With auto-detected changes, no detected change means no selection.

    The "any change?" flag is a one-row aggregate joined on a constant key
    (broadcast, one row by construction); an explicit change list skips this gate.
    """
    flag = detected.agg((F.count(F.lit(1)) > 0).alias("_any")).withColumn("_one", F.lit(1))
    j = selection.withColumn("_one", F.lit(1)).join(F.broadcast(flag), "_one")
    return j.where(F.col("_any")).drop("_one", "_any")
