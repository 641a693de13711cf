"""Prioritisation and selection: greedy loop vs prefix rule, reasons, new tests, traps T7, T9, T17, T19."""

import random

import pytest
from pyspark.sql import functions as F

from suitewise.operators import selection as H

PRIO_SCHEMA = ("full_test_name string, priority_score double, failure_probability double, "
               "execution_time double, recent_failures bigint, lines_changed bigint, reason string")


def greedy(rows, min_tests, max_tests, budget, min_score=0.3):
    """The reference's loop, written out as the independent check."""
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    sel, total = [], 0.0
    for i, r in enumerate(ordered):
        if i < min_tests:
            sel.append(r[0])
            total += r[3]
            continue
        if len(sel) >= max_tests:
            break
        if budget and total + r[3] > budget:
            break
        if r[1] >= min_score:
            sel.append(r[0])
            total += r[3]
    return sel


@pytest.mark.parametrize("seed", range(6))
def test_window_selection_equals_greedy_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"t{i:03d}", round(rnd.random() * 0.8, rnd.choice([1, 2, 6])), 0.1, round(rnd.random() * 5, 2), 0, 0, "x")
            for i in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(rows, PRIO_SCHEMA)
    for mn, mx, budget in [(5, 100, None), (5, 10, None), (12, 4, None), (3, 50, 20.0), (0, 30, 7.5), (5, 100, 0)]:
        got = [r["full_test_name"] for r in H.select_tests(df, mn, mx, time_budget=budget).orderBy("rank").collect()]
        assert got == greedy(rows, mn, mx, budget), (mn, mx, budget)


def test_budget_zero_means_no_budget(spark):
    # 0 counts as "no budget"
    df = spark.createDataFrame([(f"t{i}", 0.9, 0.1, 100.0, 0, 0, "x") for i in range(8)], PRIO_SCHEMA)
    assert H.select_tests(df, 1, 100, time_budget=0).count() == 8
    assert H.select_tests(df, 1, 100, time_budget=250.0).count() == 2


def test_min_score_is_a_parameter(spark):
    # The cut is a real parameter (default 0.3)
    df = spark.createDataFrame([(f"t{i}", 0.1 * i, 0.1, 1.0, 0, 0, "x") for i in range(10)], PRIO_SCHEMA)
    assert H.select_tests(df, 0, 100).count() == 7            # 0.1*3 is just above 0.3 in binary: 7 tests
    assert H.select_tests(df, 0, 100, min_score=0.55).count() == 4


def test_ties_break_on_name(spark):
    # T19
    df = spark.createDataFrame([("b", 0.5, 0.1, 1.0, 0, 0, "x"), ("a", 0.5, 0.1, 1.0, 0, 0, "x")], PRIO_SCHEMA)
    assert [r[0] for r in H.select_tests(df, 1, 1).select("full_test_name").collect()] == ["a"]


def test_reason_first_factor_wins_ties(spark):
    df = spark.createDataFrame([(0.6, 0.6, 0.1, 0), (0.2, 1.0, 0.1, 0), (0.1, 0.0, 0.7, 0), (0.1, 0.0, 0.1, 5),
                                (0.5, 0.5, 0.5, 2)], "p double, i double, r double, n bigint")
    got = [x[0] for x in df.select(H.priority_reason(F.col("p"), F.col("i"), F.col("r"), F.col("n"))).collect()]
    assert got == ["High failure risk", "Code changes", "Historical failures", "Recent failures", "General testing"]


def test_priority_formula_and_new_tests(spark, make_history):
    h = make_history({"tests/test_a.py::t1": [False, True, False, True]})   # rate .5, recent 2
    probs = spark.createDataFrame([("tests/test_a.py::t1", 0.5), ("tests/test_a.py::n1", 0.9)],
                                  "full_test_name string, failure_probability double")
    imp = spark.createDataFrame([("tests/test_a.py", 1.0)], "test_file string, impact double")
    cand = spark.createDataFrame([("tests/test_a.py::t1",), ("tests/test_a.py::n1",), ("tests/test_a.py::n2",)],
                                 "full_test_name string")
    p = {r[0]: r for r in H.priority_scores(h, probs, imp, cand).collect()}
    assert p["tests/test_a.py::t1"]["priority_score"] == pytest.approx(0.4 * 0.5 + 0.3 + 0.15 * 0.5 + 0.15 * 0.4)
    assert p["tests/test_a.py::t1"]["reason"] == "Code changes"
    assert (p["tests/test_a.py::n1"]["priority_score"], p["tests/test_a.py::n1"]["failure_probability"]) == (0.5, 0.9)
    assert (p["tests/test_a.py::n2"]["failure_probability"], p["tests/test_a.py::n2"]["execution_time"]) == (0.5, 0.1)
    assert p["tests/test_a.py::n2"]["reason"] == "New test"


def test_summary_of_empty_list_is_null_not_error(spark):
    # T17
    empty = spark.createDataFrame([], PRIO_SCHEMA)
    r = H.selection_summary(empty, H.select_tests(empty)).collect()[0]
    assert r["total_tests"] == 0 and r["reduction_percentage"] is None


def test_selection_plan_is_a_bounded_top_k(spark):
    df = spark.createDataFrame([(f"t{i}", 0.5, 0.1, 1.0, 0, 0, "x") for i in range(20)], PRIO_SCHEMA)
    plan = H.select_tests(df, 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_collected_filter_by_suffix(spark):
    collected = spark.createDataFrame([("a/test_x.py::test_login",), ("b/test_y.py::test_logout",),
                                       ("c/test_z.py::test_other",)], "test_id string")
    selected = spark.createDataFrame([("tests/test_q.py::test_login",), ("tests/t.py::t::out",)], "full_test_name string")
    got = {r[0]: r[1] for r in H.collected_filter(collected, selected).collect()}
    # ends with 'test_login' and with 'out' (last part after '::')
    assert got == {"a/test_x.py::test_login": True, "b/test_y.py::test_logout": True, "c/test_z.py::test_other": False}


def test_no_detected_change_gives_empty_selection(spark):
    # Auto-detected and empty -> empty; detected -> the selection as is
    df = spark.createDataFrame([(f"t{i}", 0.9, 0.1, 1.0, 0, 0, "x") for i in range(6)], PRIO_SCHEMA)
    sel = H.select_tests(df, 2, 4)
    none = spark.createDataFrame([], "file_path string")
    some = spark.createDataFrame([("src/a.py",)], "file_path string")
    assert H.gate_on_changes(sel, none).count() == 0
    assert H.gate_on_changes(sel, some).count() == 4


def test_scenario_selections_equal_a_full_ranking_per_scenario(spark, make_history):
    import random
    rnd = random.Random(6)
    tests = {f"tests/m{i % 9}.py::t{i}": [rnd.random() < 0.7 for _ in range(rnd.randint(1, 12))] for i in range(60)}
    h = make_history(tests)
    probs = spark.createDataFrame([(t, rnd.random()) for t in list(tests)[::2]], "full_test_name string, failure_probability double")
    scenarios = spark.createDataFrame([(s, "f") for s in "ABC"], "scenario_id string, file_path string")
    impact = spark.createDataFrame([("A", f"tests/m{i}.py", 1.0) for i in range(9)] + [("B", "tests/m3.py", 0.5)],
                                   "scenario_id string, test_file string, impact double")
    for budget in (None, 2.5):
        got = {}
        for r in H.scenario_selections(h, probs, impact, scenarios, 3, 10, 0.2, budget).collect():
            got.setdefault(r["scenario"], []).append((r["rank"], r["full_test_name"], round(r["priority_score"], 9)))
        for s in "ABC":
            own = impact.where(f"scenario_id = '{s}'").select("test_file", "impact")
            sel = H.select_tests(H.priority_scores(h, probs, own), 3, 10, 0.2, budget)
            want = [(r["rank"], r["full_test_name"], round(r["priority_score"], 9)) for r in sel.collect()]
            assert sorted(got[s]) == sorted(want), (s, budget)
