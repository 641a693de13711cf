"""History features: traps T1, T2, T4, T5 and edge rows."""


from suitewise.operators import features as E


def _by_test(df):
    return {r["full_test_name"]: r.asDict() for r in df.collect()}


def test_streak_and_since_are_real_per_test_values(make_history):
    # The reference's train form loses these to index alignment; ours are per test
    h = make_history({"t::a": [True, False, False, False],      # streak 3, since 0
                      "t::b": [False, True, True],              # streak 0, since 2
                      "t::c": [True, True]})                    # never failed
    f = _by_test(E.per_test_features(h))
    assert (f["t::a"]["failure_streak"], f["t::a"]["time_since_last_failure"]) == (3, 0)
    assert (f["t::b"]["failure_streak"], f["t::b"]["time_since_last_failure"]) == (0, 2)
    assert (f["t::c"]["failure_streak"], f["t::c"]["time_since_last_failure"]) == (0, 999)


def test_since_uses_position_in_own_history(make_history):
    # Never negative, counted inside the test's own order
    h = make_history({"t::x": [True] * 5, "t::y": [False, True, True, True]})
    f = _by_test(E.per_test_features(h))
    assert f["t::y"]["time_since_last_failure"] == 3
    assert all(v["time_since_last_failure"] >= 0 for v in f.values())


def test_always_failed_streak_capped_at_ten(make_history):
    h = make_history({"t::z": [False] * 25})
    f = _by_test(E.per_test_features(h))["t::z"]
    assert f["failure_streak"] == 10 and f["recent_failures"] == 10
    assert f["historical_failure_rate"] == 1.0 and f["time_since_last_failure"] == 0


def test_single_row_has_zero_std(make_history):
    f = _by_test(E.per_test_features(make_history({"t::one": [True]})))["t::one"]
    assert f["execution_time_variance"] == 0.0 and f["test_age"] == 1


def test_lookback_keeps_latest_rows(make_history):
    h = make_history({"t::l": [False] * 5 + [True] * 50})
    full = _by_test(E.per_test_features(h))["t::l"]
    last50 = _by_test(E.per_test_features(h, lookback=50))["t::l"]
    assert full["test_age"] == 55 and last50["test_age"] == 50
    assert last50["historical_failure_rate"] == 0.0 and last50["time_since_last_failure"] == 999


def test_train_form_test_age_and_row_coupling(make_history):
    # T5 (run_id - first run_id) and T3 (row coupling contains the label)
    h = make_history({"t::a": [True, False, True]}, lines=5)
    m = E.feature_matrix(h).orderBy("exec_id").collect()
    assert [r["test_age"] for r in m] == [0, 1, 2]
    assert [r["test_coupling"] for r in m] == [0.0, 1.0, 0.0]


def test_point_in_time_sees_only_earlier_rows(make_history):
    # T4: the point-in-time form ends one row earlier; first row gets defaults
    h = make_history({"t::p": [False, True, False, True]})
    rows = E.point_in_time_features(h).orderBy("exec_id").collect()
    assert rows[0]["historical_failure_rate"] == 0.05 and rows[0]["time_since_last_failure"] == 999
    assert rows[1]["historical_failure_rate"] == 1.0 and rows[1]["failure_streak"] == 1
    assert rows[2]["time_since_last_failure"] == 1 and rows[2]["failure_streak"] == 0
    assert rows[3]["recent_failures"] == 2 and rows[3]["test_age"] == 3


def test_rolling_failures_window(make_history):
    h = make_history({"t::r": [False] * 12})
    vals = [r["rolling_failures"] for r in E.rolling_failures(h).orderBy("exec_id").collect()]
    assert vals == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 10]


def test_defaults_for_new_tests(spark, make_history):
    h = make_history({"tests/test_a.py::t1": [True, False]})
    cand = spark.createDataFrame([("tests/test_a.py::t1",), ("tests/test_a.py::new",)], "full_test_name string")
    changes = spark.createDataFrame([("tests/test_a.py", 7, 2)], "test_file string, lines_changed long, functions_changed long")
    f = _by_test(E.default_features(cand, h, changes))
    new = f["tests/test_a.py::new"]
    assert new["has_history"] is False
    assert (new["historical_failure_rate"], new["avg_execution_time"], new["coverage"]) == (0.05, 0.1, 0.8)
    assert (new["lines_changed"], new["functions_changed"], new["time_since_last_failure"]) == (7, 2, 999)
    assert f["tests/test_a.py::t1"]["lines_changed"] == 7


def test_feature_plan_keeps_rows_per_test_bounded(make_history):
    # last-10 features: row_number <= 10 is planned as a WindowGroupLimit before the exchange
    plan = E.recent_stats(make_history({"t::q": [True] * 30}))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_point_in_time_equals_row_by_row_recomputation(spark):
    import math

    from conftest import SF_SMALL
    from suitewise.sources import fixtures as X
    h = X.model_history(spark, SF_SMALL)
    got = E.point_in_time_features(h).toPandas().set_index("exec_id")
    pdf = h.toPandas().sort_values(["full_test_name", "run_ts", "exec_id"])
    for _, g in pdf.groupby("full_test_name"):
        g = g.reset_index(drop=True)
        for i in range(len(g)):
            prior, r = g.iloc[:i], got.loc[g.loc[i, "exec_id"]]
            fails = (~prior["passed"]).astype(int).tolist()
            want = {
                "historical_failure_rate": sum(fails) / i if i else 0.05,
                "recent_failures": sum(fails[-10:]),
                "avg_execution_time": float(prior["execution_time"].astype(float).mean()) if i else 0.1,
                "execution_time_variance": float(prior["execution_time"].astype(float).std()) if i > 1 else 0.0,
                "test_age": i,
                "failure_streak": next((k for k, v in enumerate(reversed(fails[-10:])) if v == 0), min(i, 10)),
                "time_since_last_failure": (i - 1 - max(k for k, v in enumerate(fails) if v)) if any(fails) else 999,
            }
            for k, v in want.items():
                assert math.isclose(float(r[k]), float(v), rel_tol=1e-9, abs_tol=1e-9), (k, i)
