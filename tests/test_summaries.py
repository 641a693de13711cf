"""Summaries of a test's history (S6): built from one pass of the large aggregate."""

from suitewise.operators import features as E
from suitewise.operators import summaries as S


def test_summaries_read_the_aggregate_they_have_written(spark, make_history):
    h = make_history({"t.py::a": [True, False, True] * 5, "t.py::b": [False] * 4, "t.py::c": [True]})
    s = S.summarise(h)
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "var_pop" not in plan and "stddev_samp" not in plan
    got = {r[E.KEY]: r for r in S.features_of(s).collect()}
    want = {r[E.KEY]: r for r in E.serving_features(h).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert [r[c] for c in E.FEATURE_NAMES] == [want[k][c] for c in E.FEATURE_NAMES]
