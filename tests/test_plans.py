"""Plan shape: the properties the scale design relies on, read from executed plans."""

import re

import __spark_entry__ as entry
from conftest import SF_SMALL


def _executed(df) -> str:
    """The final adaptive plan (the text also repeats the initial plan; drop it)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _windows_partitioned_by(plan: str, column: str) -> int:
    return len(re.findall(rf"windowspecdefinition\({column}#", plan))


def test_sequence_operators_have_no_per_key_window(spark):
    q = entry.queries()
    for name in ("rate_check", "login_lockout", "session_validity"):
        plan = _executed(q[name](spark, SF_SMALL))
        assert _windows_partitioned_by(plan, "user_id") == 0, name
        assert _windows_partitioned_by(plan, "_range") > 0, name


def test_features_use_no_window_over_a_whole_test(spark):
    q = entry.queries()
    for name in ("rolling_failures", "point_in_time_features"):
        plan = _executed(q[name](spark, SF_SMALL))
        assert _windows_partitioned_by(plan, "full_test_name") == 0, name
    # the only per-test window left is the last-10 ranking, cut down before the shuffle
    plan = _executed(q["serving_features"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_flagship_plan_is_bounded(spark):
    plan = _executed(entry.entry(spark))
    assert "TakeOrderedAndProject" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    shuffles = len(re.findall(r"\+- Exchange (hashpartitioning|rangepartitioning)", plan))
    assert shuffles <= 16, shuffles
