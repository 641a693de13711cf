"""Sources and sinks: history round trip, selected-tests text, Markdown report."""

import glob
import tempfile

import pytest

from suitewise.operators import selection as H
from suitewise.sources import history as A


def _tmp():
    return tempfile.mkdtemp(prefix="suitewise-sink-", dir="/tmp")


def test_history_round_trip_parquet_and_csv(spark, make_history):
    h = make_history({"tests/test_a.py::t1": [True, False, True], "tests/test_b.py::t2": [False]})
    for fmt in ("parquet", "csv"):
        path = _tmp() + "/history"
        A.write_history(h, path, fmt=fmt)
        back = A.read_history(spark, path, fmt=fmt)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, h.collect()))
    assert A.read_history(spark, _tmp() + "/missing") is None


def test_selected_and_report_sinks(spark):
    prio = spark.createDataFrame([(f"tests/t.py::c{i}", 0.1 * i, 0.05 * i, 1.0, 0, 0, "General testing")
                                  for i in range(10)],
                                 "full_test_name string, priority_score double, failure_probability double, "
                                 "execution_time double, recent_failures bigint, lines_changed bigint, reason string")
    sel = H.select_tests(prio, 2, 5)
    out = _tmp() + "/selected"
    A.write_selected(sel, out)
    lines = open(glob.glob(out + "/part-*")[0]).read().splitlines()
    assert lines == [r["full_test_name"] for r in sel.orderBy("rank").collect()]
    rep = _tmp() + "/report"
    A.write_report(prio, rep, top_n=3)
    text = open(glob.glob(rep + "/part-*")[0]).read().splitlines()
    # 0.1 * 7 is just above 0.7 in binary, so 7, 8, 9 are high; 3..6 medium
    assert text[2] == "10 tests scored; 3 above the high tier, 4 between the tiers, 3 below."
    assert text[-3] == "| 1 | 0.900 | 0.450 | `tests/t.py::c9` | General testing |"
    assert len(text) == 8 + 3


def test_history_by_name(spark):
    path = _tmp() + "/h"
    head = ("test_name,timestamp,run_id,test_file,full_test_name,source_file,passed,execution_time,coverage,"
            "lines_changed,functions_changed,files_changed,is_flaky").split(",")
    row = ["t1", "2024-01-01 00:00:00", "3", "tests/a.py", "tests/a.py::t1", "src/a.py", "True", "1.234", "0.875", "2",
           "1", "src/a.py", "False"]
    spark.createDataFrame([row], head).write.option("header", True).csv(path)
    r = A.read_history(spark, path, fmt="csv").first()
    assert (r["test_file"], r["passed"], r["run_id"], str(r["execution_time"]), str(r["coverage"])) == (
        "tests/a.py", True, 3, "1.234", "0.875")
    spark.createDataFrame([row[1:]], head[1:]).write.option("header", True).csv(path + "2")
    with pytest.raises(ValueError, match="test_name"):
        A.read_history(spark, path + "2", fmt="csv")
