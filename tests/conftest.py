import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from suitewise.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

HISTORY_SCHEMA = ("exec_id bigint, run_id bigint, run_ts timestamp_ntz, test_file string, test_name string, "
                  "full_test_name string, source_file string, passed boolean, execution_time decimal(12,2), "
                  "coverage decimal(4,2), lines_changed bigint, functions_changed bigint, "
                  "files_changed string, is_flaky boolean")


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


def history_rows(outcomes: dict[str, list[bool]], time=1.0, lines=0):
    """History rows: one execution per outcome, in order, per test id."""
    rows, eid = [], 0
    base = dt.datetime(2024, 1, 1)
    for test, seq in outcomes.items():
        file = test.split("::")[0] if "::" in test else "tests/test_x.py"
        for i, ok in enumerate(seq):
            rows.append((eid, i + 1, base + dt.timedelta(hours=i), file, test.split("::")[-1], test,
                         "src/x.py", ok, Decimal(str(time)), Decimal("0.80"), lines, 0, "src/x.py", False))
            eid += 1
    return rows


@pytest.fixture
def make_history(spark):
    def make(outcomes, **kw):
        return spark.createDataFrame(history_rows(outcomes, **kw), HISTORY_SCHEMA)
    return make
