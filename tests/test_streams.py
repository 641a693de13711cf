"""Streaming = batch on the same rows, with the events split over several files
so that state really crosses micro-batches."""

import datetime as dt
import itertools
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from suitewise.operators import features as E
from suitewise.operators import sequences as L
from suitewise.sources.fixtures import test_history_from_events as history_from_events
from suitewise.sources.tables import read_table
from suitewise.streaming import streams as S


@pytest.fixture(scope="module")
def event_folder(spark):
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    table = pq.read_table(f"{SF_SMALL}/events.parquet")
    table = table.sort_by([("ts", "ascending"), ("event_id", "ascending")])
    folder = tempfile.mkdtemp(prefix="suitewise-stream-", dir="/tmp")
    n = table.num_rows
    # four files in time order: each micro-batch continues the state of the previous one
    for p in range(4):
        pq.write_table(table.slice(p * n // 4, (p + 1) * n // 4 - p * n // 4), f"{folder}/events_{p}.parquet")
        os.utime(f"{folder}/events_{p}.parquet", (1000 + p, 1000 + p))
    assert pc.sum(pc.is_valid(table["event_id"])).as_py() == n
    return folder, read_table(spark, SF_SMALL, "events")


def _rows(df, key):
    return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}


def test_running_stats_match_batch(spark, event_folder):
    folder, ev = event_folder
    got = _rows(S.run_to_table(S.running_test_stats(S.history_stream(spark, folder)), "t1", "update",
                               [E.KEY]), [E.KEY])
    want = _rows(E.per_test_features(history_from_events(ev)), [E.KEY])
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v["n"] == want[k]["test_age"]
        assert v["historical_failure_rate"] == want[k]["historical_failure_rate"]
        assert v["avg_execution_time"] == want[k]["avg_execution_time"]


def test_streak_matches_batch(spark, event_folder):
    folder, ev = event_folder
    end = S.closing_folder(spark)
    got = _rows(S.run_to_table(S.live_streak(S.history_stream(spark, folder, closing=end)), "t2", "update", [E.KEY], end),
                [E.KEY])
    want = _rows(E.per_test_features(history_from_events(ev)), [E.KEY])
    assert {k: (v["failure_streak"], v["time_since_last_failure"]) for k, v in got.items()} == \
        {k: (v["failure_streak"], v["time_since_last_failure"]) for k, v in want.items()}
    assert all(v["late_rows"] == 0 for v in got.values())


def _drained(spark, folder, operator, *args, **kw):
    end = S.closing_folder(spark)
    return S.run_to_table(operator(S.event_stream(spark, folder, closing=end), *args, **kw), "d", "append", closing=end)


def test_lockout_and_admission_match_batch(spark, event_folder):
    folder, ev = event_folder
    lock = _drained(spark, folder, S.stream_lockout)
    assert _rows(lock, ["event_id"]) == _rows(L.login_lockout(ev, "user_id"), ["event_id"])
    adm = _drained(spark, folder, S.stream_rate_admit, 5, 2 * 24 * 3600)
    want = L.rate_admit(ev, "user_id", 5, 2 * 24 * 3600)
    assert _rows(adm, ["event_id"]) == _rows(want, ["event_id"])


T0 = dt.datetime(2024, 1, 1)


def _write_events(folder, files):
    """Files of (event_id, hour, user, kind), picked up in the order given."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    for i, rows in enumerate(files):
        ids, hours, users, kinds = zip(*rows)
        n = len(rows)
        pq.write_table(pa.table({
            "event_id": pa.array(ids, pa.int64()),
            "ts": pa.array([T0 + dt.timedelta(hours=h) for h in hours], pa.timestamp("us")),
            "user_id": pa.array(users, pa.int64()), "event_type": pa.array(kinds), "value": pa.array([1.0] * n),
            "props": pa.array(['{"k": 1}'] * n)}), f"{folder}/events_{i}.parquet")
        os.utime(f"{folder}/events_{i}.parquet", (1000 + i, 1000 + i))


PARTS = [[(10 * p + i, 6 * p + i, (p + i) % 2, ("error", "error", "click", "signup", "error")[(p * 2 + i) % 5])
          for i in range(6)] for p in range(4)]


@pytest.mark.parametrize("order", [o for i, o in enumerate(itertools.permutations(range(4))) if i % 8 == 7])
def test_order_of_files_does_not_matter(spark, order):
    folder = tempfile.mkdtemp(prefix="suitewise-order-", dir="/tmp")
    _write_events(folder, [PARTS[p] for p in order])
    ev = spark.read.schema(S.EVENTS_SCHEMA).parquet(folder)
    lock = _drained(spark, folder, S.stream_lockout)
    assert _rows(lock, ["event_id"]) == _rows(L.login_lockout(ev, "user_id"), ["event_id"])


def test_order_of_files_does_not_matter_to_streaks_and_admission(spark):
    folder = tempfile.mkdtemp(prefix="suitewise-order-", dir="/tmp")
    _write_events(folder, [PARTS[p] for p in (2, 0, 3, 1)])
    ev = spark.read.schema(S.EVENTS_SCHEMA).parquet(folder)
    adm = _drained(spark, folder, S.stream_rate_admit, 2, 3 * 3600)
    assert _rows(adm, ["event_id"]) == _rows(L.rate_admit(ev, "user_id", 2, 3 * 3600), ["event_id"])
    end = S.closing_folder(spark)
    got = S.run_to_table(S.live_streak(S.history_stream(spark, folder, closing=end)), "o", "update", [E.KEY], end)
    want = _rows(E.per_test_features(history_from_events(ev)), [E.KEY])
    assert {k: (v["failure_streak"], v["time_since_last_failure"], v["late_rows"]) for k, v in _rows(got, [E.KEY]).items()} == \
        {k: (v["failure_streak"], v["time_since_last_failure"], 0) for k, v in want.items()}


def test_rows_behind_the_watermark_are_marked(spark):
    """Three files: hours 48 and 50, then 10 and 49 (10 is late by a day and more), then 47 and 51 (in time)."""
    folder = tempfile.mkdtemp(prefix="suitewise-late-", dir="/tmp")
    _write_events(folder, [[(1, 48, 7, "error"), (2, 50, 7, "error")], [(3, 10, 7, "error"), (4, 49, 7, "error")],
                           [(5, 47, 7, "signup"), (6, 51, 7, "click")]])
    lock = {r["event_id"]: r["outcome"] for r in _drained(spark, folder, S.stream_lockout).collect()}
    assert lock == {3: "late", 5: "reset", 1: "wrong", 4: "wrong", 2: "wrong", 6: "locked"}
    adm = {r["event_id"]: r["admitted"] for r in _drained(spark, folder, S.stream_rate_admit, 2, 2 * 3600).collect()}
    assert adm == {3: None, 5: True, 1: True, 4: True, 2: True, 6: True}
    end = S.closing_folder(spark)
    r, = S.run_to_table(S.live_streak(S.history_stream(spark, folder, closing=end)), "late", "update", [E.KEY], end).collect()
    assert (r["failure_streak"], r["time_since_last_failure"], r["late_rows"]) == (0, 1, 1)


def test_daily_counts_and_late_rows_add_up(spark):
    folder = tempfile.mkdtemp(prefix="suitewise-daily-", dir="/tmp")
    _write_events(folder, [[(1, 60, 7, "error"), (2, 61, 7, "click")], [(3, 10, 7, "error"), (4, 30, 7, "error")],
                           [(5, 100, 7, "click")], [(6, 50, 7, "error"), (7, 70, 7, "click"), (8, 73, 7, "click")]])
    got = {r["day"]: (r["runs"], r["failures"], r["late_rows"])
           for r in S.daily_failures_with_late(S.history_stream(spark, folder), "daily").collect()}
    # behind hour 61 less a day: day 1; behind hour 100 less a day: day 3 (its end is hour 72), not day 4
    assert got == {"2024-01-01": (0, 0, 1), "2024-01-02": (1, 1, 0), "2024-01-03": (2, 1, 2), "2024-01-04": (1, 0, 0),
                   "2024-01-05": (1, 0, 0)}


def test_daily_failures_match_batch(spark, event_folder):
    folder, ev = event_folder
    got = _rows(S.run_to_table(S.daily_failures(S.history_stream(spark, folder)), "t5", "update",
                               ["day", "test_file"]), ["day", "test_file"])
    h = history_from_events(ev)
    want = _rows(h.groupBy(F.date_format("run_ts", "yyyy-MM-dd").alias("day"), "test_file").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("passed")).alias("failures")), ["day", "test_file"])
    assert got == want


class _Counting:
    """Stands for a model: the score is a fixed sum of all features, so that any wrong feature shows."""

    @staticmethod
    def score(features):
        return features.select(E.KEY, sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * (i + 1)
                                          for i, c in enumerate(E.FEATURE_NAMES)).alias("failure_probability"))


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 0, 3, 1)])
def test_scores_by_batch_equal_the_whole_history_and_survive_a_replay(spark, event_folder, monkeypatch, order):
    from suitewise.operators import modeling
    monkeypatch.setattr(modeling, "failure_probability", lambda model, features: model.score(features))
    folder, ev = event_folder
    base = tempfile.mkdtemp(prefix="suitewise-scores-", dir="/tmp")
    files = [spark.read.schema(S.EVENTS_SCHEMA).parquet(f"{folder}/events_{p}.parquet") for p in order]

    def scores():
        s = spark.read.parquet(f"{base}/scores")
        return _rows(s.groupBy(E.KEY).agg(F.max_by("failure_probability", "_batch").alias("p")), [E.KEY])

    for i, rows in enumerate(files):
        S.score_batch(rows, i, _Counting, base)
    got = scores()
    want = _rows(_Counting.score(E.serving_features(history_from_events(ev))), [E.KEY])
    assert got.keys() == want.keys()
    assert all(v["p"] == pytest.approx(want[k]["failure_probability"], rel=1e-9) for k, v in got.items())
    S.score_batch(files[-1], 3, _Counting, base)
    assert scores() == got
    assert spark.read.parquet(f"{base}/history").count() == ev.count()


def test_scores_in_time_order_read_no_history_again(spark, event_folder, monkeypatch):
    from suitewise.operators import modeling
    monkeypatch.setattr(modeling, "failure_probability", lambda model, features: model.score(features))
    folder, _ = event_folder
    base = tempfile.mkdtemp(prefix="suitewise-scores-", dir="/tmp")
    files = [spark.read.schema(S.EVENTS_SCHEMA).parquet(f"{folder}/events_{p}.parquet") for p in range(2)]
    S.score_batch(files[0], 0, _Counting, base)
    first = spark.read.parquet(f"{base}/history/_batch=0")
    spark.createDataFrame([], first.schema).write.mode("overwrite").parquet(f"{base}/history/_batch=0")  # emptied
    S.score_batch(files[1], 1, _Counting, base)
    n = F.sum("n")
    assert spark.read.parquet(f"{base}/summaries/_batch=1").agg(n).first()[0] == files[0].count() + files[1].count()


class _Kept:
    """A list or value state that counts what is in it."""

    def __init__(self, *_):
        self.clear()

    def clear(self):
        self.elements, self.value = [], None

    def appendList(self, elements):
        self.elements += elements

    def put(self, elements):
        self.elements = list(elements)

    def update(self, value):
        self.value = value

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.elements) if self.elements else self.value


class _Handle:
    def __init__(self):
        self.timers = set()

    getListState = getValueState = lambda self, *a: _Kept()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_events_are_kept_many_to_an_element():
    p, h = S._Admission(10_000, 1), _Handle()
    p.init(h)
    row = S.Row("user_id", "us", "id", "kind")
    events = [(5_000 + (i * 7_919) % 5_000, i) for i in range(2_500)]
    assert list(p.handleInputRows((1,), iter([row(1, us, i, "") for us, i in events]), _Watermark(0))) == []
    assert len(p.waiting.elements) <= 3 and h.timers == {6}
    got = [r["event_id"] for r in p.handleExpiredTimer((1,), _Watermark(8), None)]
    assert got == [i for us, i in sorted(events) if us < 8_000]
    assert len(p.waiting.elements) <= 2 and 9 in h.timers  # the first of the rest stands at 8,000 us
    assert list(p.handleInputRows((1,), iter([row(1, 7_999, 9_999, "")]), _Watermark(8)))[0]["admitted"] is None
    h.timers.clear()  # an expired timer is gone
    got += [r["event_id"] for r in p.handleExpiredTimer((1,), _Watermark(99), None)]
    assert got == [i for us, i in sorted(events)] and not p.waiting.elements and not h.timers
