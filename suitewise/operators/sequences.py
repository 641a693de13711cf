"""Event-sequence operators (family L): rate limiting, lockout, sessions.

Events are (key, ts, event_id, ...) rows; order inside a key is (ts,
event_id). L1, L3, L4 and L5 use no window partitioned by the key: they run
over one range-partitioned global order (``operators/ordered.py``), so a key
with a third of all events is still cut across many tasks, and every lookup is
an equi-join on a unique id or position. L2 is order dependent in a way no
prefix formula expresses (only admitted requests count); it is cut at gaps of a
whole window, where the state is empty, and streams each segment's sorted rows
through a small state machine in ``mapInPandas``, which holds one segment's
recent admissions at a time, never a whole group.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitewise.operators.ordered import running_totals

US_PER_SECOND = 1_000_000


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ (no session time zone involved)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def rate_check(events: DataFrame, key: str, max_requests: int, window_seconds: int) -> DataFrame:
    """L1 + L3: every request recorded; allowed if fewer than ``max_requests`` earlier ones are
    younger than the window (age exactly equal to the window has expired); wait time when not.

    No window partitioned by ``key``: real rows and one probe per row placed at
    ``t - window`` go into one global order (key, time, kind, id), range
    partitioned, so a key holding a third of all rows is split across tasks.
    With c(x) the running count of real rows, n_recent = c(row) - 1 - c(probe);
    the oldest request inside the window is the real row numbered c(probe) + 1.
    Both lookups are equi-joins on unique ids.
    """
    win = window_seconds * US_PER_SECOND
    e = events.select(key, "event_id", epoch_us(F.col("ts")).alias("us"))
    real = e.select(key, F.col("us").alias("_t"), F.lit(0).alias("_kind"), F.col("event_id").alias("_ref"),
                    F.lit(1).alias("_one"))
    probe = e.select(key, (F.col("us") - F.lit(win)).alias("_t"), F.lit(1).alias("_kind"),
                     F.col("event_id").alias("_ref"), F.lit(0).alias("_one"))
    c = running_totals(real.unionByName(probe), [F.col(key), F.col("_t"), F.col("_kind"), F.col("_ref")],
                       ["_one"])
    rows = c.where(F.col("_kind") == 0).select(key, F.col("_ref").alias("event_id"), F.col("_t").alias("us"),
                                                F.col("cum__one").alias("c_row"))
    probes = c.where(F.col("_kind") == 1).select(F.col("_ref").alias("event_id"), F.col("cum__one").alias("c_probe"))
    first_inside = rows.select(F.col("c_row").alias("c_next"), F.col("us").alias("oldest_us"))
    j = (rows.join(probes, "event_id")
         .join(first_inside, F.col("c_probe") + 1 == F.col("c_next"), "left"))
    n_recent = (F.col("c_row") - 1 - F.col("c_probe")).cast("bigint")
    allowed = n_recent < max_requests
    wait = F.when(allowed, F.lit(0.0)).otherwise(
        (F.lit(win) - (F.col("us") - F.col("oldest_us"))).cast("double") / F.lit(float(US_PER_SECOND)))
    return j.select(key, "event_id", n_recent.alias("n_recent"), allowed.alias("allowed"), wait.alias("wait_seconds"))


def _admit_batches(key: str, max_requests: int, win: int):
    def run(batches):
        current, admitted = object(), deque()
        for pdf in batches:
            keys, segments = pdf[key].tolist(), pdf["_segment"].tolist()
            uss, ids = pdf["us"].tolist(), pdf["event_id"].tolist()
            out = []
            for k, segment, us, eid in zip(keys, segments, uss, ids):
                if segment != current:
                    current, admitted = segment, deque()
                while admitted and us - admitted[0] >= win:
                    admitted.popleft()
                ok = len(admitted) < max_requests
                if ok:
                    admitted.append(us)
                out.append((k, eid, ok))
            yield pd.DataFrame(out, columns=[key, "event_id", "admitted"])
    return run


def rate_admit(events: DataFrame, key: str, max_requests: int, window_seconds: int,
               partitions: int | None = None) -> DataFrame:
    """L2: admission control; only admitted requests occupy the window.

    At a request that comes a whole window or more after the key's one before, nothing is left in the window:
    the state is empty, whatever was admitted. Requests are cut there into segments (numbered in one global order
    (key, time, id), without a window per key), and only a segment is sequential: segments, not keys, are dealt over
    the tasks. A segment of ``max_requests`` or fewer needs no state at all, so it is admitted whole.
    """
    win = window_seconds * US_PER_SECOND
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    e = events.select(key, "event_id", epoch_us(F.col("ts")).alias("us"))
    # every request also stands a window later as a mark that opens a segment if no request lies in between
    real = e.select(key, "us", F.lit(1).alias("_kind"), "event_id")
    marks = e.select(key, (F.col("us") + F.lit(win)).alias("us"), F.lit(0).alias("_kind"), "event_id")
    both = real.unionByName(marks).select(
        "*", (F.col("_kind") == 1).cast("int").alias("_real"), (F.col("_kind") == 0).cast("int").alias("_mark"))
    c = running_totals(both, [F.col(key), F.col("us"), F.col("_kind"), F.col("event_id")], ["_real", "_mark"])
    # in the order (key, time) all earlier requests of a row have expired when as many marks as requests precede it
    opened = c.where("_kind = 1").select(
        key, "us", "event_id", ((F.col("cum__real") - 1) == F.col("cum__mark")).cast("int").alias("_opens"))
    numbered = running_totals(opened, [F.col(key), F.col("us"), F.col("event_id")], ["_opens"]).select(
        key, "us", "event_id", F.col("cum__opens").alias("_segment"))
    sizes = numbered.groupBy("_segment").agg(F.count("*").alias("_size")).where(F.col("_size") > max_requests)
    schema = f"{key} {dict(events.dtypes)[key]}, event_id bigint, admitted boolean"
    full = (numbered.join(sizes.select("_segment"), "_segment", "left_semi")
            .repartition(n, "_segment").sortWithinPartitions("_segment", "us", "event_id")
            .mapInPandas(_admit_batches(key, max_requests, win), schema))
    free = numbered.join(sizes.select("_segment"), "_segment", "left_anti").select(
        key, "event_id", F.lit(True).alias("admitted"))
    return full.unionByName(free)


# Event roles of the lockout state machine (fixed values)
WRONG_PASSWORD, PASSWORD_RESET = "error", "signup"
MAX_ATTEMPTS = 3


def _with_start_markers(events: DataFrame, key: str, cols: dict) -> tuple[DataFrame, list[Column]]:
    """Real rows (kind 1) plus one start marker per key (kind 0, first in the key's order)."""
    ts_type = events.schema["ts"].dataType
    real = events.select(key, F.col("ts").alias("_t"), F.lit(1).alias("_kind"), "event_id", "event_type",
                         *[expr.alias(name) for name, (expr, _) in cols.items()])
    start = events.select(key).distinct().select(
        key, F.lit(None).cast(ts_type).alias("_t"), F.lit(0).alias("_kind"),
        F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("event_type"),
        *[F.lit(v).alias(name) for name, (_, v) in cols.items()])
    order = [F.col(key), F.col("_t").asc_nulls_first(), F.col("_kind"), F.col("event_id")]
    return real.unionByName(start), order


def login_lockout(events: DataFrame, key: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """L4: wrong logins lock after ``max_attempts`` in a row; locked refuses all; reset unlocks.

    Without a window per key: in one global order (key, ts, event_id) with a
    start marker per key acting as a reset, the streak of a wrong password is
    the wrong count since the last reset or right password (a segmented prefix
    sum, carried in the pass, without a join to the island's start). A second
    pass finds the last row that reached the limit; a row is locked when that
    row lies inside its own epoch.
    """
    is_reset = F.col("event_type") == PASSWORD_RESET
    is_wrong = F.col("event_type") == WRONG_PASSWORD
    u, order = _with_start_markers(events, key, {
        "_reset": (is_reset, True), "_ends": (~is_wrong, True), "_wrong": (is_wrong.cast("int"), 0)})
    c = running_totals(u, order, ["_wrong"], with_index="_pos", last_before=["_reset"], at_last={"_ends": ["_wrong"]})
    epoch_start = F.when(F.col("_reset"), F.col("_pos")).otherwise(F.col("prev__reset"))
    streak = F.col("cum__wrong") - F.col("_ends__wrong")
    s = c.select(*u.columns, epoch_start.alias("_epoch"),
                 ((F.col("_wrong") == 1) & (streak >= max_attempts)).alias("_lock"))
    c2 = running_totals(s, order, [], with_index="_pos2", last_before=["_lock"])
    locked_before = F.coalesce(F.col("prev__lock") >= F.col("_epoch"), F.lit(False))
    outcome = (F.when(F.col("_reset"), "reset").when(locked_before, "locked")
               .when(F.col("_wrong") == 1, "wrong").otherwise("success"))
    return c2.where(F.col("_kind") == 1).select(key, "event_id", "event_type", outcome.alias("outcome"))


# Session roles (fixed values)
LOGIN, LOGOUT = "view", "purchase"


def session_validity(events: DataFrame, key: str) -> DataFrame:
    """A session is valid between a login and the next logout of the same key.

    Valid when the last login strictly before the row is later than the last
    logout (the key's start marker counts as a logout, so nothing leaks in
    from the previous key in the global order).
    """
    u, order = _with_start_markers(events, key, {
        "_in": (F.col("event_type") == LOGIN, False), "_out": (F.col("event_type") == LOGOUT, True)})
    c = running_totals(u, order, [], last_before=["_in", "_out"])
    valid = F.coalesce(F.col("prev__in") > F.col("prev__out"), F.lit(False))
    return c.where(F.col("_kind") == 1).select(key, "event_id", "event_type", valid.alias("session_valid"))
