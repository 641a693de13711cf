"""The global-order helper against brute force, including a key that spans many ranges."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from suitewise.operators import sequences as L
from suitewise.operators.ordered import global_rank, running_totals
from suitewise.operators import features as E
from test_sequences import brute_rate, machine_lockout


def test_running_sums_ranks_and_last_flags(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 3), i, rnd.randint(0, 5), rnd.random() < 0.2) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o bigint, v bigint, f boolean")
    got = running_totals(df, [F.col("k"), F.col("o")], ["v"], with_index="pos", last_before=["f"]).collect()
    got = sorted(got, key=lambda r: r["pos"])
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    total, last = 0, None
    for i, (r, want) in enumerate(zip(got, ordered)):
        total += want[2]
        assert (r["k"], r["o"], r["pos"], r["cum_v"], r["prev_f"]) == (want[0], want[1], i + 1, total, last)
        if want[3]:
            last = i + 1
    ranks = {r["o"]: r["rank"] for r in global_rank(df, [F.col("v").desc(), F.col("o")]).collect()}
    expect = {o: i + 1 for i, (_, o, _, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    assert ranks == expect


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ranks_without_exchange_reuse(spark, coalesce):
    """Ranks of 400,000 rows stay exact when no shuffle is reused."""
    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": coalesce}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(400_000).select("id", F.xxhash64("id").alias("h"), F.lit("x" * 40).alias("pad"))
        got = global_rank(df, [F.col("h"), F.col("id")]).select("h", "rank").toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert (got.sort_values("h")["rank"].to_numpy() == range(1, 400_001)).all()


def test_hot_key_lockout_and_sessions(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    kinds = ("error", "error", "signup", "click", "view", "purchase")
    rows = []
    for i in range(1800):
        user = 0 if i % 3 == 0 else rnd.randint(1, 40)        # user 0 holds a third of all events
        rows.append((i, t0 + dt.timedelta(seconds=rnd.randint(0, 5000)), user, rnd.choice(kinds)))
    ev = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    got = {r["event_id"]: r["outcome"] for r in L.login_lockout(ev, "user_id").collect()}
    assert got == machine_lockout(rows)
    valid, state = {}, {}
    for eid, ts, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        valid[eid] = state.get(user) == "in"
        if kind == "view":
            state[user] = "in"
        elif kind == "purchase":
            state[user] = "out"
    got = {r["event_id"]: r["session_valid"] for r in L.session_validity(ev, "user_id").collect()}
    assert got == valid


def test_sums_since_the_last_flag(spark):
    """Segmented prefix sums, with segments that span many ranges and rows before any flag."""
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 5), rnd.random() < 0.01, rnd.random() < 0.3) for i in range(4000)]
    rows[0] = (0, 2, False, False)
    df = spark.createDataFrame(rows, "o bigint, v bigint, f boolean, g boolean").repartition(7)
    got = running_totals(df, [F.col("o")], ["v"], at_last={"f": ["v"], "g": ["v"]}).orderBy("o").collect()
    total, last = 0, {"f": None, "g": None}
    for r, (_, v, f, g) in zip(got, rows):
        total += v
        last = {"f": total if f else last["f"], "g": total if g else last["g"]}
        assert (r["cum_v"], r["f_v"], r["g_v"]) == (total, last["f"], last["g"])


def _rows_per_task(df) -> list[int]:
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_admission_of_a_hot_user_runs_in_many_tasks(spark):
    rnd = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows, clock = [], 0
    for i in range(3000):
        clock += rnd.choice([1, 2, 5, 61, 400])
        rows.append((i, t0 + dt.timedelta(seconds=clock), 0 if i % 3 else rnd.randint(1, 5), "click"))
    ev = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    got = L.rate_admit(ev, "user_id", 3, 60)
    assert {r["event_id"]: r["admitted"] for r in got.collect()} == brute_rate(rows, 3, 60, admit_only=True)
    conf = "spark.sql.adaptive.enabled"
    old = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "false")  # as dealt, before small partitions are put together
        tasks = _rows_per_task(L.rate_admit(ev.where("user_id = 0"), "user_id", 3, 60))
    finally:
        spark.conf.set(conf, old)
    assert len(tasks) > 4 and max(tasks) < 0.5 * sum(tasks)


def test_rows_of_a_hot_test_stay_in_their_tasks(spark):
    """A third of the rows on one test, broadcast joins off: no task gets them all, and none is shuffled by test."""
    h = spark.range(0, 6000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "t::hot").otherwise(F.concat(F.lit("t::"), F.col("id").cast("string"))).alias(E.KEY), "id")
    per_test = h.groupBy(E.KEY).agg(F.count("*").alias("n"), F.max("id").alias("top"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = E.attach(h, per_test, "n")
        tasks = _rows_per_task(out.where(F.col(E.KEY) == "t::hot"))
        got = {(r[E.KEY], r["id"]): r["top"] for r in out.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(tasks) == 12 and max(tasks) < 200
    assert len(got) == 6000 and got["t::hot", 3] == 5997 and got["t::7", 7] == 7


def test_rows_are_ordered_once_and_written_with_their_running_values(spark):
    """What is built on the result reads written rows: it holds no window or sort over them again."""
    df = spark.range(500).select("id", (F.col("id") % 3).alias("v"), (F.col("id") % 7 == 0).alias("f"))
    c = running_totals(df, [F.col("id").desc()], ["v"], with_index="pos", last_before=["f"], at_last={"f": ["v"]})
    windows = [line for line in c._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and not any("_row#" in line for line in windows)  # those left are over one row per range
    got = {(r["id"], r["pos"], r["cum_v"], r["f_v"]) for r in c.collect()}
    total, at_flag, want = 0, None, set()
    for pos, i in enumerate(range(499, -1, -1), 1):
        total += i % 3
        at_flag = total if i % 7 == 0 else at_flag
        want.add((i, pos, total, at_flag))
    assert got == want
