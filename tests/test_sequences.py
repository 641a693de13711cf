"""Event sequences: rate limits and lockout against plain state machines."""

import datetime as dt
import random

import pytest

from suitewise.operators import sequences as L

EV = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(rows, EV)


def random_events(seed, n=400, users=4, spread_s=600, kinds=("error", "signup", "click", "view")):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, T0 + dt.timedelta(seconds=rnd.randint(0, spread_s)), rnd.randint(0, users - 1),
                     rnd.choice(kinds)))
    return rows


def test_rate_limit_five_per_minute(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), 1, "click") for i in range(7)]
    rows.append((7, T0 + dt.timedelta(seconds=63), 1, "click"))   # ages 59, 58, 57 remain
    r = {x["event_id"]: x for x in L.rate_check(events(spark, rows), "user_id", 5, 60).collect()}
    assert [r[i]["allowed"] for i in range(8)] == [True] * 5 + [False, False, True]
    assert r[5]["wait_seconds"] == pytest.approx(55.0)    # 60 - age of the oldest (5 s)


def brute_rate(rows, max_req, win_s, admit_only):
    out, hist = {}, {}
    for eid, ts, user, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        past = [t for t in hist.get(user, []) if (ts - t).total_seconds() < win_s]
        ok = len(past) < max_req
        out[eid] = ok
        if ok or not admit_only:
            past.append(ts)
        hist[user] = past
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rate_check_and_admission_vs_loop(spark, seed):
    rows = random_events(seed)
    got = {x["event_id"]: x["allowed"] for x in L.rate_check(events(spark, rows), "user_id", 5, 60).collect()}
    assert got == brute_rate(rows, 5, 60, admit_only=False)
    adm = {x["event_id"]: x["admitted"] for x in L.rate_admit(events(spark, rows), "user_id", 5, 60).collect()}
    assert adm == brute_rate(rows, 5, 60, admit_only=True)


def machine_lockout(rows):
    state, out = {}, {}
    for eid, ts, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        attempts, active = state.get(user, (0, True))
        if kind == "signup":
            attempts, active, res = 0, True, "reset"
        elif not active:
            res = "locked"
        elif kind == "error":
            attempts += 1
            active = attempts < 3
            res = "wrong"
        else:
            attempts, res = 0, "success"
        state[user] = (attempts, active)
        out[eid] = res
    return out


def test_lockout_literal(spark):
    kinds = ["error", "error", "error", "click", "signup", "click"]
    rows = [(i, T0 + dt.timedelta(seconds=i), 1, k) for i, k in enumerate(kinds)]
    got = [x["outcome"] for x in L.login_lockout(events(spark, rows), "user_id").orderBy("event_id").collect()]
    assert got == ["wrong", "wrong", "wrong", "locked", "reset", "success"]


@pytest.mark.parametrize("seed", range(3))
def test_lockout_windows_equal_state_machine(spark, seed):
    rows = random_events(seed, kinds=("error", "error", "signup", "click", "view"))
    got = {x["event_id"]: x["outcome"] for x in L.login_lockout(events(spark, rows), "user_id").collect()}
    assert got == machine_lockout(rows)


def test_session_validity(spark):
    kinds = ["click", "view", "click", "purchase", "click", "view", "view", "click"]
    rows = [(i, T0 + dt.timedelta(seconds=i), 1, k) for i, k in enumerate(kinds)]
    got = [x["session_valid"] for x in L.session_validity(events(spark, rows), "user_id").orderBy("event_id").collect()]
    assert got == [False, False, True, True, False, False, True, True]
