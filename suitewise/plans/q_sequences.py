"""Queries for event sequences (L) over the events table, keyed by user_id."""

from __future__ import annotations

from suitewise.operators import sequences as L
from suitewise.plans.registry import register
from suitewise.sources.tables import read_table

# 5 requests per 2 days (the fixture's rate-limit setting)
MAX_REQ, WINDOW_S = 5, 2 * 24 * 3600
_WIN_US = WINDOW_S * 1_000_000

_RATE_SQL = f"""
SELECT user_id, event_id, n_recent, n_recent < {MAX_REQ} AS allowed,
  CASE WHEN n_recent < {MAX_REQ} THEN 0.0 ELSE CAST({_WIN_US} - (us - oldest_us) AS DOUBLE) / 1000000.0 END AS wait_seconds
FROM (SELECT user_id, event_id, us,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
      - count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {_WIN_US} PRECEDING)
      AS BIGINT) AS n_recent,
    min(us) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {_WIN_US - 1} PRECEDING AND CURRENT ROW) AS oldest_us
  FROM (SELECT *, epoch_us(ts) AS us FROM events) e) r"""


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")


@register("rate_check", f"SELECT user_id, event_id, n_recent, allowed FROM ({_RATE_SQL}) x")
def rate_check(spark, sf_dir):
    r = L.rate_check(_events(spark, sf_dir), "user_id", MAX_REQ, WINDOW_S)
    return r.select("user_id", "event_id", "n_recent", "allowed")


@register("rate_wait", f"SELECT user_id, event_id, allowed, wait_seconds FROM ({_RATE_SQL}) x")
def rate_wait(spark, sf_dir):
    r = L.rate_check(_events(spark, sf_dir), "user_id", MAX_REQ, WINDOW_S)
    return r.select("user_id", "event_id", "allowed", "wait_seconds")


# admission control as a recursion over each user's ordered events, carrying the admitted times
ADMIT_SQL = f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r(user_id, rn, event_id, admitted, win) AS (
  SELECT user_id, rn, event_id, true, [us] FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id,
    len(list_filter(r.win, lambda t: e.us - t < {_WIN_US})) < {MAX_REQ},
    CASE WHEN len(list_filter(r.win, lambda t: e.us - t < {_WIN_US})) < {MAX_REQ}
      THEN list_append(list_filter(r.win, lambda t: e.us - t < {_WIN_US}), e.us)
      ELSE list_filter(r.win, lambda t: e.us - t < {_WIN_US}) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, admitted FROM r"""


@register("rate_admit", ADMIT_SQL)
def rate_admit(spark, sf_dir):
    return L.rate_admit(_events(spark, sf_dir), "user_id", MAX_REQ, WINDOW_S)


@register("login_lockout", """
SELECT user_id, event_id, event_type,
  CASE WHEN event_type = 'signup' THEN 'reset' WHEN locked_before THEN 'locked'
       WHEN event_type = 'error' THEN 'wrong' ELSE 'success' END AS outcome
FROM (SELECT *, coalesce(max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, epoch
      ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS locked_before
  FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, epoch, island
        ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak
    FROM (SELECT *, sum(CASE WHEN event_type NOT IN ('signup', 'error') THEN 1 ELSE 0 END) OVER (
          PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
      FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
            ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
        FROM events) a) b) c) d""")
def login_lockout(spark, sf_dir):
    return L.login_lockout(_events(spark, sf_dir), "user_id")


@register("session_validity", """
SELECT user_id, event_id, event_type,
  coalesce(last_value(CASE WHEN event_type = 'view' THEN 'in' WHEN event_type = 'purchase' THEN 'out' END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'in', false)
    AS session_valid
FROM events""")
def session_validity(spark, sf_dir):
    return L.session_validity(_events(spark, sf_dir), "user_id")
