"""DuckDB text of the fixture derivations, inlined as CTEs in oracle SQL.

The driver registers only the raw tables, so every oracle statement starts
with the derivations it needs. ``with_ctes`` resolves dependencies and keeps
the order.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (deps, sql.strip())


_cte("th", """
SELECT event_id AS exec_id, CAST(day(ts) AS BIGINT) AS run_id, ts AS run_ts,
  concat('tests/test_m', CAST(user_id % 12 AS STRING), '.py') AS test_file,
  concat('test_c', CAST(user_id AS STRING)) AS test_name,
  concat('tests/test_m', CAST(user_id % 12 AS STRING), '.py::test_c', CAST(user_id AS STRING)) AS full_test_name,
  concat('src/m', CAST(user_id % 12 AS STRING), '.py') AS source_file,
  event_type <> 'error' AS passed,
  CAST(value AS DECIMAL(12,2)) AS execution_time,
  CAST(0.70 + (k % 26) * 0.01 AS DECIMAL(4,2)) AS coverage,
  CASE WHEN k < 40 THEN 0 ELSE k END AS lines_changed,
  CASE WHEN k < 40 THEN 0 ELSE CAST(1 + floor(k / 10) AS BIGINT) END AS functions_changed,
  concat('src/m', CAST(k % 12 AS STRING), '.py,src/m', CAST((k + 5) % 12 AS STRING), '.py') AS files_changed,
  user_id % 10 = 0 AS is_flaky
FROM (SELECT event_id, ts, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) b
""")

_cte("mh", """
SELECT event_id AS exec_id, CAST(day(ts) AS BIGINT) AS run_id, ts AS run_ts,
  concat('tests/test_m', CAST(user_id % 12 AS STRING), '.py') AS test_file,
  concat('test_c', CAST(user_id AS STRING)) AS test_name,
  concat('tests/test_m', CAST(user_id % 12 AS STRING), '.py::test_c', CAST(user_id AS STRING)) AS full_test_name,
  concat('src/m', CAST(user_id % 12 AS STRING), '.py') AS source_file,
  NOT ((k >= 75 AND user_id % 3 <> 0) OR event_id % 20 = 0) AS passed,
  CAST(value AS DECIMAL(12,2)) AS execution_time,
  CAST(0.70 + (k % 26) * 0.01 AS DECIMAL(4,2)) AS coverage,
  CASE WHEN k < 40 THEN 0 ELSE k END AS lines_changed,
  CASE WHEN k < 40 THEN 0 ELSE CAST(1 + floor(k / 10) AS BIGINT) END AS functions_changed,
  concat('src/m', CAST(k % 12 AS STRING), '.py,src/m', CAST((k + 5) % 12 AS STRING), '.py') AS files_changed,
  user_id % 10 = 0 AS is_flaky
FROM (SELECT event_id, ts, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) b
""")

# history rows numbered inside each test, 1 = latest
_cte("thr", """
SELECT *, row_number() OVER (PARTITION BY full_test_name ORDER BY run_ts DESC, exec_id DESC) AS rn FROM th
""", ("th",))

# per-test serving features
_cte("ptf", """
SELECT full_test_name,
  CAST(count_if(NOT passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS historical_failure_rate,
  count_if(NOT passed AND rn <= 10) AS recent_failures,
  CAST(sum(execution_time) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_execution_time,
  coalesce(round(stddev_samp(CAST(execution_time AS DOUBLE)), 6), 0.0) AS execution_time_variance,
  CAST(count_if(lines_changed > 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS code_change_frequency,
  CAST(count_if(lines_changed > 0 AND NOT passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS test_coupling,
  CAST(max(CASE WHEN rn = 1 THEN CAST(is_flaky AS INTEGER) END) AS BIGINT) AS is_flaky,
  count(*) AS test_age,
  CAST(sum(coverage) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS coverage,
  CAST(coalesce(min(rn) FILTER (WHERE passed AND rn <= 10) - 1, least(count(*), 10)) AS BIGINT) AS failure_streak,
  CAST(coalesce(min(rn) FILTER (WHERE NOT passed) - 1, 999) AS BIGINT) AS time_since_last_failure,
  CAST(max(CASE WHEN rn = 1 THEN lines_changed END) AS BIGINT) AS last_lines_changed,
  min(run_id) AS first_run_id
FROM thr GROUP BY full_test_name
""", ("thr",))

_cte("cf", """
SELECT DISTINCT concat('src/m', CAST(s_suppkey % 12 AS STRING), '.py') AS file_path
FROM supplier WHERE s_suppkey % 12 IN (1, 4, 7)
""")

_cte("ti", """
SELECT DISTINCT concat('tests/test_m', CAST(l_suppkey % 12 AS STRING), '.py') AS test_file,
  concat(CASE WHEN l_partkey % 12 = (l_suppkey * 5 + 2) % 12 THEN 'src.m' ELSE 'lib.m' END,
    CAST(l_partkey % 12 AS STRING), '.e', CAST(l_linenumber AS STRING)) AS import_name
FROM lineitem
""")

_cte("tfiles", "SELECT DISTINCT test_file FROM th", ("th",))
_cte("sfiles", "SELECT DISTINCT source_file FROM th WHERE source_file <> 'src/m5.py'", ("th",))

_cte("mp", """
SELECT test_file, source_file FROM (
  SELECT test_file, 'src/' || replace(string_split(test_file, '/')[-1], 'test_', '') AS source_file
  FROM tfiles
  WHERE starts_with(string_split(test_file, '/')[-1], 'test_') AND ends_with(string_split(test_file, '/')[-1], '.py')) x
WHERE source_file IN (SELECT source_file FROM sfiles)
""", ("tfiles", "sfiles"))

_cte("mods", """
SELECT DISTINCT ltrim(replace(replace(replace(file_path, '.py', ''), '/', '.'), '\\', '.'), '.') AS module FROM cf
""", ("cf",))

_cte("imp", """
SELECT test_file, max(impact) AS impact FROM (
  SELECT test_file, CAST(1.0 AS DOUBLE) AS impact FROM mp WHERE source_file IN (SELECT file_path FROM cf)
  UNION ALL
  SELECT DISTINCT i.test_file, CAST(0.5 AS DOUBLE) AS impact
  FROM ti i JOIN mods m ON contains(i.import_name, m.module)
  WHERE i.test_file IN (SELECT test_file FROM mp)) u
GROUP BY test_file
""", ("mp", "ti", "mods", "cf"))

_cte("fs", """
SELECT full_test_name, (sum(CASE WHEN passed THEN 0 ELSE 1 END) + 1) / CAST(count(*) + 2 AS DOUBLE) AS failure_probability
FROM th GROUP BY full_test_name
""", ("th",))

_cte("cand", """
SELECT DISTINCT full_test_name FROM th UNION ALL
SELECT concat('tests/test_m1.py::test_new', CAST(n_nationkey + 1 AS STRING)) FROM nation
""", ("th",))

_cte("cmap", """
SELECT test_file, max(lines_changed) AS lines_changed, max(functions_changed) AS functions_changed
FROM (SELECT *, max(run_id) OVER (PARTITION BY test_file) AS last_run FROM th) t
WHERE run_id = last_run GROUP BY test_file
""", ("th",))

# priority rows of every test in history (H1, H3, H5)
_cte("pr", """
SELECT full_test_name, score AS priority_score, prob AS failure_probability,
  avg_execution_time AS execution_time, recent_failures, last_lines_changed AS lines_changed,
  CASE WHEN greatest(prob, imp, historical_failure_rate, rs) > 0.5 THEN
    CASE WHEN prob = greatest(prob, imp, historical_failure_rate, rs) THEN 'High failure risk'
         WHEN imp = greatest(prob, imp, historical_failure_rate, rs) THEN 'Code changes'
         WHEN historical_failure_rate = greatest(prob, imp, historical_failure_rate, rs) THEN 'Historical failures'
         ELSE 'Recent failures' END
  ELSE 'General testing' END AS reason
FROM (
  SELECT f.*, coalesce(s.failure_probability, 0.0) AS prob, coalesce(i.impact, 0.0) AS imp,
    least(CAST(f.recent_failures AS DOUBLE) / 5.0, 1.0) AS rs,
    coalesce(s.failure_probability, 0.0) * CAST(0.4 AS DOUBLE) + coalesce(i.impact, 0.0) * CAST(0.3 AS DOUBLE)
      + f.historical_failure_rate * CAST(0.15 AS DOUBLE)
      + least(CAST(f.recent_failures AS DOUBLE) / 5.0, 1.0) * CAST(0.15 AS DOUBLE) AS score
  FROM ptf f LEFT JOIN fs s USING (full_test_name)
  LEFT JOIN imp i ON i.test_file = CASE WHEN contains(f.full_test_name, '::')
    THEN split_part(f.full_test_name, '::', 1) ELSE '' END) x
""", ("ptf", "fs", "imp"))

_cte("prk", """
SELECT *, row_number() OVER (ORDER BY priority_score DESC, full_test_name) AS rank,
  sum(execution_time) OVER (ORDER BY priority_score DESC, full_test_name
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_time
FROM pr
""", ("pr",))


def with_ctes(names: list[str] | tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in CTES[n][0]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
