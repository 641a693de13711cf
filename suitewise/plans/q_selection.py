"""Queries for impact (D), risk (G), exact metrics (F9, F10) and selection (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitewise.operators import impact as D
from suitewise.operators import risk as G
from suitewise.operators import selection as H
from suitewise.operators.features import KEY
from suitewise.plans.flagship import selection_plan
from suitewise.plans.inputs import Inputs
from suitewise.plans.oracle_fixtures import with_ctes
from suitewise.plans.registry import register
from suitewise.sources import fixtures as X

# ---------------------------------------------------------------- D: impact


@register("test_source_map", with_ctes(["mp"], "SELECT test_file, source_file FROM mp"))
def test_source_map(spark, sf_dir):
    return Inputs(spark, sf_dir).mapping


@register("path_module", with_ctes(["th", "cf"], """
SELECT file_path, ltrim(replace(replace(replace(file_path, '.py', ''), '/', '.'), '\\', '.'), '.') AS module
FROM (SELECT DISTINCT source_file AS file_path FROM th UNION SELECT file_path FROM cf) x"""))
def path_module(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    files = i.history.select(F.col("source_file").alias("file_path")).unionByName(i.changed).distinct()
    return files.select("file_path", D.path_to_module(F.col("file_path")).alias("module"))


@register("direct_impact", with_ctes(["mp", "cf"], """
SELECT test_file, CAST(1.0 AS DOUBLE) AS impact FROM mp WHERE source_file IN (SELECT file_path FROM cf)"""))
def direct_impact(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return D.direct_impact(i.mapping, i.changed)


@register("import_impact", with_ctes(["mp", "ti", "mods"], """
SELECT DISTINCT i.test_file, CAST(0.5 AS DOUBLE) AS impact
FROM ti i JOIN mods m ON contains(i.import_name, m.module)
WHERE i.test_file IN (SELECT test_file FROM mp)"""))
def import_impact(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return D.import_impact(i.mapping, i.imports, i.changed)


@register("import_impact_exact", with_ctes(["mp", "ti", "mods"], """
SELECT DISTINCT i.test_file, CAST(0.5 AS DOUBLE) AS impact
FROM ti i JOIN mods m ON i.import_name = m.module OR starts_with(i.import_name, m.module || '.')
WHERE i.test_file IN (SELECT test_file FROM mp)"""))
def import_impact_exact(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return D.import_impact(i.mapping, i.imports, i.changed, exact=True)


@register("impact_scores", with_ctes(["imp"], "SELECT test_file, impact FROM imp"))
def impact_scores(spark, sf_dir):
    return Inputs(spark, sf_dir).impact


@register("affected_tests", with_ctes(["imp"], "SELECT test_file, impact FROM imp WHERE impact >= 0.3"))
def affected_tests(spark, sf_dir):
    return D.affected_tests(Inputs(spark, sf_dir).impact, 0.3)


@register("file_priority", with_ctes(["th", "imp"], """
SELECT b.test_file, coalesce(i.impact, 0.0) AS impact, b.failure_rate, r.recent_failures,
  least(coalesce(i.impact, 0.0) * CAST(0.4 AS DOUBLE) + b.failure_rate * CAST(0.3 AS DOUBLE)
    + least(CAST(r.recent_failures AS DOUBLE) / 5.0, 1.0) * CAST(0.3 AS DOUBLE), 1.0) AS priority
FROM (SELECT test_file, CAST(count_if(NOT passed) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS failure_rate
      FROM th GROUP BY test_file) b
JOIN (SELECT test_file, count_if(NOT passed) AS recent_failures FROM (
        SELECT *, row_number() OVER (PARTITION BY test_file ORDER BY run_ts DESC, exec_id DESC) AS rn FROM th) x
      WHERE rn <= 10 GROUP BY test_file) r USING (test_file)
LEFT JOIN imp i USING (test_file)"""))
def file_priority(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return D.file_priority(i.history, i.impact)


@register("related_tests", with_ctes(["mp", "sfiles"], """
SELECT m.source_file, m.test_file FROM mp m JOIN sfiles s USING (source_file)"""))
def related_tests(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return D.related_tests(i.mapping, X.source_files(i.history))


def _estimate_inputs(spark, sf_dir):
    from suitewise.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents", "doc_id", "n_chars")
    sizes = (docs.groupBy(F.concat(F.lit("tests/test_m"), (F.col("doc_id") % 14).cast("string"),
                                   F.lit(".py")).alias("test_file"))
             .agg(F.sum("n_chars").alias("size_bytes")))
    files = read_table(spark, sf_dir, "nation", "n_nationkey").select(
        F.concat(F.lit("tests/test_m"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("test_file"))
    return files, sizes


@register("estimated_time", with_ctes(["th"], """
SELECT round(sum(coalesce(k.avg_time, 0.1 * (CAST(s.size_bytes AS DOUBLE) / 1000.0), 0.0)), 6) AS total_time,
  count(*) AS n_files
FROM (SELECT concat('tests/test_m', CAST(n_nationkey AS STRING), '.py') AS test_file FROM nation) f
LEFT JOIN (SELECT test_file, CAST(sum(execution_time) AS DOUBLE) / count(*) AS avg_time FROM th GROUP BY test_file) k
  USING (test_file)
LEFT JOIN (SELECT concat('tests/test_m', CAST(doc_id % 14 AS STRING), '.py') AS test_file, sum(n_chars) AS size_bytes
  FROM documents GROUP BY 1) s USING (test_file)"""))
def estimated_time(spark, sf_dir):
    files, sizes = _estimate_inputs(spark, sf_dir)
    return D.estimated_time(files, Inputs(spark, sf_dir).history, sizes)


# ---------------------------------------------------------------- G: risk


@register("score_inputs", with_ctes(["cand", "cmap"], """
SELECT c.full_test_name, CAST(coalesce(m.lines_changed, 0) AS BIGINT) AS lines_changed,
  CAST(coalesce(m.functions_changed, 0) AS BIGINT) AS functions_changed
FROM cand c LEFT JOIN cmap m ON m.test_file = CASE WHEN contains(c.full_test_name, '::')
  THEN split_part(c.full_test_name, '::', 1) ELSE '' END"""))
def score_inputs(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return G.score_inputs(i.candidates, i.change_map)


@register("risk_ranking", with_ctes(["fs"], """
SELECT full_test_name, failure_probability,
  row_number() OVER (ORDER BY failure_probability DESC, full_test_name) AS rank FROM fs"""))
def risk_ranking(spark, sf_dir):
    return G.risk_ranking(Inputs(spark, sf_dir).scores)


@register("risk_top", with_ctes(["fs"], """
SELECT full_test_name, failure_probability FROM fs ORDER BY failure_probability DESC, full_test_name LIMIT 10"""))
def risk_top(spark, sf_dir):
    return G.top_risk(Inputs(spark, sf_dir).scores, 10)


@register("high_risk_tests", with_ctes(["fs"], """
SELECT full_test_name, failure_probability FROM fs WHERE failure_probability >= 0.25"""))
def high_risk_tests(spark, sf_dir):
    return G.high_risk_tests(Inputs(spark, sf_dir).scores, 0.25)


@register("risk_members", with_ctes(["fs"], """
SELECT full_test_name, failure_probability,
  CASE WHEN failure_probability > 0.7 THEN 'high' WHEN failure_probability > 0.3 THEN 'medium' ELSE 'low' END AS risk_tier
FROM fs"""))
def risk_members(spark, sf_dir):
    return G.risk_members(Inputs(spark, sf_dir).scores)


@register("risk_summary", with_ctes(["fs"], """
SELECT t.risk_tier, coalesce(c.n, 0) AS n_tests,
  CAST(coalesce(c.n, 0) AS DOUBLE) / CAST((SELECT count(*) FROM fs) AS DOUBLE) * 100.0 AS percentage
FROM (VALUES ('high'), ('medium'), ('low')) t(risk_tier)
LEFT JOIN (SELECT CASE WHEN failure_probability > 0.7 THEN 'high' WHEN failure_probability > 0.3 THEN 'medium'
  ELSE 'low' END AS risk_tier, count(*) AS n FROM fs GROUP BY 1) c USING (risk_tier)"""))
def risk_summary(spark, sf_dir):
    return G.risk_summary(Inputs(spark, sf_dir).scores)


_LABELLED = """
SELECT s.full_test_name, s.failure_probability AS score,
  CAST(CASE WHEN l.passed THEN 0 ELSE 1 END AS BIGINT) AS label,
  CAST(CASE WHEN s.failure_probability >= 0.2 THEN 1 ELSE 0 END AS BIGINT) AS prediction
FROM fs s JOIN thr l ON l.full_test_name = s.full_test_name AND l.rn = 1"""


def _labelled(spark, sf_dir):
    from suitewise.operators.features import latest_values
    i = Inputs(spark, sf_dir)
    last = latest_values(i.history).select(KEY, F.when(F.col("passed"), 0).otherwise(1).cast("bigint")
                                           .alias("label"))
    return i.scores.join(last, KEY).select(
        KEY, F.col("failure_probability").alias("score"), "label",
        F.when(F.col("failure_probability") >= 0.2, 1).otherwise(0).cast("bigint").alias("prediction"))


@register("classification_metrics", with_ctes(["fs", "thr"], f"""
SELECT n, tp, fp, fn, tn, CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
    ELSE 2.0 * CAST(tp AS DOUBLE) / (2.0 * CAST(tp AS DOUBLE) + CAST(fp AS DOUBLE) + CAST(fn AS DOUBLE)) END AS f1
FROM (SELECT count(*) AS n, count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
  count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 0 AND prediction = 0) AS tn
  FROM ({_LABELLED}) x) c"""))
def classification_metrics(spark, sf_dir):
    return G.classification_metrics(_labelled(spark, sf_dir))


@register("roc_auc", with_ctes(["fs", "thr"], f"""
SELECT sum(CAST(pos AS DOUBLE) * (CAST(cum_neg AS DOUBLE) - 0.5 * CAST(neg AS DOUBLE)))
    / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc,
  sum(pos) AS positives, sum(neg) AS negatives
FROM (SELECT s, pos, neg, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
  FROM (SELECT score AS s, count_if(label = 1) AS pos, count_if(label <> 1) AS neg
    FROM ({_LABELLED}) x GROUP BY score) g) c"""))
def roc_auc(spark, sf_dir):
    return G.roc_auc(_labelled(spark, sf_dir))


# ---------------------------------------------------------------- H: selection


@register("priority_scores", with_ctes(["pr"], "SELECT * FROM pr"))
def priority_scores(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.priority_scores(i.history, i.scores, i.impact)


@register("priority_new_tests", with_ctes(["cand", "pr", "fs"], """
SELECT c.full_test_name,
  coalesce(p.priority_score, 0.5) AS priority_score,
  CASE WHEN p.full_test_name IS NULL THEN coalesce(s.failure_probability, 0.5) ELSE p.failure_probability END
    AS failure_probability,
  coalesce(p.execution_time, 0.1) AS execution_time,
  coalesce(p.recent_failures, 0) AS recent_failures,
  coalesce(p.lines_changed, 0) AS lines_changed,
  coalesce(p.reason, 'New test') AS reason
FROM cand c LEFT JOIN pr p USING (full_test_name) LEFT JOIN fs s USING (full_test_name)"""))
def priority_new_tests(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.priority_scores(i.history, i.scores, i.impact, candidates=i.candidates)


@register("priority_reason", with_ctes(["pr"], "SELECT full_test_name, reason FROM pr"))
def priority_reason(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.priority_scores(i.history, i.scores, i.impact).select(KEY, "reason")


@register("priority_ranking", with_ctes(["prk"], "SELECT rank, full_test_name, priority_score FROM prk"))
def priority_ranking(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    p = H.priority_scores(i.history, i.scores, i.impact).select(KEY, "priority_score")
    return H.priority_ranking(p).select("rank", KEY, "priority_score")


_SEL_COLS = "rank, full_test_name, priority_score, failure_probability, execution_time, recent_failures, lines_changed, reason"


@register("select_default", with_ctes(["prk"], f"""
SELECT {_SEL_COLS} FROM prk WHERE rank <= 5 OR (rank <= 100 AND priority_score >= 0.3)"""))
def select_default(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.select_tests(H.priority_scores(i.history, i.scores, i.impact))


@register("select_capped", with_ctes(["prk"], f"""
SELECT {_SEL_COLS} FROM prk WHERE rank <= 5 OR (rank <= 20 AND priority_score >= 0.3)"""))
def select_capped(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.select_tests(H.priority_scores(i.history, i.scores, i.impact), max_tests=20)


@register("select_budget", with_ctes(["prk"], f"""
SELECT {_SEL_COLS} FROM prk WHERE rank <= 5 OR (rank <= 100 AND priority_score >= 0.3 AND cum_time <= 500.0)"""))
def select_budget(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.select_tests(H.priority_scores(i.history, i.scores, i.impact), time_budget=500.0)


@register("select_tests", with_ctes(["prk"], """
SELECT rank, full_test_name, priority_score, failure_probability, reason
FROM prk WHERE rank <= 5 OR (rank <= 40 AND priority_score >= 0.3)"""))
def select_tests(spark, sf_dir):
    return selection_plan(spark, sf_dir, min_tests=5, max_tests=40)


@register("selection_summary", with_ctes(["prk"], """
SELECT total_tests, selected_tests,
  round((1.0 - CAST(selected_tests AS DOUBLE) / CAST(total_tests AS DOUBLE)) * 100.0, 6) AS reduction_percentage,
  round(t_all, 6) AS total_execution_time_all, round(t_sel, 6) AS total_execution_time_selected,
  round(t_all - t_sel, 6) AS time_saved,
  round(CASE WHEN t_all > 0 THEN (t_all - t_sel) / t_all * 100.0 ELSE 0.0 END, 6) AS time_reduction_percentage,
  high_priority_count, medium_priority_count, low_priority_count
FROM (SELECT count(*) AS total_tests, count_if(sel) AS selected_tests, sum(execution_time) AS t_all,
  coalesce(sum(execution_time) FILTER (WHERE sel), 0.0) AS t_sel,
  count_if(sel AND priority_score > 0.7) AS high_priority_count,
  count_if(sel AND priority_score >= 0.3 AND priority_score <= 0.7) AS medium_priority_count,
  count_if(sel AND priority_score < 0.3) AS low_priority_count
  FROM (SELECT *, rank <= 5 OR (rank <= 100 AND priority_score >= 0.3) AS sel FROM prk) x) a"""))
def selection_summary(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    p = H.priority_scores(i.history, i.scores, i.impact)
    return H.selection_summary(p, H.select_tests(p))


@register("priority_tiers", with_ctes(["pr"], """
SELECT t.tier, coalesce(c.n, 0) AS n_tests
FROM (VALUES ('high'), ('medium'), ('low')) t(tier)
LEFT JOIN (SELECT CASE WHEN priority_score > 0.7 THEN 'high' WHEN priority_score >= 0.3 THEN 'medium'
  ELSE 'low' END AS tier, count(*) AS n FROM pr GROUP BY 1) c USING (tier)"""))
def priority_tiers(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.priority_tiers(H.priority_scores(i.history, i.scores, i.impact))


@register("priority_report", with_ctes(["prk"], """
SELECT rank, full_test_name, round(priority_score, 3) AS priority, round(failure_probability, 3) AS failure_prob,
  reason FROM prk WHERE rank <= 20"""))
def priority_report(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.priority_report(H.priority_scores(i.history, i.scores, i.impact), 20)


@register("top_tests", with_ctes(["prk"], """
SELECT rank, string_split(full_test_name, '::')[-1] AS test_short, priority_score FROM prk WHERE rank <= 10"""))
def top_tests(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.top_tests(H.priority_scores(i.history, i.scores, i.impact), 10)


@register("select_no_changes", with_ctes(["ptf", "fs"], """
SELECT rank, full_test_name, priority_score FROM (
  SELECT full_test_name, priority_score,
    row_number() OVER (ORDER BY priority_score DESC, full_test_name) AS rank
  FROM (SELECT f.full_test_name,
      coalesce(s.failure_probability, 0.0) * CAST(0.4 AS DOUBLE) + 0.0 * CAST(0.3 AS DOUBLE)
      + f.historical_failure_rate * CAST(0.15 AS DOUBLE)
      + least(CAST(f.recent_failures AS DOUBLE) / 5.0, 1.0) * CAST(0.15 AS DOUBLE) AS priority_score
    FROM ptf f LEFT JOIN fs s USING (full_test_name)) p) r
WHERE rank <= 5 OR (rank <= 100 AND priority_score >= 0.3)"""))
def select_no_changes(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    empty = i.changed.where(F.lit(False))
    imp = D.impact_scores(i.mapping, i.imports, empty)
    return H.select_tests(H.priority_scores(i.history, i.scores, imp)).select("rank", KEY, "priority_score")


@register("collected_filter", with_ctes(["cand", "prk"], """
SELECT c.full_test_name AS test_id,
  EXISTS (SELECT 1 FROM prk s WHERE (s.rank <= 5 OR (s.rank <= 100 AND s.priority_score >= 0.3))
    AND ends_with(c.full_test_name, string_split(s.full_test_name, '::')[-1])) AS kept
FROM cand c"""))
def collected_filter(spark, sf_dir):
    from suitewise.operators.selection import collected_filter as cf
    i = Inputs(spark, sf_dir)
    sel = H.select_tests(H.priority_scores(i.history, i.scores, i.impact))
    return cf(i.candidates.select(F.col(KEY).alias("test_id")), sel)


@register("collected_filter_summary", with_ctes(["cand", "prk"], """
SELECT count_if(kept) AS kept, count_if(NOT kept) AS skipped,
  CAST(count_if(NOT kept) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS reduction_percentage
FROM (SELECT EXISTS (SELECT 1 FROM prk s WHERE (s.rank <= 5 OR (s.rank <= 100 AND s.priority_score >= 0.3))
    AND ends_with(c.full_test_name, string_split(s.full_test_name, '::')[-1])) AS kept FROM cand c) x"""))
def collected_filter_summary(spark, sf_dir):
    from suitewise.operators.selection import collected_filter as cf, collected_summary
    i = Inputs(spark, sf_dir)
    sel = H.select_tests(H.priority_scores(i.history, i.scores, i.impact))
    return collected_summary(cf(i.candidates.select(F.col(KEY).alias("test_id")), sel))


# ---------------------------------------------------------------- H14, H15

def _scenarios(spark, sf_dir):
    from suitewise.sources.tables import read_table
    m = F.col("s_suppkey") % 12
    s = read_table(spark, sf_dir, "supplier", "s_suppkey").where(m.isin(1, 4, 7)).select(
        m.alias("m"), F.concat(F.lit("src/m"), m.cast("string"), F.lit(".py")).alias("file_path"))
    one = s.where(F.col("m").isin(1, 4)).select(
        F.when(F.col("m") == 1, "A").otherwise("B").alias("scenario_id"), "file_path")
    allc = s.select(F.lit("C").alias("scenario_id"), "file_path")
    return one.unionByName(allc).distinct()


_SCENARIO_SQL = with_ctes(["mp", "ti", "ptf", "fs"], """,
sc AS (SELECT DISTINCT scenario_id, file_path FROM (
  SELECT CASE WHEN s_suppkey % 12 = 1 THEN 'A' ELSE 'B' END AS scenario_id,
    concat('src/m', CAST(s_suppkey % 12 AS STRING), '.py') AS file_path FROM supplier WHERE s_suppkey % 12 IN (1, 4)
  UNION ALL
  SELECT 'C', concat('src/m', CAST(s_suppkey % 12 AS STRING), '.py') FROM supplier WHERE s_suppkey % 12 IN (1, 4, 7)) x),
simp AS (SELECT scenario_id, test_file, max(impact) AS impact FROM (
  SELECT sc.scenario_id, mp.test_file, CAST(1.0 AS DOUBLE) AS impact FROM mp JOIN sc ON mp.source_file = sc.file_path
  UNION ALL
  SELECT DISTINCT sc.scenario_id, i.test_file, CAST(0.5 AS DOUBLE) FROM ti i JOIN sc
    ON contains(i.import_name, ltrim(replace(replace(replace(sc.file_path, '.py', ''), '/', '.'), '\\', '.'), '.'))
  WHERE i.test_file IN (SELECT test_file FROM mp)) u GROUP BY 1, 2),
sp AS (SELECT s.scenario_id, f.full_test_name,
    coalesce(p.failure_probability, 0.0) * CAST(0.4 AS DOUBLE) + coalesce(si.impact, 0.0) * CAST(0.3 AS DOUBLE)
    + f.historical_failure_rate * CAST(0.15 AS DOUBLE)
    + least(CAST(f.recent_failures AS DOUBLE) / 5.0, 1.0) * CAST(0.15 AS DOUBLE) AS score
  FROM (SELECT DISTINCT scenario_id FROM sc) s CROSS JOIN ptf f LEFT JOIN fs p USING (full_test_name)
  LEFT JOIN simp si ON si.scenario_id = s.scenario_id AND si.test_file = split_part(f.full_test_name, '::', 1)),
per AS (SELECT scenario_id AS scenario, count(*) AS total_tests,
    CAST(count_if(rank <= 5 OR (rank <= 100 AND score >= 0.3)) AS DOUBLE) AS selected
  FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY score DESC, full_test_name) AS rank FROM sp) r
  GROUP BY scenario_id)
SELECT scenario, total_tests, selected, round((1.0 - selected / CAST(total_tests AS DOUBLE)) * 100.0, 6) AS reduction
FROM per
UNION ALL
SELECT 'Average', NULL, avg(selected), round(avg((1.0 - selected / CAST(total_tests AS DOUBLE)) * 100.0), 6) FROM per""")
# with_ctes ends its list before the body; the body above continues the WITH list
_SCENARIO_SQL = _SCENARIO_SQL.replace("\n,\nsc AS (", ",\nsc AS (", 1)


@register("scenario_comparison", _SCENARIO_SQL)
def scenario_comparison(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    sc = _scenarios(spark, sf_dir)
    simp = D.impact_scores_by(i.mapping, i.imports, sc, ["scenario_id"])
    r = H.scenario_comparison(i.history, i.scores, simp, sc)
    return r.select("scenario", "total_tests", "selected", F.round("reduction", 6).alias("reduction"))


SCENARIO_BUDGET = 60.0  # seconds of tests per scenario


def _scenario_tests_sql(budget: float | None) -> str:
    head = _SCENARIO_SQL[:_SCENARIO_SQL.index("per AS (SELECT scenario_id AS scenario")]
    within = f" AND cum_time <= {budget}" if budget else ""
    return head + f"""st AS (SELECT sp.*, f.avg_execution_time AS t FROM sp JOIN ptf f USING (full_test_name)),
rk AS (SELECT *, row_number() OVER w AS rank, sum(t) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_time
  FROM st WINDOW w AS (PARTITION BY scenario_id ORDER BY score DESC, full_test_name))
SELECT scenario_id AS scenario, rank, full_test_name, score AS priority_score FROM rk
WHERE rank <= 5 OR (rank <= 100 AND score >= 0.3{within})"""


def _scenario_tests(spark, sf_dir, budget=None):
    i = Inputs(spark, sf_dir)
    sc = _scenarios(spark, sf_dir)
    simp = D.impact_scores_by(i.mapping, i.imports, sc, ["scenario_id"])
    return H.scenario_selections(i.history, i.scores, simp, sc, time_budget=budget)


@register("scenario_selections", _scenario_tests_sql(None))
def scenario_selections(spark, sf_dir):
    return _scenario_tests(spark, sf_dir)


@register("scenario_selections_budget", _scenario_tests_sql(SCENARIO_BUDGET))
def scenario_selections_budget(spark, sf_dir):
    return _scenario_tests(spark, sf_dir, SCENARIO_BUDGET)


def _backtest_sql() -> str:
    import re

    from suitewise.plans.oracle_fixtures import CTES
    names = {"thr": "thr_p", "ptf": "ptf_p", "fs": "fs_p", "pr": "pr_p", "prk": "prk_p"}
    parts = []
    for n in ("thr", "ptf", "fs", "pr", "prk"):
        sql = re.sub(r"\bth\b", "past", CTES[n][1])
        for a, b in names.items():
            sql = re.sub(rf"\b{a}\b", b, sql)
        parts.append(f"{names[n]} AS (\n{sql}\n)")
    head = with_ctes(["th", "imp"], "SELECT 1").rsplit("\nSELECT 1", 1)[0]
    return head + """,
ev AS (SELECT max(run_id) AS r FROM th),
past AS (SELECT * FROM th WHERE run_id < (SELECT r FROM ev)),
""" + ",\n".join(parts) + """
SELECT count(*) AS tests_run, count_if(failed) AS failing_tests, count_if(sel) AS selected_run,
  count_if(sel AND failed) AS caught, count_if(NOT sel AND failed) AS missed,
  CAST(sum(t) AS DOUBLE) AS time_all, CAST(coalesce(sum(t) FILTER (WHERE sel), 0) AS DOUBLE) AS time_selected,
  CAST(count_if(sel AND failed) AS DOUBLE) / CAST(count_if(failed) AS DOUBLE) AS recall,
  CAST(sum(t) AS DOUBLE) - CAST(coalesce(sum(t) FILTER (WHERE sel), 0) AS DOUBLE) AS time_saved
FROM (SELECT n.full_test_name, n.failed, n.t, s.full_test_name IS NOT NULL AS sel
  FROM (SELECT full_test_name, count_if(NOT passed) > 0 AS failed, sum(execution_time) AS t
        FROM th WHERE run_id = (SELECT r FROM ev) GROUP BY full_test_name) n
  LEFT JOIN (SELECT full_test_name FROM prk_p WHERE rank <= 5 OR (rank <= 100 AND priority_score >= 0.3)) s
  USING (full_test_name)) x"""


@register("selection_backtest", _backtest_sql())
def selection_backtest(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.selection_backtest(i.history, i.impact, X.failure_scores)


# ---------------------------------------------------------------- H10 with detection

_AUTO_SQL = with_ctes(["ptf", "fs", "tfiles", "sfiles", "ti"], """,
snap AS (
  SELECT 'base' AS version, concat('src/d', CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '.md' ELSE '.py' END) AS file_path,
    md5(text) AS content_hash FROM documents WHERE doc_id % 5 <> 0
  UNION ALL
  SELECT 'head', concat('src/d', CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '.md' ELSE '.py' END),
    md5(CASE WHEN doc_id % 3 = 0 THEN concat(text, '!') ELSE text END) FROM documents WHERE doc_id % 7 <> 0),
det AS (SELECT file_path FROM (
    SELECT b.file_path FROM (SELECT * FROM snap WHERE version = 'base') b
    LEFT JOIN (SELECT * FROM snap WHERE version = 'head') h USING (file_path)
    WHERE b.content_hash IS DISTINCT FROM h.content_hash
    UNION ALL
    SELECT h.file_path FROM (SELECT * FROM snap WHERE version = 'head') h
    WHERE h.file_path NOT IN (SELECT file_path FROM snap WHERE version = 'base')) u
  WHERE ends_with(file_path, '.py')),
mp2 AS (SELECT test_file, source_file FROM (
    SELECT test_file, 'src/' || replace(string_split(test_file, '/')[-1], 'test_', '') AS source_file FROM tfiles
    WHERE starts_with(string_split(test_file, '/')[-1], 'test_') AND ends_with(string_split(test_file, '/')[-1], '.py')) x
  WHERE source_file IN (SELECT source_file FROM sfiles)),
imp2 AS (SELECT test_file, max(impact) AS impact FROM (
    SELECT test_file, CAST(1.0 AS DOUBLE) AS impact FROM mp2 WHERE source_file IN (SELECT file_path FROM det)
    UNION ALL
    SELECT DISTINCT i.test_file, CAST(0.5 AS DOUBLE) FROM ti i JOIN det d
      ON contains(i.import_name, ltrim(replace(replace(replace(d.file_path, '.py', ''), '/', '.'), '\\', '.'), '.'))
    WHERE i.test_file IN (SELECT test_file FROM mp2)) u GROUP BY test_file),
sc AS (SELECT f.full_test_name,
    coalesce(s.failure_probability, 0.0) * CAST(0.4 AS DOUBLE) + coalesce(i.impact, 0.0) * CAST(0.3 AS DOUBLE)
    + f.historical_failure_rate * CAST(0.15 AS DOUBLE)
    + least(CAST(f.recent_failures AS DOUBLE) / 5.0, 1.0) * CAST(0.15 AS DOUBLE) AS priority_score
  FROM ptf f LEFT JOIN fs s USING (full_test_name)
  LEFT JOIN imp2 i ON i.test_file = split_part(f.full_test_name, '::', 1))
SELECT rank, full_test_name, priority_score FROM (
  SELECT *, row_number() OVER (ORDER BY priority_score DESC, full_test_name) AS rank FROM sc) r
WHERE (rank <= 5 OR (rank <= 100 AND priority_score >= 0.3)) AND EXISTS (SELECT 1 FROM det)""")
_AUTO_SQL = _AUTO_SQL.replace("\n,\nsnap AS (", ",\nsnap AS (", 1)


@register("select_auto_detect", _AUTO_SQL)
def select_auto_detect(spark, sf_dir):
    from suitewise.operators import changes as B
    i = Inputs(spark, sf_dir)
    detected = B.uncommitted_files(X.file_snapshots(spark, sf_dir)).select("file_path")
    imp = D.impact_scores(i.mapping, i.imports, detected)
    sel = H.select_tests(H.priority_scores(i.history, i.scores, imp)).select("rank", KEY, "priority_score")
    return H.gate_on_changes(sel, detected)
