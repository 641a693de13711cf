"""Queries for change sets and diffs (B) and the change summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitewise.operators import changes as B
from suitewise.operators import impact as D
from suitewise.plans.inputs import Inputs
from suitewise.plans.oracle_fixtures import _cte, with_ctes
from suitewise.plans.registry import register
from suitewise.sources import fixtures as X

_cte("dl", """
SELECT concat('src/d', CAST(doc_id AS STRING), '.py') AS file_path, pos,
  concat(CASE pos % 5 WHEN 0 THEN concat('@@ -', CAST(pos * 10 + 1 AS STRING), ',1 +', CAST(pos * 10 + 1 AS STRING),
    CASE WHEN (doc_id + pos) % 3 = 0 THEN '' WHEN (doc_id + pos) % 3 = 1 THEN ',0' ELSE ',4' END, ' @@ ')
  WHEN 3 THEN '-' ELSE '+' END, line) AS line
FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos,
  unnest(string_split(text, chr(10))) AS line FROM documents) x
""")

_cte("tl", """
SELECT file_path, pos, kind,
  CAST(sum(CASE WHEN kind = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hunk, line
FROM (SELECT file_path, pos, line,
  CASE WHEN starts_with(line, '@@') THEN 'header'
       WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN 'add'
       WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN 'remove'
       ELSE 'other' END AS kind FROM dl) k
""", ("dl",))

_cte("hr", """
SELECT file_path, hunk, toks[1] AS old_range, coalesce(toks[2], '') AS new_range FROM (
  SELECT file_path, hunk,
    string_split_regex(regexp_replace(split_part(line, '@@', 2), '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks
  FROM tl WHERE kind = 'header') x
""", ("tl",))

_cte("fds", """
SELECT file_path, count_if(kind = 'add') AS lines_added, count_if(kind = 'remove') AS lines_removed,
  least(count_if(kind = 'add'), count_if(kind = 'remove')) AS lines_modified
FROM (SELECT file_path, CASE WHEN starts_with(line, '@@') THEN 'header'
       WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN 'add'
       WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN 'remove'
       ELSE 'other' END AS kind FROM dl) k
GROUP BY file_path
""", ("dl",))

_cte("snap", """
SELECT 'base' AS version, concat('src/d', CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '.md' ELSE '.py' END) AS file_path,
  md5(text) AS content_hash FROM documents WHERE doc_id % 5 <> 0
UNION ALL
SELECT 'head', concat('src/d', CAST(doc_id AS STRING), CASE WHEN doc_id % 4 = 0 THEN '.md' ELSE '.py' END),
  md5(CASE WHEN doc_id % 3 = 0 THEN concat(text, '!') ELSE text END) FROM documents WHERE doc_id % 7 <> 0
""")


def _diff(spark, sf_dir):
    return X.diff_lines(spark, sf_dir)


@register("snapshot_diff", with_ctes(["snap"], """
SELECT coalesce(b.file_path, h.file_path) AS file_path,
  CASE WHEN b.content_hash IS NULL THEN 'added' WHEN h.content_hash IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM (SELECT * FROM snap WHERE version = 'base') b
FULL OUTER JOIN (SELECT * FROM snap WHERE version = 'head') h USING (file_path)
WHERE b.content_hash IS DISTINCT FROM h.content_hash AND ends_with(coalesce(b.file_path, h.file_path), '.py')"""))
def snapshot_diff(spark, sf_dir):
    return B.snapshot_diff(X.file_snapshots(spark, sf_dir))


@register("uncommitted_files", with_ctes(["snap"], """
SELECT file_path, kind FROM (
  SELECT b.file_path, 'tracked' AS kind FROM (SELECT * FROM snap WHERE version = 'base') b
  LEFT JOIN (SELECT * FROM snap WHERE version = 'head') h USING (file_path)
  WHERE b.content_hash IS DISTINCT FROM h.content_hash
  UNION ALL
  SELECT h.file_path, 'untracked' FROM (SELECT * FROM snap WHERE version = 'head') h
  WHERE h.file_path NOT IN (SELECT file_path FROM snap WHERE version = 'base')) u
WHERE ends_with(file_path, '.py')"""))
def uncommitted_files(spark, sf_dir):
    return B.uncommitted_files(X.file_snapshots(spark, sf_dir))


@register("diff_lines_typed", with_ctes(["tl"], "SELECT file_path, pos, kind, hunk, line FROM tl"))
def diff_lines_typed(spark, sf_dir):
    return B.typed_lines(_diff(spark, sf_dir))


@register("diff_hunks", with_ctes(["hr"], "SELECT file_path, hunk, old_range, new_range FROM hr"))
def diff_hunks(spark, sf_dir):
    return B.hunk_ranges(B.header_lines(_diff(spark, sf_dir)))


@register("hunk_changes", with_ctes(["tl"], """
SELECT file_path, hunk, count(*) FILTER (kind IN ('add', 'remove')) AS n_changes,
  coalesce(string_agg(kind || ':' || substring(line, 2), chr(10) ORDER BY pos)
    FILTER (kind IN ('add', 'remove')), '') AS changes
FROM tl WHERE hunk > 0 GROUP BY file_path, hunk"""))
def hunk_changes(spark, sf_dir):
    return B.hunk_changes(B.typed_lines(_diff(spark, sf_dir)))


@register("file_diff_stats", with_ctes(["fds"], "SELECT * FROM fds"))
def file_diff_stats(spark, sf_dir):
    return B.file_diff_stats(_diff(spark, sf_dir))


@register("change_magnitude", with_ctes(["snap", "fds"], """
SELECT f.file_path, CASE WHEN s.file_path IS NULL THEN 0.0
  ELSE least(CAST(s.lines_added + s.lines_removed AS DOUBLE) / 100.0, 1.0) END AS magnitude
FROM (SELECT DISTINCT file_path FROM snap WHERE version = 'head') f LEFT JOIN fds s USING (file_path)"""))
def change_magnitude(spark, sf_dir):
    snaps = X.file_snapshots(spark, sf_dir)
    files = snaps.where(F.col("version") == "head").select("file_path")
    return B.change_magnitude(files, B.file_diff_stats(_diff(spark, sf_dir)))


@register("changed_lines", with_ctes(["hr"], """
SELECT DISTINCT file_path, unnest(range(st, st + n)) AS line_no FROM (
  SELECT file_path, CAST(string_split(substring(new_range, 2), ',')[1] AS BIGINT) AS st,
    CAST(coalesce(string_split(substring(new_range, 2), ',')[2], '1') AS BIGINT) AS n
  FROM hr WHERE starts_with(new_range, '+')) x WHERE n > 0"""))
def changed_lines(spark, sf_dir):
    return B.changed_line_numbers(B.hunk_ranges(B.header_lines(_diff(spark, sf_dir))))


@register("file_diff_lookup", with_ctes(["dl"], "SELECT file_path, pos, line FROM dl WHERE file_path = 'src/d7.py'"))
def file_diff_lookup(spark, sf_dir):
    return B.file_diff(_diff(spark, sf_dir), "src/d7.py")


@register("change_summary", with_ctes(["cf", "dl", "fds", "imp"], """
SELECT (SELECT count(*) FROM (SELECT file_path FROM cf UNION SELECT file_path FROM dl) x) AS num_files_changed,
  (SELECT CAST(coalesce(sum(lines_added), 0) AS BIGINT) FROM fds) AS total_lines_added,
  (SELECT CAST(coalesce(sum(lines_removed), 0) AS BIGINT) FROM fds) AS total_lines_removed,
  (SELECT coalesce(list_sort(list(test_file)), []) FROM imp) AS affected_tests,
  (SELECT coalesce(list_sort(list(test_file) FILTER (WHERE impact >= 0.7)), []) FROM imp) AS high_priority_tests"""))
def change_summary(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    diff = _diff(spark, sf_dir)
    changed = i.changed.unionByName(diff.select("file_path")).distinct()
    return D.change_summary(changed, B.file_diff_stats(diff), i.impact)


@register("change_summary_files", with_ctes(["cf", "dl", "fds"], """
SELECT x.file_path, CAST(coalesce(s.lines_added, 0) AS BIGINT) AS lines_added,
  CAST(coalesce(s.lines_removed, 0) AS BIGINT) AS lines_removed
FROM (SELECT file_path FROM cf UNION SELECT file_path FROM dl) x LEFT JOIN fds s USING (file_path)"""))
def change_summary_files(spark, sf_dir):
    diff = _diff(spark, sf_dir)
    changed = Inputs(spark, sf_dir).changed.unionByName(diff.select("file_path"))
    return D.changed_file_list(changed, B.file_diff_stats(diff))
