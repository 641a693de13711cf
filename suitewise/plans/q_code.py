"""Queries for code structure (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitewise.operators import code as C
from suitewise.plans.oracle_fixtures import _cte, with_ctes
from suitewise.plans.registry import register
from suitewise.sources import fixtures as X

_cte("ce", """
SELECT concat('src/f', CAST(l_orderkey // 16 AS STRING), '.py') AS file_path,
  version,
  CASE WHEN l_linestatus = 'F' THEN 'class' ELSE 'function' END AS kind,
  concat('e', CAST(l_partkey % 7 AS STRING)) AS name,
  l_orderkey * 10 + l_linenumber AS seq_a, l_partkey AS seq_b, l_suppkey AS seq_c,
  l_extendedprice AS seq_d, l_shipdate AS seq_e,
  CAST(l_linenumber AS BIGINT) * 10 AS line_start,
  CAST(l_linenumber AS BIGINT) * 10 + CAST(l_quantity AS BIGINT) AS line_end,
  1 + CAST(l_quantity AS BIGINT) % 5 AS complexity
FROM lineitem JOIN (VALUES ('old', 'R'), ('new', 'A')) AS v(version, absent) ON l_returnflag <> absent
""")

_cte("cimp", """
SELECT DISTINCT concat('src/f', CAST(l_orderkey // 16 AS STRING), '.py') AS file_path,
  version,
  concat('pkg', CAST(l_suppkey % 9 AS STRING)) AS import_name
FROM lineitem JOIN (VALUES ('old', 'R'), ('new', 'A')) AS v(version, absent) ON l_returnflag <> absent
""")

_cte("el", """
SELECT file_path, version, kind, name, line_start, line_end, complexity FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path, version, kind, name
    ORDER BY seq_a DESC, seq_b DESC, seq_c DESC, seq_d DESC, seq_e DESC) AS rn FROM ce) x WHERE rn = 1
""", ("ce",))

_cte("fb", "SELECT file_path FROM el GROUP BY file_path HAVING count(DISTINCT version) = 2", ("el",))

_cte("echg", """
SELECT n.file_path, n.kind, n.name, 'added' AS status FROM el n
WHERE n.version = 'new' AND n.file_path IN (SELECT file_path FROM fb)
  AND NOT EXISTS (SELECT 1 FROM el o WHERE o.version = 'old' AND o.kind = n.kind AND o.file_path = n.file_path AND o.name = n.name)
UNION ALL
SELECT o.file_path, o.kind, o.name, 'removed' FROM el o
WHERE o.version = 'old' AND o.file_path IN (SELECT file_path FROM fb)
  AND NOT EXISTS (SELECT 1 FROM el n WHERE n.version = 'new' AND n.kind = o.kind AND n.file_path = o.file_path AND n.name = o.name)
UNION ALL
SELECT o.file_path, o.kind, o.name, 'modified' FROM el o JOIN el n
  ON o.file_path = n.file_path AND o.kind = n.kind AND o.name = n.name
WHERE o.version = 'old' AND n.version = 'new' AND o.line_end - o.line_start <> n.line_end - n.line_start
""", ("el", "fb"))

_cte("ftot", """
SELECT file_path, version, max(line_end) AS total_lines, sum(complexity) AS complexity_score FROM ce GROUP BY 1, 2
""", ("ce",))

_cte("fdelta", """
SELECT o.file_path, abs(n.total_lines - o.total_lines) AS lines_changed,
  n.complexity_score - o.complexity_score AS complexity_delta
FROM ftot o JOIN ftot n ON o.file_path = n.file_path AND o.version = 'old' AND n.version = 'new'
""", ("ftot",))

def _elements(spark, sf_dir):
    return X.code_elements(spark, sf_dir)


def _latest(spark, sf_dir):
    return C.element_latest(_elements(spark, sf_dir))


@register("element_latest", with_ctes(["el"], "SELECT * FROM el"))
def element_latest(spark, sf_dir):
    return _latest(spark, sf_dir)


@register("functions_added", with_ctes(["echg"], """
SELECT file_path, name FROM echg WHERE kind = 'function' AND status = 'added'"""))
def functions_added(spark, sf_dir):
    return C.elements_added(_latest(spark, sf_dir), "function")


@register("functions_removed", with_ctes(["echg"], """
SELECT file_path, name FROM echg WHERE kind = 'function' AND status = 'removed'"""))
def functions_removed(spark, sf_dir):
    return C.elements_removed(_latest(spark, sf_dir), "function")


@register("functions_modified", with_ctes(["el"], """
SELECT file_path, name FROM (
  SELECT file_path, name, max(line_end - line_start) FILTER (WHERE version = 'old') AS old_span,
    max(line_end - line_start) FILTER (WHERE version = 'new') AS new_span
  FROM el WHERE kind = 'function' GROUP BY file_path, name) x
WHERE old_span <> new_span"""))
def functions_modified(spark, sf_dir):
    return C.elements_modified(_latest(spark, sf_dir), "function")


@register("class_changes", with_ctes(["echg"], """
SELECT file_path, name, status FROM echg WHERE kind = 'class'"""))
def class_changes(spark, sf_dir):
    return C.element_changes(_latest(spark, sf_dir), "class")


@register("imports_added", with_ctes(["cimp"], """
SELECT file_path, import_name FROM cimp WHERE version = 'new'
EXCEPT SELECT file_path, import_name FROM cimp WHERE version = 'old'"""))
def imports_added(spark, sf_dir):
    return C.imports_diff(X.code_imports(spark, sf_dir), added=True)


@register("imports_removed", with_ctes(["cimp"], """
SELECT file_path, import_name FROM cimp WHERE version = 'old'
EXCEPT SELECT file_path, import_name FROM cimp WHERE version = 'new'"""))
def imports_removed(spark, sf_dir):
    return C.imports_diff(X.code_imports(spark, sf_dir), added=False)


@register("elements_common", with_ctes(["el"], """
SELECT file_path, kind, name FROM el WHERE version = 'old'
INTERSECT SELECT file_path, kind, name FROM el WHERE version = 'new'"""))
def elements_common(spark, sf_dir):
    return C.elements_common(_latest(spark, sf_dir))


@register("file_complexity", with_ctes(["ftot"], "SELECT * FROM ftot"))
def file_complexity(spark, sf_dir):
    return C.file_totals(_elements(spark, sf_dir))


@register("file_version_delta", with_ctes(["fdelta"], "SELECT * FROM fdelta"))
def file_version_delta(spark, sf_dir):
    return C.version_delta(C.file_totals(_elements(spark, sf_dir)))


_LISTS = ("functions_added", "functions_removed", "functions_modified", "classes_added",
          "classes_removed", "classes_modified", "imports_added", "imports_removed")

_FILE_CMP_SQL = """
SELECT d.file_path, {lists}, d.lines_changed, d.complexity_delta
FROM fdelta d LEFT JOIN (
  SELECT file_path, {aggs} FROM (
    SELECT file_path, CASE kind WHEN 'function' THEN 'functions_' ELSE 'classes_' END || status AS list, name FROM echg
    UNION ALL
    SELECT file_path, 'imports_added', import_name FROM (
      SELECT file_path, import_name FROM cimp WHERE version = 'new'
      EXCEPT SELECT file_path, import_name FROM cimp WHERE version = 'old') a
    UNION ALL
    SELECT file_path, 'imports_removed', import_name FROM (
      SELECT file_path, import_name FROM cimp WHERE version = 'old'
      EXCEPT SELECT file_path, import_name FROM cimp WHERE version = 'new') r) u
  GROUP BY file_path) l USING (file_path)""".format(
    lists=", ".join(f"coalesce(l.{n}, CAST([] AS VARCHAR[])) AS {n}" for n in _LISTS),
    aggs=", ".join(f"list_sort(list(name) FILTER (WHERE list = '{n}')) AS {n}" for n in _LISTS))


@register("file_comparison", with_ctes(["echg", "cimp", "fdelta"], _FILE_CMP_SQL))
def file_comparison(spark, sf_dir):
    return C.file_comparison(_elements(spark, sf_dir), X.code_imports(spark, sf_dir))


@register("changed_elements", with_ctes(["echg"], "SELECT DISTINCT file_path, name FROM echg"))
def changed_elements(spark, sf_dir):
    return C.changed_elements(_elements(spark, sf_dir))
