"""Diffs and snapshots (B), traps T13, T15."""

from suitewise.operators import changes as B

DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@ def f():
-old line
+new line
+another
@@ -10 +11,0 @@
-gone
+++plus-plus line
@@ -20,4 +21 @@
 context"""


def diff_df(spark, text, path="x.py"):
    rows = [(path, i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file_path string, pos bigint, line string")


def test_parse_counts_and_hunks(spark):
    d = diff_df(spark, DIFF)
    stats = B.file_diff_stats(d).collect()[0]
    # An added line whose text starts with '++' looks like a file header and is not counted
    assert (stats["lines_added"], stats["lines_removed"], stats["lines_modified"]) == (2, 2, 2)
    ranges = [(r["hunk"], r["old_range"], r["new_range"]) for r in
              B.hunk_ranges(B.typed_lines(d)).orderBy("hunk").collect()]
    assert ranges == [(1, "-1,2", "+1,3"), (2, "-10", "+11,0"), (3, "-20,4", "+21")]
    ch = {r["hunk"]: (r["n_changes"], r["changes"]) for r in B.hunk_changes(B.typed_lines(d)).collect()}
    assert ch[1] == (3, "remove:old line\nadd:new line\nadd:another") and ch[2] == (1, "remove:gone")


def test_changed_lines_set(spark):
    d = diff_df(spark, DIFF)
    got = sorted(r["line_no"] for r in B.changed_line_numbers(B.hunk_ranges(B.typed_lines(d))).collect())
    assert got == [1, 2, 3, 21]          # +1,3 -> 1..3; +11,0 -> none; +21 -> count 1


def test_magnitude(spark):
    d = diff_df(spark, DIFF)
    files = spark.createDataFrame([("x.py",), ("y.py",)], "file_path string")
    got = {r[0]: r[1] for r in B.change_magnitude(files, B.file_diff_stats(d)).collect()}
    assert got == {"x.py": 0.04, "y.py": 0.0}


def test_snapshot_diff_and_uncommitted(spark):
    snaps = spark.createDataFrame([
        ("base", "a.py", "1"), ("head", "a.py", "2"),      # modified
        ("base", "b.py", "1"), ("head", "b.py", "1"),      # same
        ("base", "c.py", "1"),                             # removed
        ("head", "d.py", "1"),                             # added / untracked
        ("base", "e.md", "1"), ("head", "e.md", "2"),      # not python
    ], "version string, file_path string, content_hash string")
    got = sorted(tuple(r) for r in B.snapshot_diff(snaps).collect())
    assert got == [("a.py", "modified"), ("c.py", "removed"), ("d.py", "added")]
    unc = sorted(tuple(r) for r in B.uncommitted_files(snaps).collect())
    assert unc == [("a.py", "tracked"), ("c.py", "tracked"), ("d.py", "untracked")]
