"""Change sets and diffs (family B).

Snapshots are (version, file_path, content_hash) tables; a diff is a table of
(file_path, pos, line) rows of unified-diff text. Git itself is not called:
the tables are the interface.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitewise.operators.ordered import running_totals

# Hunk header marker and line prefixes of a unified diff (fixed values)
HUNK_MARK = "@@"
ADD, REMOVE = "+", "-"
ADD_HEADER, REMOVE_HEADER = "+++", "---"
MAGNITUDE_LINES = 100.0


def _py(path: Column) -> Column:
    return path.endswith(".py")


def snapshot_diff(snapshots: DataFrame, base: str = "base", head: str = "head") -> DataFrame:
    """B1: .py paths whose content differs between two versions (added, removed, modified)."""
    b = snapshots.where(F.col("version") == base).select("file_path", F.col("content_hash").alias("h1"))
    h = snapshots.where(F.col("version") == head).select("file_path", F.col("content_hash").alias("h2"))
    j = b.join(h, "file_path", "full_outer")
    status = (F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed")
              .otherwise("modified"))
    return (j.where(~F.col("h1").eqNullSafe(F.col("h2")) & _py(F.col("file_path")))
            .select("file_path", status.alias("status")))


def uncommitted_files(snapshots: DataFrame, tracked: str = "base", working: str = "head") -> DataFrame:
    """B2: tracked files changed in the working copy, plus untracked files; .py only."""
    b = snapshots.where(F.col("version") == tracked).select("file_path", F.col("content_hash").alias("h1"))
    w = snapshots.where(F.col("version") == working).select("file_path", F.col("content_hash").alias("h2"))
    changed = (b.join(w, "file_path", "left").where(~F.col("h1").eqNullSafe(F.col("h2")))
               .select("file_path", F.lit("tracked").alias("kind")))
    untracked = w.join(b, "file_path", "left_anti").select("file_path", F.lit("untracked").alias("kind"))
    return changed.unionByName(untracked).where(_py(F.col("file_path")))


def line_kind(line: Column) -> Column:
    return (F.when(line.startswith(HUNK_MARK), "header")
            .when(line.startswith(ADD) & ~line.startswith(ADD_HEADER), "add")
            .when(line.startswith(REMOVE) & ~line.startswith(REMOVE_HEADER), "remove")
            .otherwise("other"))


def typed_lines(diff: DataFrame) -> DataFrame:
    """Kind per line and hunk number = headers seen so far in the file (0 before the first).

    A running count per file without a window per file: one global order
    (file, pos) with a start marker per file; hunk = headers counted since the
    file's start marker, a segmented prefix sum carried in the same pass, so one
    huge diff is split across tasks and no line is joined to its file's start.
    """
    k = diff.select("file_path", "pos", "line", line_kind(F.col("line")).alias("kind"))
    real = k.select("*", F.lit(1).alias("_kind"), (F.col("kind") == "header").cast("int").alias("_h"),
                    F.lit(False).alias("_sf"))
    start = k.select("file_path").distinct().select(
        "file_path", F.lit(None).cast(diff.schema["pos"].dataType).alias("pos"), F.lit(None).cast("string").alias("line"),
        F.lit(None).cast("string").alias("kind"), F.lit(0).alias("_kind"), F.lit(0).alias("_h"), F.lit(True).alias("_sf"))
    c = running_totals(real.unionByName(start), [F.col("file_path"), F.col("_kind"), F.col("pos")], ["_h"],
                       at_last={"_sf": ["_h"]})
    return c.where(F.col("_kind") == 1).select(
        "file_path", "pos", "kind", (F.col("cum__h") - F.col("_sf__h")).cast("bigint").alias("hunk"), "line")


def header_lines(diff: DataFrame) -> DataFrame:
    """Only the ``@@`` lines, numbered: a header's hunk number is its rank among the
    file's headers, so hunk ranges never need the body lines."""
    return typed_lines(diff.where(F.col("line").startswith(HUNK_MARK)))


def hunk_ranges(typed: DataFrame) -> DataFrame:
    """Old and new range = first two whitespace tokens between the ``@@`` marks."""
    inner = F.regexp_replace(F.element_at(F.split(F.col("line"), HUNK_MARK, -1), 2), r"^\s+|\s+$", "")
    toks = F.split(inner, r"\s+")
    return (typed.where(F.col("kind") == "header")
            .select("file_path", "hunk", F.element_at(toks, 1).alias("old_range"),
                    F.coalesce(F.try_element_at(toks, F.lit(2)), F.lit("")).alias("new_range")))


def hunk_changes(typed: DataFrame) -> DataFrame:
    """Per hunk, the ordered (op, text) changes as count and joined text; hunks without changes included."""
    ch = typed.where(F.col("hunk") > 0)
    g = ch.groupBy("file_path", "hunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("add", "remove"), F.struct(
            "pos", "kind", F.expr("substring(line, 2)").alias("text")))))
        .alias("c"))
    return g.select("file_path", "hunk", F.size("c").cast("bigint").alias("n_changes"),
                    F.array_join(F.transform("c", lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "\n")
                    .alias("changes"))


def file_diff_stats(diff: DataFrame) -> DataFrame:
    """Lines added, removed and modified = least(added, removed) per file."""
    k = line_kind(F.col("line"))
    g = diff.groupBy("file_path").agg(F.count_if(k == "add").alias("lines_added"),
                                      F.count_if(k == "remove").alias("lines_removed"))
    return g.select("file_path", "lines_added", "lines_removed",
                    F.least("lines_added", "lines_removed").alias("lines_modified"))


def change_magnitude(files: DataFrame, stats: DataFrame) -> DataFrame:
    """min((added + removed) / 100, 1) per file; 0 when the file has no diff."""
    j = files.select("file_path").distinct().join(stats, "file_path", "left")
    mag = F.least((F.col("lines_added") + F.col("lines_removed")).cast("double") / F.lit(MAGNITUDE_LINES),
                  F.lit(1.0))
    # least() skips NULLs, so a file without a diff must be caught before it
    return j.select("file_path", F.when(F.col("lines_added").isNull(), F.lit(0.0)).otherwise(mag)
                    .alias("magnitude"))


def changed_line_numbers(ranges: DataFrame) -> DataFrame:
    """New-side line numbers ``start .. start+count-1`` (count default 1), as a set."""
    r = ranges.where(F.col("new_range").startswith("+"))
    parts = F.split(F.expr("substring(new_range, 2)"), ",")
    start = F.element_at(parts, 1).cast("bigint")
    count = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).cast("bigint")
    x = r.select("file_path", start.alias("start"), count.alias("n")).where(F.col("n") > 0)
    return (x.select("file_path", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1))
                     .alias("line_no")).distinct())


def file_diff(diff: DataFrame, path: str) -> DataFrame:
    """The diff rows of one file (an equality filter the scan can take)."""
    return diff.where(F.col("file_path") == F.lit(path))
