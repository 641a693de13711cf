"""Change impact (family D).

Inputs are tables: test files, source files, the change set (file paths),
test imports (test_file, import_name), history. Outputs are small keyed
tables joined downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitewise.operators.features import KEY, RECENT_ROWS, last_rows, test_file_of
from suitewise.operators.joins import contains_semi_join, within_semi_join

DIRECT_IMPACT = 1.0
IMPORT_IMPACT = 0.5


def _basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)", 1)


def test_source_map(test_files: DataFrame, source_files: DataFrame,
                    source_dir: str | None = None) -> DataFrame:
    """``test_X.py`` -> ``X.py`` (every ``test_`` removed from the file name, T12).

    The source lives in ``source_dir`` when given, else next to the test. Kept
    only when the source exists in ``source_files``.
    """
    name = _basename(F.col("test_file"))
    src_dir = F.lit(source_dir) if source_dir is not None else _dirname(F.col("test_file"))
    mapped = (test_files.select("test_file").distinct()
              .where(name.startswith("test_") & name.endswith(".py"))
              .select("test_file", F.concat(src_dir, F.replace(name, F.lit("test_"), F.lit("")))
                      .alias("source_file")))
    sources = source_files.select(F.col(source_files.columns[0]).alias("source_file"))
    return mapped.join(sources, "source_file", "left_semi").select("test_file", "source_file")


def path_to_module(path: Column) -> Column:
    """Drop every ``.py``, ``/`` and ``\\`` to ``.``, strip leading dots."""
    dotted = F.translate(F.replace(path, F.lit(".py"), F.lit("")), "/\\", "..")
    return F.regexp_replace(dotted, r"^\.+", "")


def direct_impact(mapping: DataFrame, changed: DataFrame) -> DataFrame:
    """D3: test files whose mapped source is in the change set -> 1.0."""
    ch = changed.select(F.col("file_path").alias("source_file")).distinct()
    return (mapping.join(ch, "source_file", "left_semi")
            .select("test_file", F.lit(DIRECT_IMPACT).alias("impact")))


def import_impact(mapping: DataFrame, imports: DataFrame, changed: DataFrame, exact: bool = False) -> DataFrame:
    """Mapped test files importing (by substring, T11) a changed module -> 0.5.

    With ``exact``, a module matches only itself and what lies below it, so that
    ``src.m1`` does not match ``src.m10``.

    The substring match runs over the imports first; the (small) mapping then
    filters the matched test files, so the mapping plan is not repeated inside
    the match.
    """
    modules = changed.select(path_to_module(F.col("file_path")).alias("module")).distinct()
    match = within_semi_join if exact else contains_semi_join
    hit = match(imports, "import_name", modules, "module").select("test_file").distinct()
    mapped = hit.join(mapping.select("test_file"), "test_file", "left_semi")
    return mapped.select("test_file", F.lit(IMPORT_IMPACT).alias("impact"))


def impact_scores(mapping: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """Max of direct and import impact per test file; zero rows dropped."""
    m = mapping.select("test_file", "source_file").distinct()  # one subtree, reused by both branches
    both = direct_impact(m, changed).unionByName(import_impact(m, imports, changed))
    return both.groupBy("test_file").agg(F.max("impact").alias("impact"))


def affected_tests(scores: DataFrame, threshold: float = 0.3) -> DataFrame:
    """D6."""
    return scores.where(F.col("impact") >= F.lit(threshold)).select("test_file", "impact")


def file_priority(history: DataFrame, scores: DataFrame) -> DataFrame:
    """Per test file, min(0.4 impact + 0.3 failure rate + 0.3 min(recent/5, 1), 1).

    Failure rate and recent failures (latest 10 rows) are taken over the
    file's own history rows.
    """
    by_file = history.groupBy("test_file").agg(
        (F.count_if(~F.col("passed")).cast("double") / F.count(F.lit(1)).cast("double")).alias("failure_rate"))
    recent = (last_rows(history, RECENT_ROWS, key="test_file")
              .groupBy("test_file").agg(F.count_if(~F.col("passed")).alias("recent_failures")))
    j = by_file.join(recent, "test_file").join(scores, "test_file", "left")
    impact = F.coalesce(F.col("impact"), F.lit(0.0))
    prio = (impact * F.lit(0.4) + F.col("failure_rate") * F.lit(0.3)
            + F.least(F.col("recent_failures").cast("double") / F.lit(5.0), F.lit(1.0)) * F.lit(0.3))
    return j.select("test_file", impact.alias("impact"), "failure_rate", "recent_failures",
                    F.least(prio, F.lit(1.0)).alias("priority"))


def change_summary(changed: DataFrame, diff_stats: DataFrame, scores: DataFrame,
                   high: float = 0.7) -> DataFrame:
    """One row: files changed, lines added / removed, affected and high-impact test files.

    The test-file lists are bounded by the number of test files; the change
    set itself is only counted.
    """
    files = changed.select("file_path").distinct()
    stats = files.join(diff_stats, "file_path", "left").select(
        F.lit(True).alias("is_file"), "lines_added", "lines_removed",
        F.lit(None).cast("string").alias("test_file"), F.lit(None).cast("double").alias("impact"))
    tests = scores.select(F.lit(False).alias("is_file"), F.lit(None).cast("bigint").alias("lines_added"),
                          F.lit(None).cast("bigint").alias("lines_removed"), "test_file", "impact")
    return stats.unionByName(tests).agg(
        F.count_if(F.col("is_file")).alias("num_files_changed"),
        F.coalesce(F.sum("lines_added"), F.lit(0)).cast("bigint").alias("total_lines_added"),
        F.coalesce(F.sum("lines_removed"), F.lit(0)).cast("bigint").alias("total_lines_removed"),
        F.array_sort(F.collect_list("test_file")).alias("affected_tests"),
        F.array_sort(F.collect_list(F.when(F.col("impact") >= high, F.col("test_file"))))
        .alias("high_priority_tests"))


def changed_file_list(changed: DataFrame, diff_stats: DataFrame) -> DataFrame:
    """The changed files as rows, with the lines added and removed in each."""
    files = changed.select("file_path").distinct()
    return files.join(diff_stats, "file_path", "left").select(
        "file_path", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("lines_added", "lines_removed")])


def related_tests(mapping: DataFrame, sources: DataFrame) -> DataFrame:
    """Test files mapped to each given source file."""
    s = sources.select(F.col(sources.columns[0]).alias("source_file")).distinct()
    return mapping.join(s, "source_file").select("source_file", "test_file")


def estimated_time(test_files: DataFrame, history: DataFrame, file_sizes: DataFrame) -> DataFrame:
    """Known mean time of the file, else 0.1 s per 1,000 bytes, else 0; one total row."""
    known = history.groupBy("test_file").agg(
        (F.sum("execution_time").cast("double") / F.count(F.lit(1))).alias("avg_time"))
    files = test_files.select("test_file").distinct()
    per_file = (files.join(known, "test_file", "left").join(file_sizes, "test_file", "left")
                .select("test_file",
                        F.coalesce(F.col("avg_time"),
                                   F.lit(0.1) * (F.col("size_bytes").cast("double") / F.lit(1000.0)),
                                   F.lit(0.0)).alias("est_time")))
    return per_file.agg(F.round(F.sum("est_time"), 6).alias("total_time"),
                        F.count(F.lit(1)).alias("n_files"))


def test_impact(tests: DataFrame, scores: DataFrame) -> DataFrame:
    """Impact of every test id through its test file (0 when absent)."""
    t = tests.select(KEY).withColumn("test_file", test_file_of(F.col(KEY)))
    return (t.join(scores, "test_file", "left")
            .select(KEY, F.coalesce(F.col("impact"), F.lit(0.0)).alias("impact")))


def impact_scores_by(mapping: DataFrame, imports: DataFrame, changed: DataFrame,
                     by: list[str]) -> DataFrame:
    """D5 for several change sets at once: ``changed`` is (by..., file_path).

    Direct impact is an equi-join on the mapped source; import impact keeps
    which module matched (exploded substring join) and joins it back to the
    change sets that contain that module.
    """
    from suitewise.operators.joins import contains_pairs
    mapping = mapping.select("test_file", "source_file").distinct()
    ch = changed.select(*by, "file_path").distinct()
    direct = (mapping.join(ch.withColumnRenamed("file_path", "source_file"), "source_file")
              .select(*by, "test_file", F.lit(DIRECT_IMPACT).alias("impact")))
    modules = ch.select(*by, path_to_module(F.col("file_path")).alias("module")).distinct()
    pairs = contains_pairs(imports, "import_name", modules.select("module").distinct(), "module")
    hits = (imports.join(pairs, imports["import_name"] == pairs["_v"])
            .select("test_file", F.col("_piece").alias("module")).distinct()
            .join(mapping.select("test_file"), "test_file", "left_semi")
            .join(modules, "module")
            .select(*by, "test_file", F.lit(IMPORT_IMPACT).alias("impact")))
    return direct.unionByName(hits).groupBy(*by, "test_file").agg(F.max("impact").alias("impact"))
