"""Reference-shaped inputs derived from the driver's tables.

The product works on CI history (one row per run x test), change sets, code
elements, diffs and event streams. The driver ships TPC-H-like tables, so each
function here derives one input from them with plain DataFrame operations.
Every derivation reads whole tables; the predicates below define the content
of a fixture (which files changed, which version a row belongs to), not a
sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suitewise.sources.tables import read_table


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _k(props: Column) -> Column:
    return F.regexp_extract(props, r"([0-9]+)", 1).try_cast("bigint")


def test_history_from_events(events: DataFrame, label: Column | None = None) -> DataFrame:
    """One row per (run, test) execution, keyed by ``full_test_name``."""
    b = events.select("event_id", "ts", "user_id", "event_type", "value",
                      _k(F.col("props")).alias("k"))
    m = F.col("user_id") % 12
    test_file = F.concat(F.lit("tests/test_m"), _s(m), F.lit(".py"))
    passed = (F.col("event_type") != "error") if label is None else label
    return b.select(
        F.col("event_id").alias("exec_id"),
        F.dayofmonth("ts").cast("bigint").alias("run_id"),
        F.col("ts").alias("run_ts"),
        test_file.alias("test_file"),
        F.concat(F.lit("test_c"), _s("user_id")).alias("test_name"),
        F.concat(test_file, F.lit("::test_c"), _s("user_id")).alias("full_test_name"),
        F.concat(F.lit("src/m"), _s(m), F.lit(".py")).alias("source_file"),
        passed.alias("passed"),
        F.col("value").cast("decimal(12,2)").alias("execution_time"),
        (F.lit(0.70).cast("decimal(3,2)") + (F.col("k") % 26) * F.lit(0.01).cast("decimal(3,2)"))
        .cast("decimal(4,2)").alias("coverage"),
        F.when(F.col("k") < 40, F.lit(0).cast("bigint")).otherwise(F.col("k")).alias("lines_changed"),
        F.when(F.col("k") < 40, F.lit(0).cast("bigint"))
        .otherwise((F.lit(1) + F.floor(F.col("k") / 10)).cast("bigint")).alias("functions_changed"),
        F.concat(F.lit("src/m"), _s(F.col("k") % 12), F.lit(".py,src/m"),
                 _s((F.col("k") + 5) % 12), F.lit(".py")).alias("files_changed"),
        ((F.col("user_id") % 10) == 0).alias("is_flaky"),
    )


def test_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_history_from_events(read_table(spark, sf_dir, "events"))


def model_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History whose outcome depends on change size and test (the raw events carry no signal)."""
    events = read_table(spark, sf_dir, "events")
    k = F.col("k")  # parsed from props inside the history derivation
    label = ~(((k >= 75) & ((F.col("user_id") % 3) != 0)) | ((F.col("event_id") % 20) == 0))
    return test_history_from_events(events, label=label)


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("s_suppkey") % 12
    return (read_table(spark, sf_dir, "supplier", "s_suppkey")
            .where(m.isin(1, 4, 7))
            .select(F.concat(F.lit("src/m"), _s(m), F.lit(".py")).alias("file_path"))
            .distinct())


def test_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_linenumber")
    own = (F.col("l_partkey") % 12) == ((F.col("l_suppkey") * 5 + 2) % 12)
    return (li.select(F.concat(F.lit("tests/test_m"), _s(F.col("l_suppkey") % 12), F.lit(".py"))
                      .alias("test_file"),
                      F.concat(F.when(own, "src.m").otherwise("lib.m"), _s(F.col("l_partkey") % 12),
                               F.lit(".e"), _s("l_linenumber")).alias("import_name"))
            .distinct())


def test_files(history: DataFrame) -> DataFrame:
    return history.select("test_file").distinct()


def source_files(history: DataFrame) -> DataFrame:
    return history.select("source_file").where(F.col("source_file") != "src/m5.py").distinct()


def candidate_tests(spark: SparkSession, sf_dir: str, history: DataFrame) -> DataFrame:
    new = (read_table(spark, sf_dir, "nation", "n_nationkey")
           .select(F.concat(F.lit("tests/test_m1.py::test_new"),
                            _s(F.col("n_nationkey") + 1)).alias("full_test_name")))
    return history.select("full_test_name").distinct().unionByName(new)


def failure_scores(history: DataFrame) -> DataFrame:
    """Stand-in for model output: smoothed failure share per test."""
    return history.groupBy("full_test_name").agg(
        ((F.count_if(~F.col("passed")) + 1) / (F.count(F.lit(1)) + 2).cast("double"))
        .alias("failure_probability"))


def change_map(history: DataFrame) -> DataFrame:
    """Per test file: largest change size among the rows of its latest run.

    ``max(struct(run_id, x))`` picks the largest x inside the largest run in one
    partial aggregation; no window over the whole file's history.
    """
    g = history.groupBy("test_file").agg(
        F.max(F.struct("run_id", "lines_changed")).alias("l"),
        F.max(F.struct("run_id", "functions_changed")).alias("f"))
    return g.select("test_file", F.col("l.lines_changed").alias("lines_changed"),
                    F.col("f.functions_changed").alias("functions_changed"))


def _lineitem_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row with its version: A rows are old, R rows new, all others stand in both."""
    versions = (F.when(F.col("l_returnflag") == "A", F.array(F.lit("old")))
                .when(F.col("l_returnflag") == "R", F.array(F.lit("new")))
                .otherwise(F.array(F.lit("old"), F.lit("new"))))
    return read_table(spark, sf_dir, "lineitem").withColumn("version", F.explode(versions))


def _code_file() -> Column:
    """One file per 16 order keys, so that files grow in number and not in size."""
    return F.concat(F.lit("src/f"), _s(F.floor(F.col("l_orderkey") / 16)), F.lit(".py")).alias("file_path")


def code_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem_versions(spark, sf_dir)
    return li.select(
        _code_file(),
        "version",
        F.when(F.col("l_linestatus") == "F", "class").otherwise("function").alias("kind"),
        F.concat(F.lit("e"), _s(F.col("l_partkey") % 7)).alias("name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq_a"),
        F.col("l_partkey").alias("seq_b"), F.col("l_suppkey").alias("seq_c"),
        F.col("l_extendedprice").alias("seq_d"), F.col("l_shipdate").alias("seq_e"),
        (F.col("l_linenumber").cast("bigint") * 10).alias("line_start"),
        (F.col("l_linenumber").cast("bigint") * 10 + F.col("l_quantity").cast("bigint")).alias("line_end"),
        (F.lit(1) + F.col("l_quantity").cast("bigint") % 5).alias("complexity"),
    )


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem_versions(spark, sf_dir)
    return li.select(
        _code_file(),
        "version",
        F.concat(F.lit("pkg"), _s(F.col("l_suppkey") % 9)).alias("import_name"),
    ).distinct()


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified-diff lines, one row per (file, position)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    x = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pos, did = F.col("pos").cast("bigint"), F.col("doc_id")
    head = F.concat(F.lit("@@ -"), _s(pos * 10 + 1), F.lit(",1 +"), _s(pos * 10 + 1),
                    F.when((did + pos) % 3 == 0, "").when((did + pos) % 3 == 1, ",0").otherwise(",4"),
                    F.lit(" @@ "))
    prefix = F.when(pos % 5 == 0, head).when(pos % 5 == 3, "-").otherwise("+")
    return x.select(F.concat(F.lit("src/d"), _s(did), F.lit(".py")).alias("file_path"),
                    pos.alias("pos"), F.concat(prefix, F.col("line")).alias("line"))


def file_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    path = F.concat(F.lit("src/d"), _s("doc_id"),
                    F.when(F.col("doc_id") % 4 == 0, ".md").otherwise(".py"))
    base = docs.where(F.col("doc_id") % 5 != 0).select(
        F.lit("base").alias("version"), path.alias("file_path"), F.md5("text").alias("content_hash"))
    head = docs.where(F.col("doc_id") % 7 != 0).select(
        F.lit("head").alias("version"), path.alias("file_path"),
        F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
        .alias("content_hash"))
    return base.unionByName(head)
