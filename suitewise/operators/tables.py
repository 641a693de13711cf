"""Keyed-table operations (family K) on DataFrames and table paths.

A table is a DataFrame with an ``id`` column and, where insertion order
matters, a ``seq`` column (position of the insert; larger = later). Updates
and deletes are joins against a change feed, so they run as shuffles keyed
on ``id`` rather than per-record loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from suitewise.functions.columns import is_email_weak, valid_password
from suitewise.operators.ordered import global_rank, running_totals


def create_table(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """K1: write a new table; False when something already exists at ``path``."""
    try:
        df.write.mode("errorifexists").format(fmt).save(path)
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return False


def table_count(spark: SparkSession, path: str, fmt: str = "parquet") -> int:
    """K8 for a stored table: row count, 0 when the table does not exist."""
    try:
        return spark.read.format(fmt).load(path).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def insert_rows(table: DataFrame, new: DataFrame, order: Sequence[Column], id_col: str = "id") -> DataFrame:
    """K2: append ``new``; a missing id becomes (table size) + (position in the batch).

    Every insert, with or without an id, grows the table by one, so the j-th
    new row (1-based, in ``order``) that lacks an id gets ``n + j``. The batch
    position is a distributed global rank; ``n`` is one count of the table, a
    scalar subquery of the plan. Existing rows keep ``seq`` 0 (or their own), new
    rows get their batch position after the last of those.
    """
    n = table.agg(F.count(F.lit(1))).scalar()
    ranked = global_rank(new, list(order), "seq")
    cols = [c for c in table.columns if c not in (id_col, "seq")]
    last = F.coalesce(table.agg(F.max("seq")).scalar(), F.lit(0)) if "seq" in table.columns else F.lit(0)
    added = ranked.select(F.coalesce(F.col(id_col), n + F.col("seq")).cast("bigint").alias(id_col),
                          *cols, (F.col("seq") + last).cast("bigint").alias("seq"))
    old = table.select(F.col(id_col).cast("bigint").alias(id_col), *cols,
                       (F.col("seq") if "seq" in table.columns else F.lit(0)).cast("bigint").alias("seq"))
    return old.unionByName(added)


def find_by_id(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """K3: for each requested id, the last inserted row with that id (absent ids: no row)."""
    want = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
    hits = table.join(want, id_col, "left_semi")
    cols = [c for c in table.columns if c not in (id_col, "seq")]
    g = hits.groupBy(id_col).agg(F.max_by(F.struct(*cols), F.col("seq")).alias("r"))
    return g.select(id_col, *[F.col(f"r.{c}").alias(c) for c in cols])


def update_last(table: DataFrame, feed: DataFrame, fields: Sequence[str], order: Sequence[str],
                id_col: str = "id") -> DataFrame:
    """K5 on a table with insert positions (``seq``): an update reaches only the row of its id that was inserted last.

    The last position of an id and the last non-null value of each field are two partial aggregations; both are
    joined to the table on (id, seq), a key that no two rows share, so an id with many rows is no hot key.
    """
    pos = F.struct(*order)
    agg = feed.groupBy(id_col).agg(*[
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), pos)).alias(f"_new_{f}") for f in fields])
    hit = table.groupBy(id_col).agg(F.max("seq").alias("seq")).join(agg, id_col)
    j = table.join(hit, [id_col, "seq"], "left")
    return j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                      for c in table.columns])


def delete_last(table: DataFrame, requests: DataFrame, id_col: str = "id") -> DataFrame:
    """K6 on a table with insert positions (``seq``): every request deletes the row of its id that was inserted last
    among those still there, so n requests of one id take its last n rows. Requests of absent ids are refused.

    The rows of the requested ids are numbered from the last one back in one global order with a start marker per id
    (``ordered.py``), so an id with a third of all rows is split over tasks.
    """
    wanted = requests.groupBy(F.col(requests.columns[0]).alias(id_col)).agg(F.count(F.lit(1)).alias("_n"))
    rows = table.join(wanted.select(id_col), id_col, "left_semi").select(
        id_col, "seq", F.lit(0).cast("bigint").alias("_n"), F.lit(2).alias("_kind"))
    # two markers open an id: one before and one with its number of requests, so that the number is a difference
    marks = wanted.select(id_col, F.lit(None).cast("bigint").alias("seq"), F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_kind")),
        F.struct(F.col("_n"), F.lit(1).alias("_kind")))).alias("m")).select(id_col, "seq", "m.*")
    both = rows.unionByName(marks).select(
        "*", (F.col("_kind") == 2).cast("int").alias("_hit"), (F.col("_kind") == 0).alias("_before"),
        (F.col("_kind") == 1).alias("_start"))
    c = running_totals(both, [F.col(id_col), F.col("_kind"), F.col("seq").desc()], ["_hit", "_n"],
                       at_last={"_before": ["_n"], "_start": ["_n", "_hit"]})
    gone = c.where((F.col("_kind") == 2) & (
        F.col("cum__hit") - F.col("_start__hit") <= F.col("_start__n") - F.col("_before__n"))).select(id_col, "seq")
    return table.join(gone, [id_col, "seq"], "left_anti")


def update_fields(table: DataFrame, feed: DataFrame, fields: Sequence[str], order: Sequence[str],
                  id_col: str = "id") -> DataFrame:
    """K5: apply (id, field values...) updates in ``order``; the last non-null value per field wins.

    Ids absent from the table are refused (the join starts from the table).
    One partial aggregation per field over the feed, then one left join.
    """
    pos = F.struct(*order)
    agg = feed.groupBy(id_col).agg(*[
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), pos)).alias(f"_new_{f}") for f in fields])
    j = table.join(agg, id_col, "left")
    return j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
                      for c in table.columns])


def delete_ids(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """K6: rows whose id is not in ``ids``."""
    drop = ids.select(F.col(ids.columns[0]).alias(id_col))
    return table.join(drop, id_col, "left_anti")


def query(table: DataFrame, predicate: Column) -> DataFrame:
    """K7: rows matching a Column predicate (pushes down to the scan)."""
    return table.where(predicate)


def count_rows(table: DataFrame) -> DataFrame:
    """K8: one-row count."""
    return table.agg(F.count(F.lit(1)).alias("n_rows"))


def to_json_rows(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K9: one JSON object per row."""
    return table.select(F.to_json(F.struct(*cols)).alias("json"))


def export_json(table: DataFrame, path: str) -> None:
    """K9 sink: JSON lines, one object per record."""
    table.write.mode("overwrite").json(path)


def import_json_arrays(docs: DataFrame, schema: str, col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Parse JSON arrays of records; non-arrays and invalid JSON go to the refused side."""
    parsed = docs.select("*", F.from_json(F.col(col), f"array<{schema}>").alias("_recs"))
    is_array = F.trim(F.col(col)).startswith("[")
    ok = parsed.where(F.col("_recs").isNotNull() & is_array)
    bad = parsed.where(F.col("_recs").isNull() | ~is_array).drop("_recs")
    return ok.select(F.explode("_recs").alias("r")).select("r.*"), bad


def register_users(existing: DataFrame, attempts: DataFrame, order: Sequence[str],
                   key: str = "username") -> DataFrame:
    """The first valid attempt (email check, password >= 8) per new username."""
    valid = attempts.where(is_email_weak(F.col("email")) & valid_password(F.col("password")))
    first = valid.groupBy(key).agg(
        F.min_by(F.struct(*[c for c in attempts.columns if c not in (key, "password")]),
                 F.struct(*order)).alias("r"))
    fresh = first.join(existing.select(F.col(existing.columns[0]).alias(key)), key, "left_anti")
    return fresh.select(key, "r.*")
