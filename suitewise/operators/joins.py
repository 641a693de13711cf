"""Theta joins turned into equi-joins.

``contains`` and ``endswith`` matches cannot use a hash or sort-merge join, and a
nested-loop (cross) join or a broadcast of a side of unknown size do not scale.

* ``contains``: a q-gram index. Every left string is exploded into its distinct
  runs of ``Q`` characters (and of fewer, where a pattern is shorter): rows linear
  in its length. A pattern is looked up by only one of its runs, the one that
  occurs in the fewest left strings, and the candidates are verified.
* ``endswith``: every left string is exploded into the suffixes whose lengths
  occur on the right, joined on ``(length, text)``.

Both are exact. An empty pattern is contained in every string and ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Q = 3


def _keys(right: DataFrame, rcol: str) -> DataFrame:
    """Distinct right values with their lengths."""
    return (right.select(F.length(rcol).alias("_len"), F.col(rcol).alias("_piece"))
            .where(F.col("_piece").isNotNull()).distinct())


def _values(left: DataFrame, lcol: str) -> DataFrame:
    return left.select(F.col(lcol).alias("_v")).where(F.col("_v").isNotNull()).distinct()


def _grams(text: Column, q: Column) -> Column:
    """The distinct runs of ``q`` characters of a text."""
    last = F.length(text) - q + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, q))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _contained(vals: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (_v, _piece) with ``_piece`` inside ``_v``."""
    q = F.least(F.col("_len"), F.lit(Q))
    pieces = keys.select("_piece", q.alias("_q"), F.explode(_grams(F.col("_piece"), q)).alias("_gram"))
    lengths = F.broadcast(pieces.select("_q").distinct())  # at most Q + 1; the run of no characters is in every string
    index = vals.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(Q)))).join(lengths, "_q").select(
        "_v", F.explode(_grams(F.col("_v"), F.col("_q"))).alias("_gram"))
    often = index.join(pieces.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_df"))
    rarest = pieces.join(often, "_gram", "left").groupBy("_piece").agg(
        F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), "_gram")).alias("_gram"))
    return index.join(rarest, "_gram").where(F.contains(F.col("_v"), F.col("_piece"))).select("_v", "_piece")


def _matched_values(left: DataFrame, lcol: str, right: DataFrame, rcol: str, suffix: bool) -> DataFrame:
    vals, keys = _values(left, lcol), _keys(right, rcol)
    if not suffix:
        return _contained(vals, keys).select("_v").distinct()
    cand = vals.select("_v", F.explode(F.sequence(F.lit(0), F.length("_v"))).alias("_len")).join(
        keys.select("_len").distinct(), "_len")
    pieces = cand.select("_v", "_len", F.expr("substring(_v, -_len, _len)").alias("_piece"))
    return pieces.join(keys, ["_len", "_piece"], "left_semi").select("_v").distinct()


def _theta_semi(left: DataFrame, lcol: str, right: DataFrame, rcol: str, suffix: bool,
                anti: bool) -> DataFrame:
    hits = _matched_values(left, lcol, right, rcol, suffix)
    return left.join(hits, left[lcol] == hits["_v"], "left_anti" if anti else "left_semi")


def contains_semi_join(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> DataFrame:
    """Rows of ``left`` whose ``lcol`` contains some ``right.rcol``."""
    return _theta_semi(left, lcol, right, rcol, suffix=False, anti=False)


def within_semi_join(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> DataFrame:
    """Rows of ``left`` whose dotted path ``lcol`` is, or lies below, some non-empty ``right.rcol``."""
    parts = F.split(F.col("_v"), r"\.")
    vals = left.select(F.col(lcol).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    heads = vals.select("_v", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("_piece"))
    hits = heads.join(_keys(right, rcol).where(F.col("_len") > 0), "_piece", "left_semi").select("_v").distinct()
    return left.join(hits, left[lcol] == hits["_v"], "left_semi")


def endswith_semi_join(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> DataFrame:
    """Rows of ``left`` whose ``lcol`` ends with some ``right.rcol``."""
    return _theta_semi(left, lcol, right, rcol, suffix=True, anti=False)


def endswith_anti_join(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> DataFrame:
    return _theta_semi(left, lcol, right, rcol, suffix=True, anti=True)


def endswith_flag(left: DataFrame, lcol: str, right: DataFrame, rcol: str, flag: str) -> DataFrame:
    """All ``left`` rows with ``flag`` = some right value is a suffix of ``lcol``."""
    hits = _matched_values(left, lcol, right, rcol, suffix=True)
    j = left.join(hits, left[lcol] == hits["_v"], "left")
    return j.select(*[left[c] for c in left.columns], hits["_v"].isNotNull().alias(flag))


def contains_pairs(left: DataFrame, lcol: str, right: DataFrame, rcol: str) -> DataFrame:
    """Distinct (left value, right value) pairs where the right value occurs inside the left one.

    Output columns ``_v`` (left) and ``_piece`` (right), as in ``contains_semi_join``.
    """
    return _contained(_values(left, lcol), _keys(right, rcol))
