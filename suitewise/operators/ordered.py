"""Global order without a single-partition window, and without a per-key window.

A window with no PARTITION BY moves every row to one task, and a window
partitioned by a key puts all rows of a hot key into one task. For ranks,
running sums over a global order we instead:

1. range-partition on the order (Spark samples the keys, so even one hot key
   is cut into several ranges), sort each range and number its rows;
2. compute the running values with native windows partitioned by the range, and
   write each row with them and its range to the shared checkpoint folder: the
   rows are sorted and passed through the windows once, whatever is recomputed
   or reused later;
3. add the totals of all earlier ranges, taken from a per-range aggregate
   whose size is bounded by the partition count (so it is safe to broadcast).

Per-key running values follow from global ones by subtracting the value at the
last start marker. That value is carried in the same pass (``at_last``), inside
a range by a window and into it by the per-range table, so no row is joined to
the start of its key or island; a key with a third of all rows is only some more
ranges. Lookups ("the row 10 positions earlier") become equi-joins on the unique
global position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitewise.session import ensure_checkpoint_dir

_RANGE = "_range"
_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row inside it below


def running_totals(df: DataFrame, order: Sequence[Column], sums: Sequence[str],
                   prefix: str = "cum_", with_index: str | None = None,
                   last_before: Sequence[str] = (), at_last: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Inclusive running sums of the integer columns ``sums`` in the global ``order``.

    ``order`` must be a total order. ``with_index`` adds a 1-based position.
    ``last_before`` names boolean columns; for each, ``prev_<flag>`` is the global
    1-based position of the last row strictly before this one whose flag is
    true (NULL if none) — the building block for "state since the last X".
    ``at_last`` names boolean columns with some of the ``sums``; for each pair,
    ``<flag>_<sum>`` is the running sum at the last row up to and including this
    one whose flag is true (NULL if none): the difference of the two is the sum
    since that row, a segmented prefix sum. Writes one checkpoint when called.
    The names ``_range``, ``_row`` and ``_rowid`` are its own.
    """
    flags = list(last_before)
    carried = [(f, c) for f, cs in (at_last or {}).items() for c in cs]
    index = with_index or ("_gpos" if flags else None)
    ensure_checkpoint_dir(df.sparkSession)
    ordered = Window.partitionBy(_RANGE).orderBy("_row")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    numbered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_rowid", F.monotonically_increasing_id())
                .select(*df.columns, F.shiftright("_rowid", _ROW_BITS).cast("int").alias(_RANGE),
                        (F.col("_rowid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).alias("_row")))
    at_flag = [F.when(F.col(f), F.col("_row")) for f in flags]
    running = [*[F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))).over(upto).alias(f"_run_{c}") for c in sums],
               *[F.max(x).over(earlier).alias(f"_prev_{f}") for f, x in zip(flags, at_flag)]]
    local = numbered.select("*", *running) if running else numbered
    if carried:  # a second window over the same ranges: the running sum at the last flagged row
        local = local.select("*", *[F.last(F.when(F.col(f), F.col(f"_run_{c}")), ignorenulls=True).over(upto)
                                    .alias(f"_at_{f}_{c}") for f, c in carried])
    local = local.checkpoint()
    totals = local.groupBy(_RANGE).agg(
        F.max("_row").alias("_rows"),
        *[F.max_by(f"_run_{c}", "_row").alias(f"_tot_{c}") for c in sums],
        *[F.max(x).alias(f"_last_{f}") for f, x in zip(flags, at_flag)],
        *[F.max_by(f"_at_{f}_{c}", "_row").alias(f"_end_{f}_{c}") for f, c in carried])
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select(
        _RANGE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[f"_last_{f}" for f in flags], *[f"_end_{f}_{c}" for f, c in carried])
    offsets = offsets.select(
        "*", *[F.max(F.col("_off") + F.col(f"_last_{f}")).over(before).alias(f"_carry_{f}") for f in flags],
        *[F.last(F.col(f"_off_{c}") + F.col(f"_end_{f}_{c}"), ignorenulls=True).over(before).alias(f"_carry_{f}_{c}")
          for f, c in carried])
    j = local.join(F.broadcast(offsets), _RANGE)
    return j.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_off_{c}") + F.col(f"_run_{c}")).cast("bigint").alias(f"{prefix}{c}") for c in sums],
        *([(F.col("_off") + F.col("_row")).cast("bigint").alias(index)] if index else []),
        *[F.coalesce(F.col("_off") + F.col(f"_prev_{f}"), F.col(f"_carry_{f}")).cast("bigint").alias(f"prev_{f}")
          for f in flags],
        *[F.coalesce(F.col(f"_off_{c}") + F.col(f"_at_{f}_{c}"), F.col(f"_carry_{f}_{c}")).cast("bigint").alias(f"{f}_{c}")
          for f, c in carried])


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in ``order`` (a total order), distributed."""
    return running_totals(df, order, [], with_index=name)
