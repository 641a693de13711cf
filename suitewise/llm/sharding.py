"""Operator 1: consistent-hash sharding with virtual nodes and exactly bounded loads.

Shards own ``vnodes`` pseudo-random points of a 64-bit ring. A row's home is the
shard of the first point clockwise from the row's hash. Loads are bounded: of
``n`` rows over ``k`` shards the first ``n mod k`` shards hold ``n // k + 1`` rows
and the others ``n // k``. A shard first takes the rows whose home it is; rows
that find their home full continue clockwise to the next point whose shard still
has room, so counts differ by at most one and only the overflow moves.

Plan: the rows of an arc (the stretch that ends at one point) are numbered inside
``SPREAD`` sub-arcs, the counts per sub-arc (at most shards x vnodes x SPREAD
numbers) go to the driver, which deals rank ranges of arcs to shards; the rows
look their rank up in that bounded table. Everything else is native.

Edge cases: a null key hashes like any value; rows that are equal in key and
``tie`` share one arc and are dealt by rank; an empty table gives an empty result;
extra columns pass through (the added names replace columns of the same name).
"""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitewise.llm.common import literal_table

VNODES = 128
SPREAD = 16
_CELL_BITS = 12


def ring_points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Sorted (position, shard) of every virtual node; positions are signed 64-bit."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"shard {shard} point {v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big", signed=True), shard))
    return sorted(points)


def _cells(points: list[tuple[int, int]]) -> list[dict]:
    """The ring cut at every point and at 2**12 equal cells: (cell, lo, hi, arc), lo < position <= hi."""
    shift = 64 - _CELL_BITS
    ends = [p for p, _ in points]
    rows = []
    for cell in range(-(1 << _CELL_BITS - 1), 1 << _CELL_BITS - 1):
        first, last = cell << shift, ((cell + 1) << shift) - 1
        lo = first - 1
        i = bisect.bisect_left(ends, first)
        while lo < last:
            hi = min(last, ends[i]) if i < len(ends) else last
            rows.append({"cell": cell, "lo": str(lo), "hi": hi, "arc": i % len(ends)})
            lo, i = hi, i + 1
    return rows


def deal(arc_counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[dict]:
    """Rank ranges of every arc and the shard and first slot that take them."""
    total = sum(arc_counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    ranges, overflow = [], []

    def place(arc: int, start: int, shard: int, n: int) -> None:
        ranges.append({"arc": arc, "first": start, "last": start + n - 1, "shard": shard, "slot0": used[shard]})
        used[shard] += n

    for arc in sorted(arc_counts):
        home, n = points[arc][1], arc_counts[arc]
        take = min(n, room[home] - used[home])
        if take:
            place(arc, 0, home, take)
        if take < n:
            overflow.append((arc, take, n - take))
    for arc, start, left in overflow:
        step = arc
        while left:
            step = (step + 1) % len(points)
            shard = points[step][1]
            take = min(left, room[shard] - used[shard])
            if take:
                place(arc, start, shard, take)
                start, left = start + take, left - take
    return ranges


def shard_rows(df: DataFrame, key: Column, tie: Column, shards: int, vnodes: int = VNODES) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (gapless from 0 in a shard) and ``home_shard``."""
    spark = df.sparkSession
    points = ring_points(shards, vnodes)
    cells = literal_table(spark, _cells(points), "cell bigint, lo string, hi bigint, arc int").select(
        F.col("cell").alias("_cell"), F.col("lo").cast("decimal(20,0)").alias("_lo"),
        F.col("hi").alias("_hi"), F.col("arc").alias("_arc"))
    added = ("shard", "slot", "home_shard")
    names = [c for c in df.columns if c not in added]
    # the rows' own columns wait in one struct, so that no helper's name can clash with theirs
    placed = (
        df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.xxhash64(key, tie).alias("_pos"),
                  key.alias("_key"), tie.alias("_tie"))
        .withColumn("_cell", F.shiftright("_pos", 64 - _CELL_BITS))
        .join(F.broadcast(cells), "_cell")
        .where((F.col("_pos") > F.col("_lo")) & (F.col("_pos") <= F.col("_hi")))
        .withColumn("_sub", F.pmod(F.xxhash64("_pos"), F.lit(SPREAD)).cast("int")))
    counts = placed.groupBy("_arc", "_sub").count().collect()  # at most shards * vnodes * SPREAD rows
    per_sub = {(r["_arc"], r["_sub"]): r["count"] for r in counts}
    per_arc: dict[int, int] = defaultdict(int)
    bases = []
    for arc, sub in sorted(per_sub):
        bases.append({"arc": arc, "sub": sub, "base": per_arc[arc]})
        per_arc[arc] += per_sub[arc, sub]
    base = literal_table(spark, bases, "arc int, sub int, base bigint").select(
        F.col("arc").alias("_arc"), F.col("sub").alias("_sub"), F.col("base").alias("_base"))
    homes = literal_table(spark, [{"arc": i, "home": s} for i, (_, s) in enumerate(points)],
                          "arc int, home int").select(F.col("arc").alias("_arc"), F.col("home").alias("home_shard"))
    dealt = literal_table(spark, deal(per_arc, points, shards),
                          "arc int, first bigint, last bigint, shard int, slot0 bigint").select(
        F.col("arc").alias("_arc"), F.col("first").alias("_first"), F.col("last").alias("_last"),
        "shard", F.col("slot0").alias("_slot0"))
    order = Window.partitionBy("_arc", "_sub").orderBy("_pos", "_key", "_tie")
    ranked = (
        placed.withColumn("_n", F.row_number().over(order) - 1)
        .join(F.broadcast(base), ["_arc", "_sub"])
        .withColumn("_rank", F.col("_base") + F.col("_n"))
        .join(F.broadcast(dealt), "_arc")
        .where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") <= F.col("_last")))
        .join(F.broadcast(homes), "_arc"))
    return ranked.select(*[F.col("_row")[c].alias(c) for c in names], "shard", (F.col("_slot0") + F.col("_rank") - F.col("_first")).alias("slot"),
                         "home_shard")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All documents over ``shards`` shards under the law ``rows``, with size and text checksum."""
    facts = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = shard_rows(facts, F.col("doc_id"), F.col("text_crc32"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home_shard",
                      (F.col("shard") != F.col("home_shard")).alias("overflowed"))
