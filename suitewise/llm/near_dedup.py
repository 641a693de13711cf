"""Operator 8: near-duplicate groups by bottom-k sketches of one hash function.

Texts become sets of five-word shingles, hashed to 64 bits; the sketch of a set is
its ``K`` smallest hashes. Retained values make inverted lists. Sketches of two sets of
Jaccard 0.75 share 55 of 64 values on average if the sets are of one size and 48 if
one holds the other; fewer than ``SHARED`` has a probability of about 1e-19 and 5e-11.
So a pair meets in the lists of the values left when the SHARED - 1 most frequent of
each sketch are left out (rare values first, the prefix principle). The union sketch
of a pair estimates its similarity; pairs well below the threshold are dropped, and
all others are verified by exact Jaccard on the full sets.

Only connectivity is asked for, so lists are first linked as stars: every member
with the list's head, the member whose values are shared most. Groups found so are
contracted. Two sets that share a list share its head; so the members of all lists of
one head are compared across groups, inside tasks, in blocks of ``BLOCK`` x ``BLOCK``:
first by sketch, then by full sets. Only a spanning forest of the links found leaves a
task. No list is capped. Equal word sequences meet as one class from the start.

Edge cases: null or wordless texts have an empty set and are groups of their own;
with fewer than five words the whole sequence is the one shingle; texts of any
length are used whole; rows with equal words share a class whatever their id, null
ids rank after others within it; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitewise.llm.common import cut, shared_path

WORDS = 5
PERCENT = 75
K = 64
SHARED = 24
LEAST_ESTIMATE = 0.4
BLOCK = 256
STAR = 256
_SLICE = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_PLACES = np.array([pow(0xA0761D6478BD642F, i + 1, 1 << 64) for i in range(WORDS)], np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sums(self, values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Polynomial hash of values[start:stop] for every range."""
        n = len(values)
        if len(self.up) <= n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(self.base, -1, 1 << 64), np.uint64)])
        total = np.r_[np.uint64(0), np.cumsum(values * self.up[:n])]
        return (total[stops] - total[starts]) * self.down[starts]


def lower_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, A-Z in lower case, and the offsets of its texts (null is empty)."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return _LOWER[data[:offsets[-1]]], offsets


def spans(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _SLICE bytes; a longer text is a range of its own."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = min(max(int(np.searchsorted(offsets, offsets[a] + _SLICE, side="right")) - 1, a + 1), rows)
        yield a, b
        a = b


class Shingler:
    def __init__(self):
        self.powers = [_Powers(b) for b in _BASES]

    def slices(self, column: pa.Array) -> Iterator[tuple]:
        """Per slice of texts: first row, number of rows, (w1, w2) of their word sequences, and their sets as
        sorted hashes one after the other with offsets."""
        data, offsets = lower_bytes(column)
        for a, b in spans(offsets):
            yield a, b - a, *self._slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every word (run of other bytes than blanks) of lower-case texts."""
        inside = ~_GAP[data]
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        head[cuts] |= inside[cuts]
        tail[cuts - 1] |= inside[cuts - 1]
        start, stop = np.flatnonzero(head), np.flatnonzero(tail) + 1
        word = _mix(self.powers[0].sums(data.astype(np.uint64) + np.uint64(1), start, stop)
                    + (stop - start).astype(np.uint64))
        return word, np.searchsorted(offsets, start, side="right") - 1

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        rows = len(offsets) - 1
        word, row = self.words(data, offsets)
        count = np.bincount(row, minlength=rows)
        ends = np.cumsum(count)
        begins = ends - count
        marks = _mix(count.astype(np.uint64))
        w1, w2 = (_mix(p.sums(word, begins, ends) ^ marks) for p in self.powers[1:])
        n = len(word) - WORDS + 1
        shingle, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n > 0:
            full = np.flatnonzero(row[:n] == row[WORDS - 1:])
            shingle = word[full] * _PLACES[0]
            for i in range(1, WORDS):
                shingle += word[full + i] * _PLACES[i]
            owner = row[full]
        short = np.flatnonzero((count > 0) & (count < WORDS))
        shingle = np.r_[_mix(shingle), _mix(w1[short] ^ np.uint64(_BASES[0]))]
        owner = np.r_[owner, short]
        order = np.lexsort((shingle, owner))
        shingle, owner = shingle[order], owner[order]
        if len(order):
            new = np.r_[True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])]
            shingle, owner = shingle[new], owner[new]
        return w1.view(np.int64), w2.view(np.int64), shingle, np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))]


def _fact_rows(batches):
    """(doc_id, w1, w2, n_shingles, sketch)."""
    shingler = Shingler()
    for batch in batches:
        for at, rows, w1, w2, hashes, offsets in shingler.slices(batch.column(1)):
            sizes = np.diff(offsets)
            kept = np.minimum(sizes, K)
            ends = np.cumsum(kept)
            pick = np.repeat(offsets[:-1] - (ends - kept), kept) + np.arange(int(ends[-1]) if rows else 0)
            sketch = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(hashes[pick].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, rows), pa.array(w1), pa.array(w2), pa.array(sizes), sketch],
                names=["doc_id", "w1", "w2", "n_shingles", "sketch"])


def _check_rows(batches):
    """Exact Jaccard of every text with the star center that comes before it in the same (center, salt)."""
    shingler = Shingler()
    group, center, size = None, np.zeros(0, np.uint64), 0
    for batch in batches:
        keys = list(zip(batch["center"].to_pylist(), batch["salt"].to_pylist()))
        node = batch["node"].to_numpy()
        left, right = [], []
        for at, rows, _, _, hashes, offsets in shingler.slices(batch["text"]):
            for i in range(rows):
                own = hashes[offsets[i]:offsets[i + 1]]
                if keys[at + i][0] == node[at + i]:
                    group, center, size = keys[at + i], own, len(own)
                elif group == keys[at + i]:
                    if estimate(center[:K], own[:K]) < LEAST_ESTIMATE:
                        continue
                    both = np.searchsorted(center, own)
                    both[both == size] = 0
                    common = int((center[both] == own).sum()) if size else 0
                    if 100 * common >= PERCENT * (size + len(own) - common) and common:
                        left.append(node[at + i])
                        right.append(group[0])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity by the union sketch: share of the K smallest hashes of the union that both hold."""
    union = np.union1d(a, b)[:K]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).mean()) if len(union) else 0.0


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over slices of the values that occur twice."""
    values, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(df > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    twice = df[at] > 1
    row, column = row[twice], column[at[twice]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int((df > 1).sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        member = np.zeros((len(sets), 4096), np.float32)
        member[row[a:b], column[a:b] - lo] = 1
        out += member @ member.T
    return out.astype(np.int64)


def links_between(comp: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between members of different groups (and blocks, if there are two)."""
    n = np.array([len(s) for s in sets])
    apart = comp[:, None] != comp
    if block.min() != block.max():
        apart &= block[:, None] != block
    apart &= 100 * np.minimum(n[:, None], n) >= PERCENT * np.maximum(n[:, None], n)
    least = np.where(n <= K * PERCENT // 100, -(-n * PERCENT // 100), SHARED)
    apart &= _overlaps([s[:K] for s in sets]) >= np.minimum(least[:, None], least)
    some = np.flatnonzero(apart.any(axis=1))
    if not len(some):
        return []
    common = _overlaps([sets[i] for i in some])
    size = n[some]
    linked = np.triu(apart[np.ix_(some, some)] & (100 * common >= PERCENT * (size[:, None] + size - common)), 1)
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for x, y in zip(*np.nonzero(linked)):
        a, b = find(int(comp[some[x]])), find(int(comp[some[y]]))
        if a != b:
            root[a] = b
            out.append((int(some[x]), int(some[y])))
    return out


def _block_rows(batches):
    """Links (u, v) found inside the blocks (center, i, j)."""
    shingler = Shingler()
    group, held = None, []

    def links():
        if len({h[1] for h in held}) < 2:
            return []
        node, comp, block, sets = zip(*held)
        return [(node[x], node[y]) for x, y in links_between(np.array(comp), np.array(block), list(sets))]

    def edges(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                           pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in ("center", "i", "j"))))
        rows_of = list(zip(*(batch[c].to_pylist() for c in ("node", "comp", "block"))))
        out = []
        for at, rows, _, _, hashes, offsets in shingler.slices(batch["text"]):
            for i in range(rows):
                if keys[at + i] != group:
                    out += links()
                    group, held = keys[at + i], []
                held.append((*rows_of[at + i], hashes[offsets[i]:offsets[i + 1]].copy()))
        yield edges(out)
    yield edges(links())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), by alternating large and small stars."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v) of the pairs (node, center) whose full sets are similar; hot centers are dealt over tasks."""
    pairs = pairs.where("node <> center").distinct()
    sizes = pairs.groupBy("center").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = pairs.join(sizes, "center").select(
        "node", "center", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"))
    members = dealt.join(texts, "node").select("center", "salt", "node", "text")
    heads = sizes.select(F.col("center").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
                         ).join(texts, "node").select(F.col("node").alias("center"), F.col("salt").cast("int"), "node", "text")
    return (members.unionByName(heads).repartition("center", "salt")
            .sortWithinPartitions("center", "salt", F.expr("node <> center"))
            .mapInArrow(_check_rows, "u bigint, v bigint"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group), kept."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    ids = texts.schema["doc_id"].dataType.simpleString()
    facts = cut(texts.mapInArrow(_fact_rows, f"doc_id {ids}, w1 bigint, w2 bigint, n_shingles bigint, sketch array<bigint>"))
    classes = cut(
        facts.where("n_shingles > 0").groupBy("w1", "w2")
        .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()))
    # inverted lists of the retained values that occur in several sketches
    values = classes.select("node", F.explode("sketch").alias("value"))
    common = cut(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    shared = F.when(F.col("n") <= K * PERCENT // 100, F.ceil(F.col("n") * PERCENT / 100)).otherwise(SHARED)
    ranked = (values.join(common, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
              .join(classes.select("node", "n"), "node"))
    lists = cut(ranked.where(F.size("own") >= shared).select(
        "node", "n", F.aggregate("own", F.lit(0.0), lambda t, x: t + F.log(x["df"])).alias("weight"),
        F.explode(F.slice("own", F.lit(1), (F.size("own") - shared + 1).cast("int"))["value"]).alias("value")))
    # texts of the classes that are in a list at all
    wanted = classes.join(lists.select("node").distinct(), "node").select(
        F.col("first_id").alias("doc_id"), "node", "w1", "w2")
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "w1", "w2", "text")
    path = shared_path(spark, "near-texts")
    found.mapInArrow(_own_texts, "node bigint, text string").write.parquet(path)
    bodies = spark.read.parquet(path)

    heads = lists.groupBy("value").agg(F.max(F.struct("weight", -F.col("node"))).alias("top"), F.count("*").alias("m"))
    stars = cut(lists.join(heads.where("m > 1"), "value").select("node", (-F.col("top.col2")).alias("center")).distinct())
    edges = cut(_verified(stars, bodies))
    roots = cut(components(edges))
    # heads whose lists still hold members of several groups
    members = stars.join(roots, "node", "left").select("center", "node", F.coalesce("root", "node").alias("comp"))
    several = members.groupBy("center").agg(
        F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    blocks = (members.join(several.select("center", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), "center")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
              .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("center", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block",
                      "node", "comp")
              .join(bodies, "node"))
    more = (blocks.repartition("center", "i", "j").sortWithinPartitions("center", "i", "j")
            .mapInArrow(_block_rows, "u bigint, v bigint"))
    roots = cut(components(edges.unionByName(more)))

    grouped = classes.select("node", "first_id", "w1", "w2").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    named = cut(grouped.join(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select(
        "w1", "w2", "component_id"))
    out = facts.select("doc_id", "w1", "w2", "n_shingles").join(named, ["w1", "w2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _own_texts(batches):
    """Texts whose words are those of the class (rows of one id may differ)."""
    shingler = Shingler()
    for batch in batches:
        w1, w2 = batch["w1"].to_numpy(), batch["w2"].to_numpy()
        same = np.zeros(batch.num_rows, bool)
        for at, rows, a, b, _, _ in shingler.slices(batch["text"]):
            same[at:at + rows] = (w1[at:at + rows] == a) & (w2[at:at + rows] == b)
        yield batch.select(["node", "text"]).filter(pa.array(same))
