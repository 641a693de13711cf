"""Operator 11: vector code compression by product quantisation, fitted with cover-tree Lloyd rounds.

Vectors become integers floor(256 x) and are cut into ``PARTS`` equal parts. Within every block of ``BLOCK`` vectors
each part position gets a cover tree: the children of a node are a net of its points at half its radius, the points
of every subtree lie side by side, and cumulative sums over that order give the sum of any subtree at once. The trees
are built once and written to the shared folder. A round walks all trees level by level: where the second nearest
entry is farther from a node's centre than the nearest by more than twice the node's radius, the triangle inequality
gives the whole subtree to the nearest; only leaves that stay ambiguous are compared point by point, in integers.

Plan: the vectors are read once and never shuffled. A round sends one row of sums per (task, part, entry that has
members), at most PARTS x ENTRIES rows a task, and the driver holds the codebook of PARTS x ENTRIES entries. The last
assignment gives the codes; label errors are a keyed sum that is joined back.

Edge cases: rows whose vector is null or empty or holds null or non-finite components are dropped, and so are vectors
of another length than that of the smallest kept id; a length that is no multiple of ``PARTS`` is filled up with
zeros, which change no distance. Components saturate at 2**26 either way, so that sums fit a long. Ties go to the
lower entry, an entry without members stays. With fewer rows than entries the codebooks are shorter. Rows that repeat
an id are coded each for itself (the first codebook takes them in the order of their components). Null labels are one
label. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suitewise.llm.common import shared_path

PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 8192
LEAF = 24
LIMIT = 1 << 26


def integers(vector: Column) -> Column:
    """floor(256 x) of every component; null unless the vector is of finite numbers."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    usable = (F.size(vector) > 0) & F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = float(LIMIT)
    return F.when(usable, F.transform(doubles, lambda x: F.floor(
        F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x * 256).cast("double")))).cast("int")))


def _away(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((points - centre) ** 2).sum(axis=-1)


class CoverTree:
    """Cover tree of integer points.

    ``order`` lists the points so that every subtree is a range [start, end) that begins with the node's centre;
    ``sums`` are cumulative over it. Node i has a covering radius and the children [first[i], last[i]), none for a leaf.
    """

    def __init__(self, points: np.ndarray):
        order = np.arange(len(points))
        nodes = [(0, len(points))]
        radii, first, last = [], [], []
        at = 0
        while at < len(nodes):
            start, end = nodes[at]
            rows = order[start:end]
            own = points[rows]
            radius = int(_away(own, own[0]).max())
            radii.append(radius)
            first.append(len(nodes))
            if end - start > LEAF and radius:
                left, child = np.arange(len(rows)), start
                parts = []
                while len(left):
                    near = 4 * _away(own[left], own[left[0]]) <= radius
                    parts.append(rows[left[near]])
                    nodes.append((child, child + len(parts[-1])))
                    child += len(parts[-1])
                    left = left[~near]
                order[start:end] = np.concatenate(parts)
            last.append(len(nodes))
            at += 1
        start, end = np.array(nodes, np.int64).T
        self._hold(points[order], order, start, end, np.array(radii), np.array(first), np.array(last))

    FIELDS = ("points", "order", "start", "end", "squared_radius", "first", "last")

    def _hold(self, *fields: np.ndarray) -> None:
        self.__dict__.update(zip(self.FIELDS, fields))
        self.radius = np.sqrt(self.squared_radius.astype(np.float64))
        self.centre = self.points[self.start]
        self.sums = np.r_[np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0)]

    @classmethod
    def of(cls, fields: list[np.ndarray]) -> CoverTree:
        tree = cls.__new__(cls)
        tree._hold(*fields)
        return tree

    def assign(self, entries: np.ndarray):
        """(range starts, range ends, entry): ranges of the order given to one entry, of any length."""
        norms = (entries ** 2).sum(axis=1)

        def squares(points):
            return (points ** 2).sum(axis=1)[:, None] - 2 * points @ entries.T + norms

        starts, ends, given = [], [], []
        front = np.zeros(1, np.int64)
        while len(front):
            exact = squares(self.centre[front])
            nearest = exact.argmin(axis=1)
            away = np.sqrt(exact.astype(np.float64))
            best = away[np.arange(len(front)), nearest]
            away[np.arange(len(front)), nearest] = np.inf
            second = away.min(axis=1)
            # room for rounding: roots of integers below 2**62 are right to a part in 10**15
            sure = second - best > 2 * self.radius[front] + 1e-9 * (1 + best + 2 * self.radius[front])
            starts.append(self.start[front[sure]])
            ends.append(self.end[front[sure]])
            given.append(nearest[sure])
            rest = front[~sure]
            leaf = self.first[rest] == self.last[rest]
            leaves = rest[leaf]
            if len(leaves):
                size = self.end[leaves] - self.start[leaves]
                places = np.repeat(self.start[leaves] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                starts.append(places)
                ends.append(places + 1)
                given.append(squares(self.points[places]).argmin(axis=1))  # the lower entry among equals
            inner = rest[~leaf]
            size = self.last[inner] - self.first[inner]
            front = (np.repeat(self.first[inner] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                     if len(inner) else np.zeros(0, np.int64))
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(given)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points given to each entry."""
        starts, ends, given = self.assign(entries)
        sums = np.zeros(entries.shape, np.int64)
        np.add.at(sums, given, self.sums[ends] - self.sums[starts])
        counts = np.zeros(len(entries), np.int64)
        np.add.at(counts, given, ends - starts)
        return sums, counts

    def entries_of(self, entries: np.ndarray) -> np.ndarray:
        """The entry of every point, in the order of the points that were given."""
        starts, ends, given = self.assign(entries)
        by_place = np.argsort(starts)
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(given[by_place], (ends - starts)[by_place])
        return out


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.result_type(np.min_scalar_type(values.min()), np.min_scalar_type(values.max())))


def _pack(tree: CoverTree) -> bytes:
    held = io.BytesIO()
    for k in CoverTree.FIELDS:
        np.save(held, _narrow(getattr(tree, k)))
    return held.getvalue()


def _unpack(raw: bytes) -> CoverTree:
    held = io.BytesIO(raw)
    return CoverTree.of([np.load(held).astype(np.int64) for _ in CoverTree.FIELDS])


def _blocks(batches, width: int):
    """(ids, labels, points) of up to ``BLOCK`` vectors of a task at a time."""
    held, rows = [], 0

    def block():
        table = pa.Table.from_batches(held).combine_chunks()
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        points = flat.reshape(table.num_rows, -1)
        if points.shape[1] < width:
            points = np.pad(points, ((0, 0), (0, width - points.shape[1])))
        return table["vec_id"].combine_chunks(), table["label"].combine_chunks(), points

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            if held and rows + part.num_rows > BLOCK:
                yield block()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield block()


def plant(rows: DataFrame, width: int) -> DataFrame:
    """The trees of every block, a row per (block, part), written once and read from the shared folder."""
    ids, label = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def trees(batches):
        for vec_ids, labels, points in _blocks(batches, width):
            size = width // PARTS
            raw = [_pack(CoverTree(points[:, p * size:(p + 1) * size])) for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([vec_ids.to_pylist()], pa.list_(vec_ids.type)), pa.array([labels.to_pylist()], pa.list_(labels.type)),
                 pa.array([raw], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    path = shared_path(rows.sparkSession, "code-trees")
    rows.select("vec_id", "label", "vec").mapInArrow(
        trees, f"ids array<{ids}>, labels array<{label}>, trees array<binary>").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def lloyd(planted: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all trees."""
    parts, entries, size = books.shape

    def totals(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, raw in enumerate(trees):
                    s, n = _unpack(raw.as_py()).totals(books[p])
                    sums[p] += s
                    counts[p] += n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
             pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    grouped = planted.select("trees").mapInArrow(totals, "part int, entry int, n bigint, sums array<bigint>").groupBy(
        "part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)])
    after = books.copy()
    for row in grouped.collect():  # PARTS x ENTRIES rows
        after[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return after


def encode(planted: DataFrame, books: np.ndarray, ids: str, label: str) -> DataFrame:
    """vec_id, label, code, error of every vector under final codebooks."""
    def code(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = [_unpack(raw.as_py()) for raw in batch.column(2)[i]]
                given = np.stack([t.entries_of(books[p]) for p, t in enumerate(own)], axis=1)
                error = np.zeros(len(given), np.int64)
                for p, t in enumerate(own):
                    error[t.order] += _away(t.points, books[p][given[t.order, p]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values,
                     pa.array([row.tobytes().hex() for row in given.astype(np.uint8)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"])

    return planted.select("ids", "labels", "trees").mapInArrow(
        code, f"vec_id {ids}, label {label}, code string, error bigint")


def first_books(rows: DataFrame, entries: int) -> tuple[np.ndarray, int]:
    """The codebooks of the smallest ids, and the length of the vectors."""
    first = rows.orderBy("vec_id", "vec").limit(1).select(F.size("vec").alias("dim")).collect()
    if not first:
        return np.zeros((PARTS, 0, 1), np.int64), 0
    dim = first[0]["dim"]
    picked = rows.where(F.size("vec") == dim).orderBy("vec_id", "vec").limit(entries).select("vec").collect()  # ENTRIES rows
    width = -(-dim // PARTS) * PARTS
    points = np.zeros((len(picked), width), np.int64)
    points[:, :dim] = [r["vec"] for r in picked]
    return points.reshape(len(picked), PARTS, -1).transpose(1, 0, 2).copy(), dim


def compress(vectors: DataFrame, vector: str = "embedding", entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every usable vector; and the codebooks [part, entry, component]."""
    ids, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    rows = vectors.select("vec_id", "label", integers(F.col(vector)).alias("vec")).where(F.col("vec").isNotNull())
    books, dim = first_books(rows, entries)
    spark: SparkSession = vectors.sparkSession
    if not dim:
        return spark.createDataFrame([], f"vec_id {ids}, label {label}, code string, error bigint"), books
    planted = plant(rows.where(F.size("vec") == dim), books.shape[0] * books.shape[2])
    for _ in range(rounds):
        books = lloyd(planted, books)
    path = shared_path(spark, "codes")
    encode(planted, books, ids, label).write.parquet(path)
    return spark.read.parquet(path), books


def reconstruct(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))])


def compress_embeddings(embeddings: DataFrame) -> DataFrame:
    coded, books = compress(embeddings)
    digest = hashlib.sha256(json.dumps(books.ravel().tolist(), separators=(",", ":"))[1:-1].encode()).hexdigest()
    per_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL of the same result: ROUNDS rounds over all (vector part, entry) pairs."""
    distance = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = ["""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, label, p, q[p * (len(q) // 16) + 1:(p + 1) * (len(q) // 16)] AS v
  FROM kept, (SELECT range AS p FROM range(16))),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v
  FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(v) AS v, min(d) AS d, arg_min(e, (d, e)) AS e
  FROM (SELECT x.vec_id, x.label, x.p, x.v, b.e, {distance} AS d FROM x JOIN b{r} b ON b.p = x.p)
  GROUP BY vec_id, label, p)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (
  SELECT p, e, list(mean ORDER BY i) AS v FROM (
    SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS mean
    FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH {','.join(steps)},
c AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id, label),
l AS (SELECT label, sum(error) AS total FROM c GROUP BY label),
h AS (
  SELECT sha256(string_agg(array_to_string(list_transform(v, lambda z: CAST(z AS VARCHAR)), ','), ',' ORDER BY p, e)) AS digest
  FROM b{ROUNDS})
SELECT c.vec_id, c.code, c.error, CAST(l.total AS BIGINT) AS label_error, h.digest AS codebooks_sha256
FROM c JOIN l ON l.label IS NOT DISTINCT FROM c.label, h
"""


ORACLE = _oracle()
