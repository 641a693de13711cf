"""Operator 3: exact top-k inner products by a dual-tree search over cover trees.

Queries and data are indexed together. The top level is a set of at most ``CELLS``
centres, taken farthest-first from a bounded sample; every row belongs to the cell
of its nearest centre, and a cell is dealt over chunks of about ``CHUNK`` rows. A
group of queries of one cell is checked against every data cell: no product of the
pair can exceed  c.d + |c| r_d + |d| r_q + r_q r_d  for centres c, d and covering
radii r_q, r_d. Cells below the worst kth score of the group (bounded from below by
the scores against the sample) are pruned; the others get the group. Inside a task
cover trees of the chunk and of the group are searched in pairs by the same bound,
best pairs first, and surviving leaves are scored by one matrix product. The best k
of every chunk meet in one ranking per query.

Pruning only saves work: every pair that could reach the top k is scored, exactly,
in integers (components are floor(256 x); scores must stay below 2**53).

Edge cases: rows with a null id, a null or empty vector or a null or non-finite
component take no part; components saturate at 2**23 either way; vectors of different lengths
are searched among their own length; equal vectors make one leaf; ties go to the
smaller id; with fewer than k candidates all are returned. Rows that repeat an id are
rows of their own: each query row has its own k results, in which only the row itself
is left out. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitewise.llm.common import cut

SAMPLE = 1024
CELLS = 48
CHUNK = 4096
QUERY_GROUP = 256
QUERY_PART = 4096
LEAF = 256
LIMIT = float(1 << 23)


def quantise(vector: Column) -> Column:
    """floor(256 x) of every component; null unless all are finite numbers."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    usable = (F.size(vector) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(doubles, lambda x: F.greatest(F.lit(-LIMIT), F.least(
        F.lit(LIMIT), F.floor(x * 256).cast("double")))))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


class CoverTree:
    """Nodes (rows, centre, covering radius, children); a child covers half its parent's radius."""

    def __init__(self, points: np.ndarray):
        self.points = points
        rows = np.arange(len(points))
        self.root = self._node(rows, points.mean(axis=0))

    def _node(self, rows: np.ndarray, centre: np.ndarray):
        own = self.points[rows]
        away = _distances(own, centre)
        radius = float(away.max())
        node = {"rows": rows, "centre": centre, "norm": float(np.sqrt((centre ** 2).sum())), "radius": radius, "kids": []}
        if len(rows) <= LEAF or radius == 0:
            return node
        left, groups = np.arange(len(rows)), []
        while len(left):
            near = _distances(own[left], own[left[0]]) <= radius / 2
            groups.append(left[near])
            left = left[~near]
            if len(groups) > len(rows) // 8:  # too far apart for this radius: one product is cheaper
                return node
        node["kids"] = [self._node(rows[g], own[g[0]]) for g in groups]
        return node


def bound(q: dict, d: dict) -> float:
    """No inner product between the nodes' points is larger (with room for rounding)."""
    top = (float(q["centre"] @ d["centre"]) + q["norm"] * d["radius"] + d["norm"] * q["radius"]
           + q["radius"] * d["radius"])
    return top + 1e-6 * (1 + abs(top))


def dual_search(q_tree: CoverTree, query_rows: np.ndarray, floors: np.ndarray, d_tree: CoverTree, rows: np.ndarray,
                ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query row, vec_id, score) of the best k in the data per query, leaving out scores below its floor.

    ``query_rows`` and ``rows`` number the rows of queries and data, ``ids`` are the data's vec_ids.
    """
    queries, data = q_tree.points, d_tree.points
    best: list[list[tuple[int, int, int]]] = [[] for _ in query_rows]
    worst = floors.astype(float).copy()
    heap = [(-bound(q_tree.root, d_tree.root), 0, q_tree.root, d_tree.root)]
    n = 1
    while heap:
        high, _, q, d = heapq.heappop(heap)
        if -high < worst[q["rows"]].min():
            continue
        if q["kids"] or d["kids"]:
            split_d = d["kids"] and (not q["kids"] or d["radius"] >= q["radius"])
            for a, b in ([(q, x) for x in d["kids"]] if split_d else [(x, d) for x in q["kids"]]):
                if (top := bound(a, b)) >= worst[a["rows"]].min():
                    heapq.heappush(heap, (-top, n, a, b))
                    n += 1
            continue
        scores = queries[q["rows"]] @ data[d["rows"]].T
        at, hits = np.nonzero(scores >= worst[q["rows"]][:, None])
        hit_rows = d["rows"][hits]
        for i, score, v, r in zip(q["rows"][at].tolist(), scores[at, hits].tolist(), ids[hit_rows].tolist(),
                                  rows[hit_rows].tolist()):
            if score < worst[i] or r == query_rows[i]:
                continue
            own = best[i]
            if len(own) < k:
                heapq.heappush(own, (score, -v, r))
            else:
                heapq.heappushpop(own, (score, -v, r))
            if len(own) == k:
                worst[i] = max(worst[i], own[0][0])
    return [(int(q), -v, int(s)) for q, own in zip(query_rows, best) for s, v, _ in own]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``: vec_id and a column ``vec`` from ``quantise``."""
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "vec", F.size("vec").alias("dim"), is_query.alias("q"))
    schema = "query_row bigint, query_id bigint, vec_id bigint, score bigint"
    parts = [_of_length(usable.where(F.col("dim") == r["dim"]), r["dim"], k, schema)
             for r in usable.groupBy("dim").count().orderBy("dim").collect()]  # one per vector length
    found = parts[0] if parts else usable.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, dim: int, k: int, schema: str) -> DataFrame:
    spark = rows.sparkSession
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "vec").collect()  # SAMPLE rows
    sample = np.array([r["vec"] for r in sampled])
    sample_ids = np.array([r["vec_id"] for r in sampled])
    picks, away = [0], _distances(sample, sample[0])
    while len(picks) < min(CELLS, len(sample)) and away.max() > 0:
        picks.append(int(away.argmax()))
        away = np.minimum(away, _distances(sample, sample[picks[-1]]))
    centres = sample[picks]

    def assign(batches):
        for batch in batches:
            points = _matrix(batch.column("vec"), dim)
            square = (points ** 2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(axis=1)
            cell = square.argmin(axis=1)
            radius = np.sqrt(((points - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), batch.column("q"), pa.array(cell.astype(np.int32)),
                 pa.array(radius)], names=["vec_id", "vec", "q", "cell", "away"])

    placed = cut(rows.mapInArrow(assign, "vec_id bigint, vec array<double>, q boolean, cell int, away double")
                 .withColumn("row", F.monotonically_increasing_id()))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"),
                                       F.count_if("q").alias("nq")).collect()  # CELLS rows
    chunks = {r["cell"]: math.ceil(r["n"] / CHUNK) for r in cells}
    radii = {r["cell"]: r["radius"] for r in cells}
    asked = {r["cell"]: max(1, math.ceil(r["nq"] / QUERY_GROUP)) for r in cells}
    query_parts = max(1, math.ceil(sum(r["nq"] for r in cells) / QUERY_PART))
    norms = np.sqrt((centres ** 2).sum(axis=1))

    def dealt(counts):
        return F.pmod(F.xxhash64("row"), F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]),
                                                         F.col("cell"))).cast("int")

    def groups(key, table):
        """The surviving (cell, chunk) of one query group, with the queries and their floors."""
        points, ids, own = _matrix(table["vec"], dim), table["vec_id"].to_numpy(), table["row"].to_numpy()
        mine = int(key[0].as_py())
        scores = points @ sample.T
        scores[ids[:, None] == sample_ids] = -np.inf
        floors = np.sort(scores, axis=1)[:, -k] if len(sample) > k else np.full(len(ids), -np.inf)
        query = {"centre": centres[mine], "norm": norms[mine], "radius": float(_distances(points, centres[mine]).max())}
        out = []
        for cell, n in chunks.items():
            data = {"centre": centres[cell], "norm": norms[cell], "radius": radii[cell]}
            if bound(query, data) >= floors.min():
                out += [(cell, c) for c in range(n)]
        part = hash((mine, int(key[1].as_py()))) % query_parts
        size = len(out)
        return pa.table({
            "cell": pa.array([c for c, _ in out], pa.int32()), "chunk": pa.array([c for _, c in out], pa.int32()),
            "part": pa.array([part] * size, pa.int32()), "ids": pa.array([ids.tolist()] * size, pa.list_(pa.int64())),
            "own": pa.array([own.tolist()] * size, pa.list_(pa.int64())),
            "points": pa.array([points.ravel().tolist()] * size, pa.list_(pa.float64())),
            "floors": pa.array([floors.tolist()] * size, pa.list_(pa.float64()))})

    pairs = (placed.where("q").withColumn("chunk", dealt(asked)).select("vec_id", "row", "vec", "cell", "chunk")
             .groupBy("cell", "chunk").applyInArrow(
                 groups, "cell int, chunk int, part int, ids array<bigint>, own array<bigint>, points array<double>, "
                         "floors array<double>"))
    data = (placed.withColumn("chunk", dealt(chunks)).select("cell", "chunk", "vec_id", "row", "vec")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))) if query_parts > 1 else
            placed.withColumn("chunk", dealt(chunks)).select("cell", "chunk", "vec_id", "row", "vec", F.lit(0).alias("part")))

    def search(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            tree, ids, own = CoverTree(_matrix(left["vec"], dim)), left["vec_id"].to_numpy(), left["row"].to_numpy()
            for q, of, p, f in zip(*(right[c].to_pylist() for c in ("ids", "own", "points", "floors"))):
                name = dict(zip(of, q))
                found = dual_search(CoverTree(np.array(p).reshape(-1, dim)), np.array(of), np.array(f), tree, own, ids, k)
                out += [(r, name[r], v, s) for r, v, s in found]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64())
                         for i, n in enumerate(("query_row", "query_id", "vec_id", "score"))})

    keys = ("cell", "chunk", "part")
    return data.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(search, schema)


def embedding_neighbours(embeddings: DataFrame) -> DataFrame:
    """The five best inner products of every 50th embedding among all others."""
    rows = embeddings.select("vec_id", quantise(F.col("embedding")).alias("vec"))
    return top_k(rows, F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5
"""
