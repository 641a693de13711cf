"""Operator 12: near-duplicate vectors by randomised-rotation binary codes with correction factors.

Every unit vector x gets the signs of P x for some random rotations P, and for each the factor <sign(Px)/sqrt(d), Px>.
For a stored code and another vector y, <code, Py> / factor is an unbiased estimate of <x, y>, and its error stays below
``EPSILON`` sqrt((1 - factor**2) / factor**2 / ((d - 1) rotations)) but for about two pairs in 10**9. Pairs whose upper
bound is below the least cosine are done; all others are computed again in double precision.

1. Equal vectors of one label become one node; only nodes are compared.
2. Candidates meet in bands: ``bits`` signs of rotations of their own per band. So many bands are used that a pair at
   the least cosine misses all of them with probability ``MISS`` (the number of bits grows with the logarithm of the
   largest label, the bands as a small power of it). Each member of a bucket is compared with the bucket's smallest
   node by estimate, then exactly; the links give components.
3. Buckets that still hold several components compare the members of their largest component with the others, and
   the others among themselves, in blocks; a spanning forest of the links leaves a task.
4. Links inside a component are counted. Angles to the component's root cut a large one into shells: two shells whose
   angles add up to no more than the least angle are linked whole, two whose angles differ by more are not linked at
   all; only the other pairs of shells are compared, in blocks of ``BLOCK`` x ``BLOCK``. No pairs leave a task, only
   the number of links per node.

Tight groups of copies are thus counted without comparing their pairs; a group spread about the least angle costs a
comparison (not a row) for each of its pairs.

Edge cases: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different lengths do not either. Rows that repeat an id are rows of their own; the component of a
group is its smallest id that is not null (null if there is none), that of a lone row its own id. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitewise.llm.common import cut
from suitewise.llm.near_dedup import components

LEAST = 0.98
EPSILON = 6.0
MISS = 1e-7
CODE_BITS = 256
BLOCK = 512
SHELLS = 8
SEED = 12


def usable(vector: Column) -> Column:
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return (F.size(vector) > 0) & F.exists(doubles, lambda x: x != 0) & F.forall(
        doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def units(column: pa.Array) -> np.ndarray:
    """The vectors of one length at unit length, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values ** 2).sum(axis=1, keepdims=True))


class Rotations:
    """Random rotations of a length, numbered; the same in every task."""

    def __init__(self, dim: int):
        self.dim, self.held = dim, []

    def __getitem__(self, i: int) -> np.ndarray:
        while len(self.held) <= i:
            q, r = np.linalg.qr(np.random.default_rng((SEED, self.dim, len(self.held))).standard_normal((self.dim, self.dim)))
            self.held.append(q * np.sign(np.diag(r)))
        return self.held[i]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed signs under the first rotations, and the correction factor of each."""
        signs, factors = [], []
        for r in range(-(-CODE_BITS // self.dim)):
            turned = x @ self[r].T
            signs.append(turned > 0)
            factors.append(np.abs(turned).sum(axis=1) / math.sqrt(self.dim))
        return np.packbits(np.hstack(signs), axis=1), np.stack(factors, axis=1)

    def bands(self, x: np.ndarray, bands: int, bits: int) -> np.ndarray:
        """Keys of every vector: ``bits`` signs a band, of rotations that the codes do not use."""
        first = -(-CODE_BITS // self.dim)
        needed = bands * bits
        signs = np.hstack([x @ self[first + r].T > 0 for r in range(-(-needed // self.dim))])[:, :needed]
        return signs.reshape(len(x), bands, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))

    def decoded(self, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors whose product with y estimates <x, y> without bias, and the bound of the error for unit y."""
        n = factors.shape[1]
        signs = np.unpackbits(codes, axis=1)[:, :n * self.dim].astype(np.float64) * 2 - 1
        out = sum(signs[:, r * self.dim:(r + 1) * self.dim] @ self[r] / (math.sqrt(self.dim) * factors[:, r:r + 1])
                  for r in range(n)) / n
        spread = np.maximum(1 / factors ** 2 - 1, 0).mean(axis=1)
        return out, EPSILON * np.sqrt(spread / (n * max(self.dim - 1, 1)))


def banding(largest: int, least: float = LEAST) -> tuple[int, int]:
    """(bands, bits a band) for labels of up to ``largest`` nodes."""
    bits = min(48, max(16, math.ceil(math.log2(max(largest, 1))) + 2))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-agree)), bits


def _codes_of(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _factors_of(batch) -> np.ndarray:
    return batch["factors"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _by_length(batch):
    """The rows of a batch, one length of vectors at a time."""
    dims = batch["dim"].to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d))


def _coded(nodes: DataFrame, bands: int, bits: int) -> DataFrame:
    def run(batches):
        turned: dict[int, Rotations] = {}
        for whole in batches:
            for d, batch in _by_length(whole):
                rotations, x = turned.setdefault(d, Rotations(d)), units(batch["vec"])
                codes, factors = rotations.code(x)
                yield pa.RecordBatch.from_arrays(
                    [batch["node"], pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(factors.tolist(), pa.list_(pa.float64())),
                     pa.array(rotations.bands(x, bands, bits).tolist(), pa.list_(pa.int64()))],
                    names=["node", "code", "factors", "bands"])

    return nodes.select("node", "dim", "vec").mapInArrow(
        run, "node bigint, code binary, factors array<double>, bands array<bigint>")


def _possible(pairs: DataFrame, nodes: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """The pairs (node, center) whose estimated cosine may reach ``least``."""
    def run(batches):
        turned: dict[int, Rotations] = {}
        for whole in batches:
            for d, batch in _by_length(whole):
                decoded, error = turned.setdefault(d, Rotations(d)).decoded(_codes_of(batch), _factors_of(batch))
                estimate = (decoded * units(batch["vec"])).sum(axis=1)
                yield batch.select(["node", "center"]).filter(pa.array(estimate + error >= least))

    heads = nodes.select(F.col("node").alias("center"), "dim", "vec")
    return (pairs.join(codes.select("node", "code", "factors"), "node").join(heads, "center")
            .select("node", "center", "dim", "code", "factors", "vec").mapInArrow(run, "node bigint, center bigint"))


def _linked(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) of the pairs (node, center) whose exact cosine reaches ``least``."""
    def run(batches):
        for whole in batches:
            for _, batch in _by_length(whole):
                cosine = (units(batch["vec"]) * units(batch["head"])).sum(axis=1)
                keep = batch.select(["node", "center"]).filter(pa.array(cosine >= least))
                yield keep.rename_columns(["u", "v"])

    own = nodes.select("node", "dim", "vec")
    heads = nodes.select(F.col("node").alias("center"), F.col("vec").alias("head"))
    return pairs.join(own, "node").join(heads, "center").select("node", "center", "dim", "vec", "head").mapInArrow(
        run, "u bigint, v bigint")


def block_links(x: np.ndarray, decoded: np.ndarray, error: np.ndarray, wanted: np.ndarray, least: float) -> np.ndarray:
    """Which of the ``wanted`` pairs of a block are linked: estimates first, then the undecided exactly."""
    unsure = wanted & (x @ decoded.T + error >= least)
    if 4 * unsure.sum() > unsure.size:
        return unsure & (x @ x.T >= least)
    a, b = np.nonzero(unsure)
    for lo in range(0, len(a), 1 << 16):
        i, j = a[lo:lo + (1 << 16)], b[lo:lo + (1 << 16)]
        unsure[i, j] = (x[i] * x[j]).sum(axis=1) >= least
    return unsure


def forest(linked: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, between components, of the links (a, b)."""
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for a, b in zip(*np.nonzero(linked)):
        p, q = find(int(comp[a])), find(int(comp[b]))
        if p != q:
            root[p] = q
            out.append((int(a), int(b)))
    return out


def _groups(batches, keys: list[str]):
    """The rows of each key as one table; rows come sorted by key and a key holds at most two blocks."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in zip(np.r_[0, change].tolist(), np.r_[change, batch.num_rows].tolist()):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pairwise(blocks: DataFrame, keys: list[str], schema: str, least: float, rows) -> DataFrame:
    """``rows(group, linked)`` of every block; ``side`` 0 is compared with 1, and side 2 within itself."""
    def run(batches):
        turned: dict[int, Rotations] = {}
        for group in _groups(batches, keys):
            side = group["side"].to_numpy()
            wanted = (side[:, None] != side) | ((side == 2)[:, None] & (side == 2))
            comp = group["comp"].to_numpy()
            if "i" in keys:
                wanted &= comp[:, None] != comp
            else:
                wanted &= ~np.eye(len(side), dtype=bool)
            if wanted.any():
                rotations = turned.setdefault(group["dim"][0].as_py(), Rotations(group["dim"][0].as_py()))
                decoded, error = rotations.decoded(_codes_of(group), _factors_of(group))
                yield rows(group, block_links(units(group["vec"]), decoded, error, wanted, least))

    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _edge_rows(group, linked):
    comp, node = group["comp"].to_numpy(), group["node"].to_numpy()
    pairs = np.array(forest(linked | linked.T, comp), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["u", "v"])


def _count_rows(group, linked):
    n = (linked | linked.T) @ group["n"].to_numpy()
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(group["node"].to_numpy()[some]), pa.array(n[some])], names=["node", "links"])


def _across(buckets: DataFrame, roots: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """Edges between the components that share a bucket; a bucket's largest is not compared within itself."""
    members = cut(buckets.where("m > 2").join(roots, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("comp")))
    per = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = per.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m"),
                                      F.count("*").alias("comps")).where("comps > 1")
    parts = mixed.select("bucket", F.col("top.comp").alias("major"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("mp"),
                         F.ceil((F.col("m") - F.col("top.n")) / BLOCK).cast("int").alias("p"))
    of = members.join(parts, "bucket").withColumn("is_major", F.col("comp") == F.col("major"))
    # blocks (i, j): i < p for the others; j < p for the others, p <= j < p + mp for the largest component
    own = F.when(F.col("is_major"), F.col("p") + F.pmod(F.xxhash64("node"), "mp")).otherwise(
        F.pmod(F.xxhash64("node"), "p")).cast("int")
    partners = F.when(F.col("is_major"), F.sequence(F.lit(0), F.col("p") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("p") + F.col("mp") - 1))
    blocks = (of.withColumn("own", own).withColumn("with", F.explode(partners))
              .select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
                      F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1).alias("side"),
                      "node", "comp").join(full, "node"))
    return _pairwise(blocks, ["bucket", "i", "j"], "u bigint, v bigint", least, _edge_rows)


def _shell_angles(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, angle to the component's root)."""
    def run(batches):
        for whole in batches:
            for _, batch in _by_length(whole):
                cosine = (units(batch["vec"]) * units(batch["head"])).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch["node"], pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["node", "angle"])

    heads = nodes.select(F.col("node").alias("root"), F.col("vec").alias("head"))
    return members.join(nodes.select("node", "dim", "vec"), "node").join(heads, "root").select(
        "node", "dim", "vec", "head").mapInArrow(run, "node bigint, angle double")


def _links_inside(roots: DataFrame, nodes: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """(node, links): rows linked to each node of a component, its own copies aside."""
    sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root")
    large = sized.where(F.col("size") > BLOCK)
    step = math.acos(least) / SHELLS
    shells = large.join(_shell_angles(large, nodes), "node").select(
        "root", "node", F.floor(F.col("angle") / step).cast("int").alias("shell"))
    members = cut(sized.where(F.col("size") <= BLOCK).select("root", "node", F.lit(-1).alias("shell")).unionByName(shells)
                  .join(nodes.select("node", "n"), "node"))
    per = members.where("shell >= 0").groupBy("root", "shell").agg(F.count("*").alias("k"), F.sum("n").alias("rows")).select(
        "root", "shell", "rows", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts"))
    other = per.select("root", F.col("shell").alias("shell2"), F.col("rows").alias("rows2"), F.col("parts").alias("parts2"))
    margin = 1e-6 / step  # angles near 0 are only good to some 1e-8
    both = cut(per.join(other, "root").withColumn("sure", F.col("shell") + F.col("shell2") + 2 + margin <= SHELLS)
               .where(F.abs(F.col("shell") - F.col("shell2")) - 1 <= SHELLS + margin))
    whole = both.where("sure").groupBy("root", "shell").agg(
        F.sum("rows2").alias("links"), F.max(F.col("shell") == F.col("shell2")).alias("own"))
    sure = members.join(whole, ["root", "shell"]).select(
        "node", (F.col("links") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("links"))
    # the pairs of shells to compare, as blocks lo <= hi of (shell, part)
    wide = 1 << 20
    dealt = (members.join(both.where(~F.col("sure")).select("root", "shell", "parts", "shell2", "parts2"), ["root", "shell"])
             .withColumn("own", F.col("shell") * F.lit(wide).cast("bigint") + F.pmod(F.xxhash64("node"), "parts"))
             .withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
             .withColumn("with", F.col("shell2") * F.lit(wide).cast("bigint") + F.col("part2"))
             .select("root", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"),
                     F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1).alias("side"),
                     "node", "n"))
    small = members.where("shell < 0").select(
        "root", F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"), F.lit(2).alias("side"), "node", "n")
    blocks = small.unionByName(dealt).withColumn("comp", F.col("root")).join(full, "node")
    counted = _pairwise(blocks, ["root", "lo", "hi"], "node bigint, links bigint", least, _count_rows)
    return counted.unionByName(sure).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select("vec_id", "label", F.col(vector).alias("vec"))
    fit = F.coalesce(F.col("label").isNotNull() & usable(F.col("vec")), F.lit(False))
    nodes = cut(rows.where(fit).groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
                .withColumn("dim", F.size("vec")).withColumn("node", F.monotonically_increasing_id()))
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    codes = cut(_coded(nodes, *banding(largest, least)))
    banded = codes.join(nodes.select("node", "label", "dim"), "node").select(
        "node", "label", "dim", F.posexplode("bands").alias("band", "key")).select(
        "node", F.xxhash64("label", "dim", "band", "key").alias("bucket"), "label", "dim")
    shared = banded.groupBy("bucket", "label", "dim").agg(
        F.count("*").alias("m"), F.min("node").alias("center")).where("m > 1").withColumn(
        "number", F.monotonically_increasing_id())
    buckets = cut(banded.join(cut(shared), ["bucket", "label", "dim"]).select(
        F.col("number").alias("bucket"), "m", "center", "node"))
    pairs = buckets.where("node <> center").select("node", "center").distinct()
    edges = cut(_linked(cut(_possible(pairs, nodes, codes, least)), nodes, least))
    full = nodes.select("node", "dim", "vec").join(codes.select("node", "code", "factors"), "node")
    more = _across(buckets, cut(components(edges)), full, least)
    roots = cut(components(edges.unionByName(more)))

    names = roots.join(nodes.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component"))
    found = (nodes.join(roots.join(names, "root"), "node", "left")
             .join(_links_inside(roots, nodes, full, least), "node", "left")
             .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "first_id").alias("component")))
    linked = rows.where(fit).join(found, ["label", "vec"]).select(
        "vec_id", "n_links", F.when(F.col("n_links") > 0, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u),
c AS (SELECT node, min(seen) AS low FROM reach GROUP BY node)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.low AS component_id, e.vec_id = c.low AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
