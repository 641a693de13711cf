"""Operator 9: document fingerprints by a randomised edit embedding.

A shared random walk reads a text from left to right: at step ``t`` on character
``c`` it moves on if the shared bit (c, t) is one, else it stays, and every step
writes the character it stands on. Texts at small edit distance meet again after an
edit and write mostly equal symbols, so edit distance becomes Hamming distance. The
fingerprint samples ``SLOTS`` steps of the walk (shared random choices that depend
on the length alone, and agree for most slots when lengths are close) and keeps
four hashed bits of each symbol. Likeness of two fingerprints is their share of
equal slots, corrected for chance. Near pairs come from bands of sampled slots, the same at
every size: members of a band are first compared with one of them
and groups found so contracted; then all members of different groups are compared, in
blocks of ``BLOCK`` x ``BLOCK`` inside tasks. A verified spanning forest leaves a task,
and ``near_id`` is the smallest id of a document's group. No band is capped.
What a later step reads is written as compressed parquet to the shared folder.

Edge cases: null text is empty; an empty text has the fingerprint of pads only;
texts of any length are walked whole; equal ids are ordered by text; null ids come
last; with one row the next document is the row itself; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from suitewise.llm.common import stored, width
from suitewise.llm.near_dedup import components

SLOTS = 128
_PERIOD = 4096  # the shared bits repeat after so many steps
_CLASSES = 256
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
CHUNK_CHARS = 1 << 22
CHUNK_ROWS = 4096
BLOCK = 512
PER_BAND = 10
CHUNK_NODES = 16384
ENTRIES = 1 << 21  # entries of bands a task sorts at a time
ROWS = 1 << 16
MISS = 3e-5  # chance that a pair of the least likeness shares no band


def _moves() -> np.ndarray:
    """For (class, step modulo the period): steps until the shared bit is one, that step included."""
    bits = np.random.default_rng(9).integers(0, 2, (_CLASSES, _PERIOD), dtype=np.int8)
    bits[:, -1] = 1
    out = np.zeros((_CLASSES, _PERIOD), np.int32)
    wait = np.ones(_CLASSES, np.int32)
    for t in range(_PERIOD - 1, -1, -1):
        wait = np.where(bits[:, t] == 1, 1, wait + 1)
        out[:, t] = wait
    return out.reshape(-1)


def _records() -> list[np.ndarray]:
    """Per slot the rising steps at which a fresh random priority beats all before it.

    For a walk of L steps a slot samples its last record below L, which is a uniform
    step, and the same one for two lengths with probability shorter / longer.
    """
    rng = np.random.default_rng(99)
    out = []
    for _ in range(SLOTS):
        steps, at = [0], 0
        while at < 1 << 40:
            at = max(at + 1, int((at + 1) / (1.0 - rng.random())))
            steps.append(at)
        out.append(np.array(steps, np.int64))
    return out


class Embedder:
    def __init__(self):
        self.moves, self.records = _moves(), _records()
        self.salt = np.random.default_rng(999).integers(1, 1 << 62, SLOTS, dtype=np.uint64) | np.uint64(1)

    def fingerprints(self, texts: list[str]) -> list[str]:
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        classes = (points * np.uint32(2654435761) >> np.uint32(24)).astype(np.int32) * _PERIOD
        order = np.argsort(-sizes, kind="stable")
        # step at which the walk comes to each character, and where each walk ends
        reached, end = np.zeros(len(points), np.int32), np.zeros(len(texts), np.int64)
        at, length = starts[order].copy(), sizes[order]
        step = np.zeros(len(texts), np.int32)
        longest = int(length[0]) if len(length) else 0
        active = len(texts) - np.searchsorted(length[::-1], np.arange(longest), side="right")
        i = 0
        while i < longest and (k := int(active[i])) > 12:
            here, now = at[:k], step[:k]
            reached[here] = now
            now += self.moves[classes[here] + (now & _PERIOD - 1)]
            here += 1
            i += 1
        moves = self.moves
        for d in range(int(active[i]) if i < longest else 0):  # the few longest texts go on one by one
            now, tail = int(step[d]), []
            for c in classes[at[d]:starts[order[d]] + length[d]].tolist():
                tail.append(now)
                now += int(moves[c + (now & _PERIOD - 1)])
            reached[at[d]:at[d] + len(tail)] = tail
            step[d] = now
        end[order] = step
        steps = np.empty((SLOTS, len(texts)), np.int64)
        for s, record in enumerate(self.records):
            steps[s] = record[np.maximum(np.searchsorted(record, 2 * sizes, side="left") - 1, 0)]
        out = np.zeros((len(texts), SLOTS), np.uint64)
        for d in range(len(texts)):
            n = sizes[d]
            if n:
                p = steps[:, d]
                own = slice(starts[d], starts[d] + n)
                symbol = points[own][np.searchsorted(reached[own], p, side="right") - 1].astype(np.uint64) + np.uint64(1)
                out[d] = np.where(p < end[d], symbol, 0)
        nibble = (out * self.salt) >> np.uint64(37) & np.uint64(15)
        text = _HEX[nibble].tobytes().decode()
        return [text[d * SLOTS:(d + 1) * SLOTS] for d in range(len(texts))]


def likeness(a: str, b: str) -> float:
    """Share of equal slots, corrected for the chance of one in sixteen."""
    same = sum(x == y for x, y in zip(a, b)) / SLOTS
    return max(0.0, (same - 1 / 16) / (15 / 16))


def edited(text: str, following: str) -> str:
    """``text`` whose last third is replaced by the beginning of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, extra, doc_id, text): parts hold descending ids; the last row of a part, ``extra``, repeats
    the first row of the part after it (after the last part: of the first).

    Parts are cut at fixed ids, quantiles of ``doc_id``, so texts are shuffled once and no order is global.
    """
    rows = docs.select("doc_id", "text")
    cuts = sorted(set(rows.where(F.col("doc_id").isNotNull()).approxQuantile(
        "doc_id", [i / width(docs.sparkSession) for i in range(1, width(docs.sparkSession))], 0.001)))
    # the highest ids are part 0; nulls are last
    bound = F.array(*[F.lit(int(c)).cast("bigint") for c in cuts]).cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(
        F.size(F.filter(bound, lambda c: c >= F.col("doc_id"))))
    dealt = rows.withColumn("part", part)
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # one row per part
    if not heads:
        return dealt.select("part", F.lit(False).alias("extra"), "doc_id", "text")
    follows = {heads[(i + 1) % len(heads)]["head"]: h["part"] for i, h in enumerate(heads)}
    ids = [h for h in follows if h is not None]
    to_part = F.create_map(*[F.lit(x) for h in ids for x in (int(h), follows[h])]) if ids else None
    extra = rows.where(F.col("doc_id").isin(ids)).select(
        to_part[F.col("doc_id")].alias("part"), "doc_id", "text") if ids else None
    if None in follows:
        nulls = rows.where(F.col("doc_id").isNull()).select(
            F.lit(follows[None]).alias("part"), "doc_id", "text").orderBy(F.desc("text")).limit(1)
        extra = nulls if extra is None else extra.unionByName(nulls)
    # among rows of one id the one that comes first stands for it
    extra = extra.groupBy("part", "doc_id").agg(F.max(F.struct("text"))["text"].alias("text"))
    return (dealt.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
            .select("part", "extra", "doc_id", "text")
            .repartition(width(docs.sparkSession), "part")
            .sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")))


def _runs(batches) -> Iterator[list[tuple]]:
    """Runs of rows (part, extra, doc_id, text), bounded in size; the last row of a run begins the next one."""
    run, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            row = (*row[:3], row[3] or "")
            run.append(row)
            size += len(row[3])
            if len(run) > 1 and (len(run) > CHUNK_ROWS or size > CHUNK_CHARS):
                yield run
                run, size = [row], len(row[3])
    if run:
        yield run


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and likeness to the edit and to the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        embed = Embedder()
        for rows in _runs(batches):
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0]]
            own = dict(zip(range(len(rows)), embed.fingerprints([r[3] for r in rows])))
            first = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            other = embed.fingerprints(changed)
            yield pa.RecordBatch.from_arrays([
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([own[i] for i in first], pa.string()), pa.array(other, pa.string()),
                pa.array([likeness(own[i], o) for i, o in zip(first, other)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in first], pa.float64())], names=names)

    return with_next(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                           "edited_fingerprint string, near_edited double, near_next double")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"])
    names = [*kept.columns, "fingerprint"]
    at = kept.columns.index(text)

    def run(batches):
        embed = Embedder()
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(start, CHUNK_ROWS)
                prints = embed.fingerprints([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.string())],
                                                 names=names)

    return kept.mapInArrow(run, StructType(list(kept.schema.fields)).add("fingerprint", "string"))


def banding(least: float, per_band: int = PER_BAND) -> tuple[int, int]:
    """Number of bands and slots of each: a pair of likeness ``least`` misses all bands with chance ``MISS``.

    They don't depend on the number of documents. Slots of unrelated letters agree by chance for about one pair in
    eight, so a stranger shares a band of ten slots with chance 1e-9.
    """
    hit = (least * 15 / 16 + 1 / 16) ** per_band
    return math.ceil(math.log(MISS) / math.log1p(-hit)), per_band


def _codes(column: pa.Array) -> np.ndarray:
    """Slots of each fingerprint (64 bytes, two slots a byte), one row each."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS // 2)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, SLOTS)


def _corrected(same: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (same / SLOTS - 1 / 16) / (15 / 16))


_LINK = "u bigint, v bigint, likeness double"


def _links(u, v, alike) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(alike, pa.float64())],
                                      names=["u", "v", "likeness"])


def forest(node: np.ndarray, comp: np.ndarray, block: np.ndarray, codes: np.ndarray, least: float) -> list[tuple]:
    """A spanning forest (u, v, likeness) of the links between members of different groups (and blocks, if two)."""
    root, out = comp.copy(), []
    two = block.min() != block.max()
    for x in range(len(node) - 1):
        apart = root[x + 1:] != root[x]
        if two:
            apart &= block[x + 1:] != block[x]
        other = np.flatnonzero(apart) + x + 1
        if not len(other):
            continue
        alike = _corrected((codes[other] == codes[x]).sum(axis=1))
        for y, how in zip(other[alike >= least].tolist(), alike[alike >= least].tolist()):
            if root[y] != root[x]:
                out.append((int(node[x]), int(node[y]), how))
                root[root == root[y]] = root[x]
    return out


class Bands:
    """Hashes of ``bands`` fixed choices of ``per_band`` slots."""

    def __init__(self, bands: int, per_band: int):
        rng = np.random.default_rng(24)
        self.picks = [sorted(rng.choice(SLOTS, per_band, replace=False).tolist()) for _ in range(bands)]

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """(fingerprints, bands) hashes of 64 bits; the band's number is part of them."""
        out = np.empty((len(codes), len(self.picks)), np.uint64)
        for b, pick in enumerate(self.picks):
            h = np.full(len(codes), b + 1, np.uint64)
            for slot in pick:
                h = h * np.uint64(16) + codes[:, slot]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, b] = h ^ h >> np.uint64(32)
        return out


def _chunks(batches) -> Iterator[tuple[int, np.ndarray]]:
    """(first node, codes) of at most ``CHUNK_NODES`` consecutive node numbers."""
    for batch in batches:
        node, at = batch["node"].to_numpy(), 0
        ends = np.flatnonzero(np.diff(node) != 1) + 1
        for end in [*ends.tolist(), len(node)]:
            while at < end:
                size = min(CHUNK_NODES, end - at)
                yield int(node[at]), _codes(batch["fingerprint"].slice(at, size))
                at += size


def _runs_of(hashes: np.ndarray, nodes: np.ndarray):
    """Both sorted by (hash, node), where each run of one hash starts, and the first node of each row's run."""
    order = np.lexsort((nodes, hashes))
    hashes, nodes = hashes[order], nodes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes, nodes, new, nodes[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(nodes) else nodes


_SHARED = "band bigint, node bigint, center bigint"


def _shared_rows(band, node, center) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(band), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at:at + ROWS].astype(np.int64), pa.int64())
                                          for c in (band, node, center)], names=["band", "node", "center"])


def shared_bands(nodes: DataFrame, bands: int, per_band: int) -> DataFrame:
    """Rows (band, node, center) of all bands that several nodes share; ``center`` is a member of the band.

    A chunk of nodes settles its own bands and sends one node for each, packed by partition (five bytes of the
    hash, two of the place in the chunk), so a band that very many nodes share sends one entry a chunk.
    """
    spark = nodes.sparkSession
    parts = max(width(spark), math.ceil(nodes.count() * bands / ENTRIES))
    low = np.uint64((1 << 40) - 1)

    def cells(batches):
        banded = Bands(bands, per_band)
        for base, codes in _chunks(batches):
            h = banded.hashes(codes).reshape(-1)
            cell = (h >> np.uint64(40)) % np.uint64(parts) << np.uint64(40) | h & low
            yield base, *_runs_of(cell, np.repeat(np.arange(len(codes), dtype=np.uint32), bands))

    def inside(batches):
        for base, cell, place, new, first in cells(batches):
            alone = new.copy()
            alone[:-1] &= new[1:]
            yield from _shared_rows(cell[~alone], place[~alone] + np.int64(base), first[~alone] + np.int64(base))

    def sent(batches):
        for base, cell, place, new, _ in cells(batches):
            cell, place = cell[new], place[new].astype(np.uint16)
            part = (cell >> np.uint64(40)).astype(np.int64)  # rising, as the cells are sorted
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            low5 = np.ascontiguousarray(cell).view(np.uint8).reshape(-1, 8)[:, :5]
            pieces = list(zip(starts, [*starts[1:], len(part)]))
            yield pa.RecordBatch.from_arrays([
                pa.array([int(part[a]) for a, _ in pieces], pa.int64()), pa.array([base] * len(pieces), pa.int64()),
                pa.array([low5[a:b].tobytes() for a, b in pieces], pa.binary()),
                pa.array([place[a:b].tobytes() for a, b in pieces], pa.binary())], names=["part", "base", "low", "place"])

    def across(batches):
        part, held = None, []

        def settle():
            if not held:
                return
            raw = np.zeros((sum(len(h[2]) for h in held) // 2, 8), np.uint8)
            raw[:, :5] = np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(-1, 5)
            cell = raw.view(np.uint64).reshape(-1) | np.uint64(part << 40)
            node = np.concatenate([np.frombuffer(h[2], np.uint16).astype(np.int64) + h[0] for h in held])
            cell, node, new, first = _runs_of(cell, node)
            alone = new.copy()
            alone[:-1] &= new[1:]
            yield from _shared_rows(cell[~alone], node[~alone], first[~alone])

        for batch in batches:
            for p, *row in zip(*(batch[c].to_pylist() for c in ("part", "base", "low", "place"))):
                if p != part:
                    yield from settle()
                    part, held = p, []
                held.append(row)
        yield from settle()

    packed = nodes.mapInArrow(sent, "part bigint, base bigint, low binary, place binary")
    both = nodes.mapInArrow(inside, _SHARED).unionByName(
        packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(across, _SHARED))
    return stored(both, "bands")


def _node_links(nodes: DataFrame, bands: int | None, per_band: int | None, least: float) -> tuple[DataFrame, DataFrame]:
    """Links (u, v, likeness) between the rows (node, fingerprint), and the group (node, root) of each linked node."""
    if bands is None or per_band is None:
        bands, per_band = banding(least)
    shared = shared_bands(nodes, bands, per_band)

    def star(batches):
        for batch in batches:
            alike = _corrected((_codes(batch["fingerprint"]) == _codes(batch["other"])).sum(axis=1)) \
                if batch.num_rows else np.zeros(0)
            near = alike >= least
            yield _links(batch["node"].to_numpy()[near], batch["center"].to_numpy()[near], alike[near])

    def block_rows(batches):
        group, held = None, []

        def links():
            if len({h[1] for h in held}) < 2:
                return _links([], [], [])
            node, comp, block, prints = zip(*held)
            found = forest(np.array(node), np.array(comp), np.array(block), _codes(pa.array(prints)), least)
            return _links(*(list(c) for c in zip(*found))) if found else _links([], [], [])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("band", "kind", "i", "j", "node", "comp", "block",
                                                            "fingerprint"))):
                if row[:4] != group:
                    yield links()
                    group, held = row[:4], []
                held.append(row[4:])
        yield links()

    other = nodes.select(F.col("node").alias("center"), F.col("fingerprint").alias("other"))
    edges = stored(shared.where("node <> center").select("node", "center").distinct().join(nodes, "node")
                   .join(other, "center").mapInArrow(star, _LINK), "stars")
    roots = stored(components(edges.select("u", "v")), "roots")
    # members of a band in several groups: its largest group is compared with the rest, the rest with itself
    members = shared.select("band", "node").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    sizes = members.groupBy("band", "comp").agg(F.count("*").alias("c"))
    several = sizes.groupBy("band").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"),
                                        F.count("*").alias("k")).where("k > 1")
    several = several.select("band", F.col("main.comp").alias("main"), (F.col("k") > 2).alias("more"),
                             F.ceil(F.col("main.c") / BLOCK).cast("int").alias("q"),
                             F.ceil((F.col("m") - F.col("main.c")) / BLOCK).cast("int").alias("r"))
    dealt = stored(members.select("band", "node", "comp").join(several, "band").distinct(), "several")
    place, own = F.xxhash64("node"), F.col("comp") == F.col("main")
    b = F.pmod(place, F.when(own, F.col("q")).otherwise(F.col("r"))).cast("int")

    def cells(kind: int, i, j, block):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), block.alias("block"))

    to_rest, to_main = F.sequence(F.lit(0), F.col("r") - 1), F.sequence(F.lit(0), F.col("q") - 1)
    across = F.when(own, F.transform(to_rest, lambda j: cells(0, F.col("b"), j, F.lit(0)))).otherwise(
        F.transform(to_main, lambda i: cells(0, i, F.col("b"), F.lit(1))))
    within = F.transform(F.when(~own & F.col("more"), to_rest).otherwise(F.array().cast("array<int>")), lambda j: cells(
        1, F.least(F.col("b"), j), F.greatest(F.col("b"), j), F.col("b")))
    blocks = (dealt.withColumn("b", b).select("band", "node", "comp", F.explode(F.concat(across, within)).alias("cell"))
              .select("band", "cell.*", "node", "comp").join(nodes, "node"))
    more = (blocks.repartition("band", "kind", "i", "j").sortWithinPartitions("band", "kind", "i", "j")
            .mapInArrow(block_rows, _LINK))
    edges = stored(edges.unionByName(more), "links")
    return edges, components(edges.select("u", "v"))


def _nodes(prints: DataFrame) -> DataFrame:
    """A node for each different fingerprint (hexadecimal, here packed into 64 bytes), by its smallest id."""
    return stored(prints.groupBy(F.unhex("fingerprint").alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"))
                  .withColumn("node", F.monotonically_increasing_id()), "nodes")


def near_links(prints: DataFrame, bands: int | None = None, per_band: int | None = None,
               least: float = 0.8) -> DataFrame:
    """Verified links (doc_id, center_id, likeness), the smaller id second, that connect all fingerprints of one
    group: those joined by pairs of likeness ``least`` that share a band.

    Rows of one fingerprint meet as one, by their smallest id.
    """
    nodes = _nodes(prints)
    edges, _ = _node_links(nodes.select("node", "fingerprint"), bands, per_band, least)
    u, v = (nodes.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_id")) for c in "uv")
    return edges.groupBy("u", "v").agg(F.max("likeness").alias("likeness")).join(u, "u").join(v, "v").select(
        F.greatest("u_id", "v_id").alias("doc_id"), F.least("u_id", "v_id").alias("center_id"), "likeness")


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """``edit_fingerprints`` with ``near_id``, the smallest id of the group of near fingerprints."""
    packed = ("edited_sha256", "fingerprint", "edited_fingerprint")
    names = edit_fingerprints(docs)
    prints = stored(names.select(*[F.unhex(c).alias(c) if c in packed else c for c in names.columns]), "prints")
    nodes = _nodes(prints.select(F.hex("fingerprint").alias("fingerprint"), "doc_id"))
    _, roots = _node_links(nodes.select("node", "fingerprint"), None, None, 0.8)
    found = stored(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "groups")
    least = found.groupBy("root").agg(F.min("doc_id").alias("near_id"))
    return prints.join(found.join(least, "root").select("fingerprint", "near_id"), "fingerprint").select(
        *[F.lower(F.hex(c)).alias(c) if c in packed else c for c in names.columns], "near_id")
