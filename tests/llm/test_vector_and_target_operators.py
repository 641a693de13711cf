"""Code compression, near-duplicate vectors and importance resampling against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from suitewise.llm import codes, resample, vector_dedup

VECTORS = "vec_id bigint, embedding array<float>, label int, vec string, node string, n int"
DOCS = "doc_id bigint, text string, n_words string, weight string, place string"


def _odd_rows(dim):
    """Rows that take no part, and extra columns whose names clash with inner ones."""
    return [(900, None, 1, "x", "y", 1), (901, [None] * dim, 1, "x", "y", 1), (902, [float("nan")] * dim, 1, None, "y", 1),
            (903, [float("inf")] + [0.0] * (dim - 1), 1, "x", None, 1), (904, [], 1, "x", "y", None)]


def _vectors(seed, n, dim, centres=3, spread=0.02):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centres, dim))
    out = []
    for i in range(n):
        x = rng.standard_normal(dim) * 0.2 if rng.random() < 0.4 else (
            base[rng.integers(centres)] * rng.choice([0.1, 0.2]) + rng.standard_normal(dim) * spread * rng.choice([0.1, 0.5, 1]))
        out.append((i, [float(np.float32(v)) for v in x], None if i % 17 == 0 else int(i % 2), "x", "y", 2))
    out += [(n + i, out[5][1], out[5][2], "x", "y", 3) for i in range(4)]  # copies
    return out


def _plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0])
    points = [[math.floor(256 * x) for x in r[1]] for r in kept]
    size = len(points[0]) // parts
    books = [[points[e][p * size:(p + 1) * size] for e in range(min(entries, len(points)))] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))

    def assign():
        return [[nearest(v[p * size:(p + 1) * size], books[p]) for p in range(parts)] for v in points]

    for _ in range(rounds):
        given = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * size:(p + 1) * size] for v, g in zip(points, given) if g[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    label = {}
    out = {}
    for r, g in zip(kept, assign()):
        error = sum(d for d, _ in g)
        label[r[2]] = label.get(r[2], 0) + error
        out[r[0]] = ("".join(f"{e:02x}" for _, e in g), error, r[2])
    flat = ",".join(str(x) for book in books for entry in book for x in entry)
    return {k: (c, e, label[x]) for k, (c, e, x) in out.items()}, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("seed,n,dim", [(1, 300, 32), (2, 40, 16), (3, 700, 64)])
def test_codes_match_plain_lloyd(spark, seed, n, dim):
    rows = _vectors(seed, n, dim) + _odd_rows(dim)
    got = codes.compress_embeddings(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    want, digest = _plain_codes(rows)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_odd_tables(spark):
    assert codes.compress_embeddings(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(1, [0.5] * 10, 1, "x", "y", 1), (2, [0.5] * 9, 1, "x", "y", 1), (2, [1e30] * 10, None, "x", "y", 1),
            (2, [0.25] * 10, None, "x", "y", 1)]
    coded, books = codes.compress(spark.createDataFrame(rows, VECTORS))
    got = sorted((r["vec_id"], r["error"]) for r in coded.collect())
    assert [g[0] for g in got] == [1, 2, 2] and books.shape[2] == 1  # 10 components fill 16 parts of one
    assert {r["error"] for r in coded.collect()} == {0}  # every kept row is an entry


def test_code_stands_for_its_vector(spark):
    rows = [r for r in _vectors(4, 60, 32)]
    coded, books = codes.compress(spark.createDataFrame(rows, VECTORS))
    by_id = {r[0]: r[1] for r in rows}
    for r in coded.collect():
        away = np.floor(256 * np.array(by_id[r["vec_id"]])) - codes.reconstruct(r["code"], books)
        assert int((away ** 2).sum()) == r["error"]


def test_cover_tree_gives_whole_subtrees_and_holds_its_bounds():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-300, 300, (900, 4)), rng.integers(0, 3, (900, 4)) + 1000])
    tree = codes._unpack(codes._pack(codes.CoverTree(points)))
    entries = rng.integers(-300, 300, (64, 4))
    entries[7] = entries[3]
    want = ((points[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
    assert (tree.entries_of(entries) == want).all()
    starts, ends, _ = tree.assign(entries)
    assert (ends - starts).max() > 800
    sums, counts = tree.totals(entries)
    assert (counts == np.bincount(want, minlength=64)).all()
    assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(64))
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i]:tree.end[i]]
        assert (((own - tree.centre[i]) ** 2).sum(axis=1) <= tree.squared_radius[i]).all()
        assert (4 * tree.squared_radius[tree.first[i]:tree.last[i]] <= tree.squared_radius[i]).all()


def _plain_links(rows, least=0.98):
    use = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in use]
    links = {i: [] for i in range(len(use))}
    for i, a in enumerate(use):
        for j, b in enumerate(use):
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[i] @ unit[j] >= least:
                links[i].append(j)
    out, seen = [], set()
    for i in links:
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - group
            group |= new
            todo += new
        seen |= group
        out += [(use[k][0], len(links[k]), min(use[m][0] for m in group)) for k in group]
    return sorted(out + [(r[0], 0, r[0]) for r in rows if not any(r is u for u in use)])


@pytest.mark.parametrize("block", [vector_dedup.BLOCK, 7])
def test_near_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = (_vectors(6, 260, 24, spread=0.04) + _odd_rows(24) + [(905, [0.0] * 24, 1, "x", "y", 1)]
            + [(1000 + i, [0.25 * (i % 2 + 1)] * 5, 1, "x", "y", 1) for i in range(3)]
            + [(1010 + i, [float(i % 2 + 1)], 1, "x", "y", 1) for i in range(3)])
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    want = _plain_links(rows)
    assert max(n for _, n, _ in want) > 20
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_vectors_of_odd_tables(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(None, [1.0, 0.0], 1, "x", "y", 1), (3, [1.0, 0.0], 1, "x", "y", 1), (3, [1.0, 0.0], 1, "x", "y", 1),
            (2, [1.0, 0.0], None, "x", "y", 1), (4, [0.0, 1.0], 1, "x", "y", 1), (5, [1e30, 0.0], 1, "x", "y", 1)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in got) == [
        (-1, 3, 3), (2, 0, 2), (3, 3, 3), (3, 3, 3), (4, 0, 4), (5, 3, 3)]


def test_chain_reaches_beyond_the_least_angle(spark):
    step = math.acos(0.981)
    rows = [(100 - i, [math.cos(i * step), math.sin(i * step)], 1, "x", "y", 1) for i in range(12)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["component_id"] for r in got} == {89} and sorted(r["n_links"] for r in got) == [1, 1] + [2] * 10


def test_estimates_are_unbiased_and_stay_in_their_bounds():
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((2, 64)) * [[1], [0.4]]
    y = x + y
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    found = []
    for seed in range(300):
        rotations = vector_dedup.Rotations(64)
        q = [np.linalg.qr(np.random.default_rng((seed, i)).standard_normal((64, 64)))[0] for i in range(4)]
        rotations.held = q
        codes_, factors = rotations.code(x[None])
        decoded, error = rotations.decoded(codes_, factors)
        found.append(float(decoded[0] @ y))
        assert abs(found[-1] - x @ y) <= error[0]
    assert abs(np.mean(found) - x @ y) < 4 * np.std(found) / math.sqrt(len(found))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _plain_resample(docs, target, percent=5):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000
                            for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    own, aim = [features(d[1]) for d in docs], [features(t)[1] for t in target]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, f in own:
        np.add.at(s, f, 1)
    for f in aim:
        np.add.at(t, f, 1)
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log(((b + 1) * (S + 10000)) / ((a + 1) * (T + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for d, (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d[0], n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long_enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(long_enough[:percent * len(long_enough) // 100])}
    return [(*r, rank.get(id(r))) for r in rows]


def _texts(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = ["Äpfel", "été", "x", "Y2K", "数据", "a" * 700, "ß", "don", "t", "the", "of", "\U0001f600"] + [f"w{i}" for i in range(60)]
    for i in range(n):
        k = int(rng.choice([0, 1, 2, 3, 19, 20, 45]))
        yield (i, "".join(str(rng.choice(vocabulary)) + str(rng.choice([" ", "-", "\n", "\x00", "'", ", "])) for _ in range(k)))


def test_resampling_matches_plain_form(spark):
    docs = list(_texts(1, 900)) + [(900, None), (901, ""), (902, " ..."), (903, "Long " * 90_000), (None, "nothing " * 25), (7, "w1 " * 30)]
    target = [(i, t) for i, t in _texts(2, 30)] + [(31, None)]
    got = resample.resample(spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS).repartition(6),
                            spark.createDataFrame([(*d, "x", "y", "z") for d in target], DOCS))
    want = _plain_resample(docs, [t for _, t in target])

    def key(r):
        return tuple(-1 if x is None else x for x in r)

    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()),
                  key=key) == sorted(want, key=key)
    assert sum(r[5] is not None for r in want) > 3


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    one = spark.createDataFrame([(1, "a b", "x", "y", "z")], DOCS)
    assert resample.resample_documents(none, one).collect() == []
    got = resample.resample_documents(one, none).collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(3, None)]
    assert dict(resample.resample_documents(one, one).dtypes) == {
        c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}


def test_checksums_of_joined_strings():
    sums = resample.Checksums()
    rng = np.random.default_rng(3)
    for length in (0, 1, 5, 64, 1000, 70_001):
        a, b = rng.bytes(17), rng.bytes(length)
        tables, start = sums.tables(np.array([length]))
        got = resample.append(tables, start, np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32))
        assert int(got[0]) == zlib.crc32(a + b)
