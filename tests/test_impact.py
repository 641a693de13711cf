"""Change impact and the exploded theta joins."""

import random

from pyspark.sql import functions as F

from suitewise.operators import impact as D
from suitewise.operators.joins import contains_pairs, contains_semi_join, endswith_semi_join


def test_path_to_module(spark):
    df = spark.createDataFrame([("src/m1.py",), ("./pkg\\sub/mod.py",), ("a.pyx/b.py",)], "p string")
    got = [r[0] for r in df.select(D.path_to_module(F.col("p"))).collect()]
    assert got == ["src.m1", "pkg.sub.mod", "ax.b"]   # T12: every '.py' is removed


def test_mapping_replaces_every_test_prefix(spark):
    tests = spark.createDataFrame([("t/test_a.py",), ("t/test_test_b.py",), ("t/helper.py",), ("t/test_c.py",)],
                                  "test_file string")
    src = spark.createDataFrame([("t/a.py",), ("t/b.py",)], "source_file string")
    got = sorted(tuple(r) for r in D.test_source_map(tests, src).collect())
    assert got == [("t/test_a.py", "t/a.py"), ("t/test_test_b.py", "t/b.py")]


def test_impact_direct_wins_and_substring_import_match(spark):
    # Module src.m1 is contained in src.m10.x, so that import counts too
    mapping = spark.createDataFrame([("tests/test_m1.py", "src/m1.py"), ("tests/test_m2.py", "src/m2.py"),
                                     ("tests/test_m3.py", "src/m3.py")], "test_file string, source_file string")
    imports = spark.createDataFrame([("tests/test_m1.py", "src.m1.x"), ("tests/test_m2.py", "src.m10.y"),
                                     ("tests/test_m3.py", "src.m2.z"), ("tests/test_m9.py", "src.m1.q")],
                                    "test_file string, import_name string")
    changed = spark.createDataFrame([("src/m1.py",)], "file_path string")
    got = {r[0]: r[1] for r in D.impact_scores(mapping, imports, changed).collect()}
    assert got == {"tests/test_m1.py": 1.0, "tests/test_m2.py": 0.5}   # m9 has no mapping: no impact


def test_contains_join_equals_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "ab."
    left = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    right = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 4))) for _ in range(6)]
    L = spark.createDataFrame([(s,) for s in left], "v string")
    R = spark.createDataFrame([(s,) for s in right], "m string")
    got = sorted(r[0] for r in contains_semi_join(L, "v", R, "m").collect())
    assert got == sorted(s for s in left if any(m in s for m in right))
    pairs = sorted(tuple(r) for r in contains_pairs(L, "v", R, "m").collect())
    assert pairs == sorted({(s, m) for s in left for m in right if m in s})
    ends = sorted(r[0] for r in endswith_semi_join(L, "v", R, "m").collect())
    assert ends == sorted(s for s in left if any(s.endswith(m) for m in right))


def test_theta_join_has_no_nested_loop(spark):
    L = spark.createDataFrame([("abc",)], "v string")
    R = spark.createDataFrame([("b",)], "m string")
    plan = contains_semi_join(L, "v", R, "m")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_file_priority_is_capped(spark, make_history):
    h = make_history({"tests/test_a.py::x": [False] * 12})
    scores = spark.createDataFrame([("tests/test_a.py", 1.0)], "test_file string, impact double")
    r = D.file_priority(h, scores).collect()[0]
    assert r["priority"] == 1.0 and r["recent_failures"] == 10


def test_exact_import_match_stops_at_module_boundary(spark):
    mapping = spark.createDataFrame([("t1", "s"), ("t2", "s"), ("t3", "s"), ("t4", "s")], "test_file string, source_file string")
    imports = spark.createDataFrame(
        [("t1", "src.m1"), ("t2", "src.m10.e1"), ("t3", "src.m1.e1"), ("t4", None), ("t5", "src.m1")],
        "test_file string, import_name string")
    changed = spark.createDataFrame([("src/m1.py",), (None,)], "file_path string")
    loose = D.import_impact(mapping, imports, changed)
    exact = D.import_impact(mapping, imports, changed, exact=True)
    assert {r["test_file"] for r in loose.collect()} == {"t1", "t2", "t3"}
    assert {r["test_file"] for r in exact.collect()} == {"t1", "t3"}


def test_changed_file_list_keeps_files_without_a_diff(spark):
    changed = spark.createDataFrame([("a.py",), ("a.py",), ("b.py",)], "file_path string")
    stats = spark.createDataFrame([("a.py", 3, 1)], "file_path string, lines_added bigint, lines_removed bigint")
    rows = {tuple(r) for r in D.changed_file_list(changed, stats).collect()}
    assert rows == {("a.py", 3, 1), ("b.py", 0, 0)}


def test_contains_index_against_brute_force(spark):
    import random

    from suitewise.operators import joins
    rnd = random.Random(2)
    names = ["".join(rnd.choice("abé.") for _ in range(rnd.randint(0, 14))) for _ in range(120)] + [None, "x" * 300]
    pats = ["".join(rnd.choice("abé.") for _ in range(rnd.randint(1, 6))) for _ in range(40)] + ["zzz", None, "x" * 301]
    left = spark.createDataFrame([(n,) for n in names], "v string")
    for some in (pats, [*pats, ""]):
        right = spark.createDataFrame([(p,) for p in some], "p string")
        pairs = {(n, p) for n in names if n is not None for p in some if p is not None and p in n}
        assert {(r["_v"], r["_piece"]) for r in joins.contains_pairs(left, "v", right, "p").collect()} == pairs
        assert {r["v"] for r in joins.contains_semi_join(left, "v", right, "p").collect()} == {n for n, _ in pairs}
        ends = {n for n in names if n is not None and any(n.endswith(p) for p in some if p is not None)}
        assert {r["v"] for r in joins.endswith_semi_join(left, "v", right, "p").collect()} == ends
