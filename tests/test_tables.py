"""Keyed-table operations: the reference's database and registration cases."""

import tempfile

from pyspark.sql import functions as F

from suitewise.operators import tables as K

SCHEMA = "id bigint, name string, age bigint, seq bigint"


def base(spark):
    return spark.createDataFrame([(1, "Alice", 30, 0), (2, "Bob", 25, 0), (3, "Carol", 35, 0)], SCHEMA)


def test_insert_auto_id_and_lookup_last_wins(spark):
    new = spark.createDataFrame([(None, "Dan", 40, 1), (2, "Bob2", 26, 2), (None, "Eve", 22, 3)],
                                "id bigint, name string, age bigint, pos bigint")
    t = K.insert_rows(base(spark), new, [F.col("pos")])
    rows = {(r["name"]): r["id"] for r in t.collect()}
    assert rows["Dan"] == 4 and rows["Eve"] == 6          # size + position, every insert counts
    ids = spark.createDataFrame([(2,), (4,), (99,)], "id bigint")
    found = {r["id"]: r["name"] for r in K.find_by_id(t, ids).collect()}
    assert found == {2: "Bob2", 4: "Dan"}                  # last inserted wins, unknown id absent


def test_update_delete_filter_count(spark):
    t = base(spark)
    feed = spark.createDataFrame([(1, 31, None, 1), (1, 32, None, 2), (9, 50, None, 3), (2, None, "Bobby", 4)],
                                 "id bigint, age bigint, name string, pos bigint")
    u = {r["id"]: (r["name"], r["age"]) for r in K.update_fields(t, feed, ["age", "name"], ["pos"]).collect()}
    assert u == {1: ("Alice", 32), 2: ("Bobby", 25), 3: ("Carol", 35)}   # id 9 refused
    d = K.delete_ids(t, spark.createDataFrame([(2,)], "id bigint"))
    assert sorted(r["id"] for r in d.collect()) == [1, 3]
    assert K.query(t, F.col("age") > 28).count() == 2
    assert K.count_rows(t).collect()[0][0] == 3


def test_update_and_delete_reach_the_last_inserted_of_equal_ids(spark):
    rows = [(1, "a", 1, 1), (2, "b", 2, 2), (1, "c", 3, 3), (1, "d", 4, 4), (3, "e", 5, 5), (None, "f", 6, 6)]
    t = spark.createDataFrame(rows, SCHEMA)
    feed = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 3), (9, 90, 4)], "id bigint, age bigint, pos bigint")
    got = {r["name"]: r["age"] for r in K.update_last(t, feed, ["age"], ["pos"]).collect()}
    assert got == {"a": 1, "b": 20, "c": 3, "d": 11, "e": 5, "f": 6}
    requests = spark.createDataFrame([(1,), (1,), (2,), (2,), (9,)], "id bigint")
    assert sorted(r["name"] for r in K.delete_last(t, requests).collect()) == ["a", "e", "f"]


def test_inserting_twice_goes_on_counting(spark):
    new = spark.createDataFrame([(None, "Dan", 40, 1), (2, "Bob2", 26, 2)], "id bigint, name string, age bigint, pos bigint")
    t = K.insert_rows(K.insert_rows(base(spark), new, [F.col("pos")]), new, [F.col("pos")])
    assert sorted((r["seq"], r["id"]) for r in t.collect() if r["seq"]) == [(1, 4), (2, 2), (3, 6), (4, 2)]


def test_create_count_and_json_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="suitewise-test-", dir="/tmp")
    path = f"{folder}/users"
    assert K.create_table(base(spark), path) is True
    assert K.create_table(base(spark), path) is False          # exists
    assert K.table_count(spark, path) == 3
    assert K.table_count(spark, f"{folder}/missing") == 0
    js = K.to_json_rows(base(spark), ["id", "name"]).collect()[0][0]
    assert js == '{"id":1,"name":"Alice"}'
    docs = spark.createDataFrame([('[{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]',), ('{"id": 3}',),
                                  ("not json",)], "json string")
    ok, bad = K.import_json_arrays(docs, "struct<id:bigint,name:string>")
    assert sorted(r["id"] for r in ok.collect()) == [1, 2] and bad.count() == 2


def test_register(spark):
    existing = spark.createDataFrame([("alice",)], "username string")
    attempts = spark.createDataFrame([
        ("alice", "a@x.com", "password1", 1),      # exists
        ("bob", "bob-at-x", "password1", 2),       # bad email
        ("bob", "b@x.com", "short", 3),            # short password
        ("bob", "b@x.com", "password2", 4),        # first valid
        ("bob", "b2@x.com", "password3", 5),       # duplicate username
    ], "username string, email string, password string, pos bigint")
    r = K.register_users(existing, attempts, ["pos"]).collect()
    assert [(x["username"], x["email"], x["pos"]) for x in r] == [("bob", "b@x.com", 4)]
