"""Column functions: the literal cases of the reference's own tests."""

from pyspark.sql import functions as F

from suitewise.functions import columns as J


def one(spark, expr, *values, schema="x string"):
    df = spark.createDataFrame([values], schema)
    return df.select(expr.alias("r")).collect()[0]["r"]


def test_email(spark):
    df = spark.createDataFrame([("test@example.com",), ("testexample.com",), ("test@",), ("test@example",)], "x string")
    assert [r[0] for r in df.select(J.is_email("x")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(J.is_email_weak("x")).collect()] == [True, False, False, False]


def test_sanitize(spark):
    assert one(spark, J.sanitize("x"), "Hello World") == "Hello World"
    assert one(spark, J.sanitize("x"), "<b>it's;(x)&y+z%\"</b>") == "bitsxyz/b"


def test_percentage(spark):
    s = "p double, t double"
    assert one(spark, J.percentage("p", "t"), 25.0, 100.0, schema=s) == 25.0
    assert one(spark, J.percentage("p", "t"), 25.0, 0.0, schema=s) == 0.0
    assert abs(one(spark, J.percentage("p", "t"), 33.33, 100.0, schema=s) - 33.33) < 1e-9


def test_currency(spark):
    s = "a double, c string"
    got = [one(spark, J.format_currency("a", "c"), 100.5, c, schema=s) for c in ("USD", "EUR", "GBP", "XYZ")]
    assert got == ["$100.50", "€100.50", "£100.50", "$100.50"]


def test_chunk(spark):
    s = "a array<int>"
    assert one(spark, J.chunk("a", 2), [1, 2, 3, 4, 5, 6], schema=s) == [[1, 2], [3, 4], [5, 6]]
    assert one(spark, J.chunk("a", 2), [1, 2, 3, 4, 5], schema=s)[-1] == [5]
    assert one(spark, J.chunk("a", 2), [], schema=s) == []


def test_flatten(spark):
    df = spark.sql("SELECT named_struct('a', named_struct('b', named_struct('c', 1))) AS rec")
    assert J.flatten_struct(df, "rec").columns == ["a.b.c"]
    assert J.flatten_struct(df, "rec", sep="_").collect()[0]["a_b_c"] == 1


def test_merge_later_wins(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m1, map('b', 3, 'c', 4) AS m2, map('c', 5) AS m3")
    assert df.select(J.merge_maps("m1", "m2", "m3")).collect()[0][0] == {"a": 1, "b": 3, "c": 5}


def test_dedupe_keeps_first_order(spark):
    assert one(spark, J.dedupe("a"), [3, 1, 2, 1, 3], schema="a array<int>") == [3, 1, 2]


def test_palindrome(spark):
    df = spark.createDataFrame([("A man a plan a canal Panama",), ("RaceCar",), ("hello",)], "x string")
    assert [r[0] for r in df.select(J.is_palindrome("x")).collect()] == [True, True, False]


def test_truncate(spark):
    assert one(spark, J.truncate("x", 8), "Hello World") == "Hello..."
    assert one(spark, J.truncate("x", 8, "…"), "Hello World") == "Hello W…"
    assert one(spark, J.truncate("x", 20), "Hello World") == "Hello World"
    # suffix longer than the limit: the prefix length is negative, sliced from the end like Python
    assert one(spark, J.truncate("x", 2), "Hello World") == "Hello World"[:2 - 3] + "..."


def test_query_string_round_trip(spark):
    m = one(spark, J.parse_query("x"), "key1=value1&key2=value2")
    assert m == {"key1": "value1", "key2": "value2"}
    assert one(spark, J.parse_query("x"), "") == {}
    # no '=' dropped, first '=' splits, last value wins but the key keeps its first position
    m = one(spark, J.parse_query("x"), "a=1&flag&b=x=y&a=3")
    assert m == {"a": "3", "b": "x=y"} and list(m) == ["a", "b"]
    df = spark.sql("SELECT map('key1', 'value1', 'key2', 'value2') AS m")
    assert df.select(J.build_query("m")).collect()[0][0] == "key1=value1&key2=value2"
    url = spark.sql("SELECT 'http://h/api/' AS b, '/users' AS e, map('id', '7') AS p, map() AS n").select(
        J.build_url(F.col("b"), F.col("e"), F.col("p")), J.build_url(F.col("b"), F.col("e"), F.col("n").cast("map<string,string>"))
    ).collect()[0]
    assert tuple(url) == ("http://h/api/users?id=7", "http://h/api/users")


def test_case_conversion(spark):
    df = spark.createDataFrame([("CamelCase",), ("camelCase",)], "x string")
    assert [r[0] for r in df.select(J.to_snake_case("x")).collect()] == ["camel_case", "camel_case"]
    assert [r[0] for r in df.select(J.to_kebab_case("x")).collect()] == ["camel-case", "camel-case"]
    assert one(spark, J.to_camel_case("x"), "snake_case") == "snakeCase"
    assert one(spark, J.to_pascal_case("x"), "snake_case") == "SnakeCase"
    # Python's title() capitalises after digits too
    assert one(spark, J.to_pascal_case("x"), "ab1cd_e-f") == "Ab1CdE-F"


def test_sha256_and_password(spark):
    import hashlib
    assert one(spark, J.sha256_hex("x"), "secret") == hashlib.sha256(b"secret").hexdigest()
    assert one(spark, J.valid_password("x"), "1234567") is False
    assert one(spark, J.valid_password("x"), "12345678") is True


def test_response_json(spark):
    df = spark.sql("SELECT 200 AS s, named_struct('id', 1) AS d, map('k', 'v') AS h")
    assert df.select(J.response_json("s", "d", "h")).collect()[0][0] == \
        '{"status_code":200,"data":{"id":1},"headers":{"k":"v"}}'


def test_flatten_json_of_unknown_keys(spark):
    rows = [(1, '{"a": {"b": {"c": 1}, "e": {}}, "d": [{"x": 1}], "n": null}'), (2, "[1]"), (3, "bad"), (4, None), (5, "{}"),
            (6, '{"a": {"b": 1}, "a::b": 2, "z \'q": "s"}')]
    got = {r["id"]: r["flat"] and [tuple(x) for x in r["flat"]]
           for r in J.flatten_json(spark.createDataFrame(rows, "id int, j string"), "j", sep="::").collect()}
    assert got == {1: [("a::b::c", "1"), ("d", '[{"x":1}]'), ("n", "null")], 2: None, 3: None, 4: None, 5: [],
                   6: [("a::b", "2"), ("z 'q", '"s"')]}


def test_flatten_json_names_its_list_once(spark):
    """Filters on the list inline its expression: were it named in a lambda, each leaf would parse the text again."""
    rows = spark.createDataFrame([(1, '{"a": {"b": 1}, "c": 2}')], "id int, j string")
    flat = J.flatten_json(rows, "j").where("size(flat) > 0")
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 2 and [tuple(x) for x in flat.first()["flat"]] == [("a.b", "1"), ("c", "2")]
