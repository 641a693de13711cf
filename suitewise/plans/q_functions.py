"""Queries for the column functions (J), each over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitewise.functions import columns as J
from suitewise.plans.registry import register
from suitewise.sources.tables import read_table


def _emails(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return c.select("c_custkey", F.concat(F.lower("c_mktsegment"),
                                          F.when(F.col("c_custkey") % 3 == 0, "").otherwise("@"),
                                          F.lit("example.com")).alias("email"))


_EMAIL_SQL = """(SELECT c_custkey, concat(lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@' END,
  'example.com') AS email FROM customer)"""


@register("fn_email", f"""
SELECT c_custkey, email, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') AS is_email
FROM {_EMAIL_SQL} e""")
def fn_email(spark, sf_dir):
    e = _emails(spark, sf_dir)
    return e.select("c_custkey", "email", J.is_email("email").alias("is_email"))


@register("fn_email_weak", f"""
SELECT c_custkey, email, contains(email, '@') AND contains(split_part(email, '@', 2), '.') AS is_valid
FROM {_EMAIL_SQL} e""")
def fn_email_weak(spark, sf_dir):
    e = _emails(spark, sf_dir)
    return e.select("c_custkey", "email", J.is_email_weak("email").alias("is_valid"))


@register("fn_sanitize", """
SELECT page_id, translate(html, '<>"''%;()&+', '') AS sanitized FROM pages""")
def fn_sanitize(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", J.sanitize("html").alias("sanitized"))


@register("fn_percentage", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax * 100.0 END AS pct FROM lineitem""")
def fn_percentage(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    "l_discount", "l_tax")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     J.percentage("l_discount", "l_tax").alias("pct"))


@register("fn_currency", """
SELECT o_orderkey, code, CASE code WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' ELSE '$' END
  || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS formatted
FROM (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP'
  ELSE 'XYZ' END AS code FROM orders) o""")
def fn_currency(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    code = (F.when(F.col("o_orderkey") % 4 == 0, "USD").when(F.col("o_orderkey") % 4 == 1, "EUR")
            .when(F.col("o_orderkey") % 4 == 2, "GBP").otherwise("XYZ"))
    o = o.select("o_orderkey", "o_totalprice", code.alias("code"))
    return o.select("o_orderkey", "code", J.format_currency("o_totalprice", "code").alias("formatted"))


def _order_lists(spark, sf_dir, value):
    li = read_table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        value.alias("v")))).alias("s"))
    return g.select("l_orderkey", F.transform("s", lambda x: x["v"]).alias("items"))


_ORDERED_LIST_SQL = """(SELECT l_orderkey, list({v} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  l_shipdate) AS items FROM lineitem GROUP BY l_orderkey)"""


@register("fn_chunk", f"""
SELECT l_orderkey, CAST(len(chunks) AS BIGINT) AS n_chunks,
  array_to_string(list_transform(chunks, lambda c: array_to_string(c, ',')), '|') AS chunks_text
FROM (SELECT l_orderkey, list_transform(range(0, CAST(ceil(len(items) / 3) AS BIGINT)),
    lambda i: items[i * 3 + 1 : i * 3 + 3]) AS chunks
  FROM {_ORDERED_LIST_SQL.format(v="l_linenumber")} x) y""")
def fn_chunk(spark, sf_dir):
    lists = _order_lists(spark, sf_dir, F.col("l_linenumber"))
    c = lists.select("l_orderkey", J.chunk("items", 3).alias("chunks"))
    return c.select("l_orderkey", F.size("chunks").cast("bigint").alias("n_chunks"),
                    F.array_join(F.transform("chunks", lambda a: F.array_join(a, ",")), "|").alias("chunks_text"))


@register("fn_flatten", """
SELECT o_orderkey, o_custkey AS "customer.o_custkey", o_orderstatus AS "customer.status.o_orderstatus",
  o_orderpriority AS "customer.status.o_orderpriority", o_totalprice AS price FROM orders""")
def fn_flatten(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    nested = o.select("o_orderkey", F.struct(
        F.struct("o_custkey", F.struct("o_orderstatus", "o_orderpriority").alias("status")).alias("customer"),
        F.col("o_totalprice").alias("price")).alias("rec"))
    return J.flatten_struct(nested, "rec", sep=".")


@register("fn_flatten_json", """
SELECT event_id, key, value FROM (
  SELECT event_id, 'at/user' AS key, CAST(user_id AS VARCHAR) AS value FROM events
  UNION ALL SELECT event_id, 'at/what/kind', '"' || event_type || '"' FROM events
  UNION ALL SELECT event_id, 'at/what/list', '[' || CAST(event_id AS VARCHAR) || ',{"deep":1}]' FROM events
  UNION ALL SELECT event_id, 'props/' || k, json_extract(props, '$."' || k || '"')::VARCHAR
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) p
  UNION ALL SELECT event_id, 'none', 'null' FROM events) x""")
def fn_flatten_json(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    nested = e.select("event_id", F.concat(
        F.lit('{"at":{"user":'), F.col("user_id").cast("string"), F.lit(',"what":{"kind":"'), F.col("event_type"),
        F.lit('","list":['), F.col("event_id").cast("string"), F.lit(',{"deep":1}]}},"empty":{},"none":null,"props":'),
        F.col("props"), F.lit("}")).alias("json"))
    flat = J.flatten_json(nested, "json", "flat", sep="/")
    # explode would infer a filter on the whole list and parse each text again for it; the outer form does not
    leaves = flat.select("event_id", F.explode_outer("flat").alias("f")).where(F.col("f").isNotNull())
    return leaves.select("event_id", "f.key", "f.value")


@register("fn_merge", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  array_to_string(list_transform(list_sort(map_entries(map_concat(
    MAP {'flag': l_returnflag, 'status': l_linestatus},
    MAP {'status': 'X' || l_linestatus, 'line': CAST(l_linenumber AS VARCHAR)}))),
    lambda e: e.key || '=' || e.value), '&') AS merged
FROM lineitem""")
def fn_merge(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    "l_returnflag", "l_linestatus")
    m1 = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    m2 = F.create_map(F.lit("status"), F.concat(F.lit("X"), F.col("l_linestatus")),
                      F.lit("line"), F.col("l_linenumber").cast("string"))
    merged = J.merge_maps(m1, m2)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(merged)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("merged"))


@register("fn_dedupe", f"""
SELECT l_orderkey, array_to_string(list_filter(items, lambda x, i: list_position(items, x) = i), ',') AS deduped
FROM {_ORDERED_LIST_SQL.format(v="l_suppkey % 5")} x""")
def fn_dedupe(spark, sf_dir):
    lists = _order_lists(spark, sf_dir, F.col("l_suppkey") % 5)
    return lists.select("l_orderkey", F.array_join(J.dedupe("items"), ",").alias("deduped"))


@register("fn_palindrome", """
SELECT o_orderkey, regexp_replace(lower(CAST(o_orderkey AS VARCHAR)), '[^a-zA-Z0-9]', '', 'g')
  = reverse(regexp_replace(lower(CAST(o_orderkey AS VARCHAR)), '[^a-zA-Z0-9]', '', 'g')) AS is_palindrome
FROM orders""")
def fn_palindrome(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    return o.select("o_orderkey", J.is_palindrome(F.col("o_orderkey").cast("string")).alias("is_palindrome"))


@register("fn_truncate", """
SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substring(text, 1, 47) || '...' END AS short_text,
  CASE WHEN length(text) <= 2 THEN text ELSE substring(text, 1, greatest(length(text) - 1, 0)) || '...' END AS tiny_text
FROM documents""")
def fn_truncate(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", J.truncate("text", 50).alias("short_text"),
                    J.truncate("text", 2).alias("tiny_text"))


_QS = """(SELECT page_id, CASE WHEN contains(url, '?') THEN substring(url, strpos(url, '?') + 1) ELSE '' END AS q,
  split_part(url, '?', 1) AS base FROM pages)"""

_KV = f"""(SELECT page_id, i, split_part(piece, '=', 1) AS k, substring(piece, strpos(piece, '=') + 1) AS v FROM (
  SELECT page_id, unnest(string_split(q, '&')) AS piece, unnest(range(1, len(string_split(q, '&')) + 1)) AS i
  FROM {_QS} s) p WHERE contains(piece, '='))"""


def _pages_q(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    q = F.when(F.col("url").contains("?"), F.expr("substring(url, instr(url, '?') + 1)")).otherwise(F.lit(""))
    return p.select("page_id", q.alias("q"), F.split_part("url", F.lit("?"), F.lit(1)).alias("base"))


@register("fn_query_parse", f"""
SELECT page_id, k AS key, arg_max(v, i) AS value FROM {_KV} kv GROUP BY page_id, k""")
def fn_query_parse(spark, sf_dir):
    p = _pages_q(spark, sf_dir)
    return p.select("page_id", F.explode(J.parse_query("q")).alias("key", "value"))


@register("fn_query_build", f"""
SELECT s.page_id, rtrim(s.base, '/') || '/' || ltrim('/p' || CAST(s.page_id AS VARCHAR), '/')
  || CASE WHEN b.qs IS NULL THEN '' ELSE '?' || b.qs END AS url
FROM {_QS} s LEFT JOIN (
  SELECT page_id, string_agg(k || '=' || v, '&' ORDER BY first_i) AS qs FROM (
    SELECT page_id, k, min(i) AS first_i, arg_max(v, i) AS v FROM {_KV} kv GROUP BY page_id, k) d
  GROUP BY page_id) b USING (page_id)""")
def fn_query_build(spark, sf_dir):
    p = _pages_q(spark, sf_dir)
    endpoint = F.concat(F.lit("/p"), F.col("page_id").cast("string"))
    return p.select("page_id", J.build_url(F.col("base"), endpoint, J.parse_query("q")).alias("url"))


def _names(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part", "p_partkey", "p_name").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return parts.unionByName(cust)


_NAMES_SQL = """(SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), c_name FROM customer)"""


@register("fn_snake", f"""
SELECT id, lower(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'),
  '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM {_NAMES_SQL} n""")
def fn_snake(spark, sf_dir):
    return _names(spark, sf_dir).select("id", J.to_snake_case("name").alias("snake"))


@register("fn_kebab", f"""
SELECT id, lower(regexp_replace(regexp_replace(name, '(.)([A-Z][a-z]+)', '\\1-\\2', 'g'),
  '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab FROM {_NAMES_SQL} n""")
def fn_kebab(spark, sf_dir):
    return _names(spark, sf_dir).select("id", J.to_kebab_case("name").alias("kebab"))


_TITLE = """array_to_string(list_transform(string_split({x}, ''), lambda ch, i: CASE WHEN i = 1
  OR NOT regexp_matches(string_split({x}, '')[i - 1], '\\p{{L}}') THEN upper(ch) ELSE lower(ch) END), '')"""


@register("fn_camel", f"""
SELECT id, parts[1] || coalesce(array_to_string(list_transform(parts[2:], lambda w: {_TITLE.format(x='w')}), ''), '') AS camel
FROM (SELECT id, string_split(replace(name, ' ', '_'), '_') AS parts FROM {_NAMES_SQL} n) x""")
def fn_camel(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("id", J.to_camel_case(F.replace("name", F.lit(" "), F.lit("_"))).alias("camel"))


@register("fn_pascal", f"""
SELECT id, array_to_string(list_transform(parts, lambda w: {_TITLE.format(x='w')}), '') AS pascal
FROM (SELECT id, string_split(replace(name, ' ', '_'), '_') AS parts FROM {_NAMES_SQL} n) x""")
def fn_pascal(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("id", J.to_pascal_case(F.replace("name", F.lit(" "), F.lit("_"))).alias("pascal"))


@register("fn_sha256", """
SELECT c_custkey, sha256(c_name) AS digest, length(c_name) >= 8 AS valid_password FROM customer""")
def fn_sha256(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return c.select("c_custkey", J.sha256_hex("c_name").alias("digest"),
                    J.valid_password("c_name").alias("valid_password"))


@register("fn_json_record", """
SELECT o_orderkey, to_json({'status_code': 200, 'data': {'url': 'https://api.example.com/orders/'
  || CAST(o_orderkey AS VARCHAR), 'method': 'GET', 'status': o_orderstatus},
  'headers': {'Content-Type': 'application/json'}})::VARCHAR AS body FROM orders""")
def fn_json_record(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    data = F.struct(F.concat(F.lit("https://api.example.com/orders/"), F.col("o_orderkey").cast("string"))
                    .alias("url"), F.lit("GET").alias("method"), F.col("o_orderstatus").alias("status"))
    headers = F.struct(F.lit("application/json").alias("Content-Type"))
    return o.select("o_orderkey", J.response_json(F.lit(200), data, headers).alias("body"))
