"""Queries for keyed-table operations (K): customer as the table, events as the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitewise.operators import tables as K
from suitewise.plans.registry import register
from suitewise.sources.tables import read_table

_BASE_SQL = """(SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer)"""

_INSERTED_SQL = """(SELECT id, name, balance, segment, CAST(0 AS BIGINT) AS seq FROM (SELECT c_custkey AS id,
    c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer) b
  UNION ALL
  SELECT coalesce(CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END, (SELECT count(*) FROM customer) + seq),
    'user' || CAST(user_id AS VARCHAR), value, 'NEW', seq
  FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events WHERE event_type = 'signup') s)"""


def _base(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


def _inserted(spark, sf_dir):
    new = _events(spark, sf_dir).where(F.col("event_type") == "signup").select(
        F.when(F.col("event_id") % 2 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"),
        F.col("value").alias("balance"), F.lit("NEW").alias("segment"), "ts", "event_id")
    return K.insert_rows(_base(spark, sf_dir), new, [F.col("ts"), F.col("event_id")])


@register("tbl_insert", f"SELECT * FROM {_INSERTED_SQL} t")
def tbl_insert(spark, sf_dir):
    return _inserted(spark, sf_dir)


@register("tbl_lookup", f"""
SELECT id, name, balance, segment FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM {_INSERTED_SQL} t
  WHERE id IN (SELECT user_id FROM events WHERE event_type = 'view')) x WHERE rn = 1""")
def tbl_lookup(spark, sf_dir):
    ids = _events(spark, sf_dir).where(F.col("event_type") == "view").select("user_id")
    return K.find_by_id(_inserted(spark, sf_dir), ids)


@register("tbl_scan", f"SELECT * FROM {_BASE_SQL} b")
def tbl_scan(spark, sf_dir):
    return _base(spark, sf_dir)


@register("tbl_update", f"""
SELECT b.id, b.name, coalesce(p.v, b.balance) AS balance, coalesce(c.v, b.segment) AS segment
FROM {_BASE_SQL} b
LEFT JOIN (SELECT user_id AS id, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'purchase') x WHERE rn = 1) p USING (id)
LEFT JOIN (SELECT user_id AS id, 'SEG' || CAST(event_id % 5 AS VARCHAR) AS v FROM (SELECT *, row_number()
    OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'click') x
  WHERE rn = 1) c USING (id)""")
def tbl_update(spark, sf_dir):
    e = _events(spark, sf_dir)
    feed = e.where(F.col("event_type").isin("purchase", "click")).select(
        F.col("user_id").alias("id"), "ts", "event_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("balance"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("SEG"), (F.col("event_id") % 5).cast("string")))
        .alias("segment"))
    return K.update_fields(_base(spark, sf_dir), feed, ["balance", "segment"], ["ts", "event_id"])


_LAST_SQL = f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS back FROM {_INSERTED_SQL} t)"


@register("tbl_update_last", f"""
SELECT l.id, l.name, coalesce(CASE WHEN back = 1 THEN p.v END, l.balance) AS balance, l.segment, l.seq
FROM {_LAST_SQL} l
LEFT JOIN (SELECT user_id AS id, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'purchase') x WHERE rn = 1) p USING (id)""")
def tbl_update_last(spark, sf_dir):
    feed = _events(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("id"), "ts", "event_id", F.col("value").alias("balance"))
    return K.update_last(_inserted(spark, sf_dir), feed, ["balance"], ["ts", "event_id"])


@register("tbl_delete_last", f"""
SELECT l.id, l.name, l.balance, l.segment, l.seq
FROM {_LAST_SQL} l LEFT JOIN (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'error'
  AND event_id % 3 = 0 GROUP BY user_id) d USING (id)
WHERE back > coalesce(n, 0)""")
def tbl_delete_last(spark, sf_dir):
    requests = _events(spark, sf_dir).where((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).select("user_id")
    return K.delete_last(_inserted(spark, sf_dir), requests)


@register("tbl_delete", f"""
SELECT * FROM {_BASE_SQL} b WHERE id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def tbl_delete(spark, sf_dir):
    ids = _events(spark, sf_dir).where(F.col("event_type") == "error").select("user_id")
    return K.delete_ids(_base(spark, sf_dir), ids)


@register("tbl_filter", f"SELECT * FROM {_BASE_SQL} b WHERE balance > 5000")
def tbl_filter(spark, sf_dir):
    return K.query(_base(spark, sf_dir), F.col("balance") > 5000)


@register("tbl_count", f"SELECT count(*) AS n_rows FROM {_BASE_SQL} b")
def tbl_count(spark, sf_dir):
    return K.count_rows(_base(spark, sf_dir))


@register("tbl_to_json", f"""
SELECT to_json({{'id': id, 'name': name, 'balance': balance, 'segment': segment}})::VARCHAR AS json FROM {_BASE_SQL} b""")
def tbl_to_json(spark, sf_dir):
    return K.to_json_rows(_base(spark, sf_dir), ["id", "name", "balance", "segment"])


def _json_docs(spark, sf_dir):
    return _base(spark, sf_dir).select(F.when(F.col("id") % 50 == 0, F.to_json(F.struct("id", "name")))
                                       .otherwise(F.to_json(F.array(F.struct("id", "name")))).alias("json"))


@register("tbl_from_json", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 50 <> 0")
def tbl_from_json(spark, sf_dir):
    return K.import_json_arrays(_json_docs(spark, sf_dir), "struct<id:bigint,name:string>")[0]


@register("tbl_from_json_refused", """
SELECT '{"id":' || CAST(c_custkey AS VARCHAR) || ',"name":"' || c_name || '"}' AS json
FROM customer WHERE c_custkey % 50 = 0""")
def tbl_from_json_refused(spark, sf_dir):
    return K.import_json_arrays(_json_docs(spark, sf_dir), "struct<id:bigint,name:string>")[1]


@register("tbl_register", """
SELECT username, email, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY ts, event_id) AS rn FROM (
    SELECT CASE WHEN user_id % 4 = 0 THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
      ELSE 'user' || CAST(user_id AS VARCHAR) END AS username,
      CASE WHEN event_id % 4 = 0 THEN 'u' || CAST(user_id AS VARCHAR)
        ELSE 'u' || CAST(user_id AS VARCHAR) || '@example.com' END AS email,
      substring(props, 1, CAST(event_id % 12 AS INTEGER)) AS password, ts, event_id
    FROM events WHERE event_type = 'signup') a
  WHERE contains(email, '@') AND contains(split_part(email, '@', 2), '.') AND length(password) >= 8) v
WHERE rn = 1 AND username NOT IN (SELECT c_name FROM customer)""")
def tbl_register(spark, sf_dir):
    e = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    uid = F.col("user_id").cast("string")
    attempts = e.select(
        F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("Customer#"), F.lpad(uid, 9, "0")))
        .otherwise(F.concat(F.lit("user"), uid)).alias("username"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("u"), uid))
        .otherwise(F.concat(F.lit("u"), uid, F.lit("@example.com"))).alias("email"),
        F.expr("substring(props, 1, CAST(event_id % 12 AS INT))").alias("password"), "ts", "event_id")
    existing = read_table(spark, sf_dir, "customer", "c_name")
    r = K.register_users(existing, attempts, ["ts", "event_id"])
    return r.select("username", "email", "event_id")
