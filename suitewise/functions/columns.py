"""Scalar column functions (family J).

Every function maps Columns to a Column built from native expressions, so it
stays inside whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Patterns and symbol table (fixed values)
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SANITIZE_CHARS = "<>\"'%;()&+"
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}
DEFAULT_SYMBOL = "$"
MIN_PASSWORD = 8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_email(x) -> Column:
    """Anchored pattern, top-level domain of two or more letters."""
    return _c(x).rlike(EMAIL_PATTERN)


def is_email_weak(x) -> Column:
    """Has ``@`` and a ``.`` in the piece after the first ``@``."""
    c = _c(x)
    return c.contains("@") & F.split_part(c, F.lit("@"), F.lit(2)).contains(".")


def sanitize(x) -> Column:
    """Drop each of < > \" ' % ; ( ) & +."""
    return F.translate(_c(x), SANITIZE_CHARS, "")


def percentage(part, total) -> Column:
    """Part / total * 100, 0 when total is 0."""
    p, t = _c(part).cast("double"), _c(total).cast("double")
    return F.when(t == 0, F.lit(0.0)).otherwise(p / t * F.lit(100.0))


def format_currency(amount, code) -> Column:
    """Symbol (USD $, EUR €, GBP £, else $) and two decimals, no grouping."""
    c = _c(code)
    sym = F.lit(DEFAULT_SYMBOL)
    for k in reversed(list(CURRENCY_SYMBOLS)):
        sym = F.when(c == k, CURRENCY_SYMBOLS[k]).otherwise(sym)
    return F.concat(sym, _c(amount).cast("decimal(18,2)").cast("string"))


def chunk(arr, size: int) -> Column:
    """Consecutive pieces of ``size`` elements; [] for an empty array."""
    a = _c(arr)
    n = F.ceil(F.size(a) / F.lit(size)).cast("int")
    idx = F.sequence(F.lit(0), n - 1)
    return F.when(F.size(a) == 0, F.array_repeat(a, 0)).otherwise(
        F.transform(idx, lambda i: F.slice(a, i * size + 1, F.lit(size))))


def flatten_struct(df: DataFrame, col: str, sep: str = ".") -> DataFrame:
    """Replace a struct column by one column per leaf, named by the joined path."""
    leaves: list[Column] = []

    def walk(dtype: StructType, ref: Column, name: str) -> None:
        for f in dtype.fields:
            n = f"{name}{sep}{f.name}" if name else f.name
            child = ref.getField(f.name)
            if isinstance(f.dataType, StructType):
                walk(f.dataType, child, n)
            else:
                leaves.append(child.alias(n))

    walk(df.schema[col].dataType, F.col(col), "")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != col], *leaves)


def flatten_json(df: DataFrame, col: str, out: str = "flat", sep: str = ".") -> DataFrame:
    """J7 on JSON records of unknown keys: ``out``, the leaves as array<struct<key, value>>.

    Keys are the joined paths in key order, values JSON text; arrays and nulls are leaves, an empty object has none.
    Text that is no JSON object gives NULL. Objects are opened a level at a time through VARIANT; one look for an
    object that is left (not at the rows) ends it, so no depth is assumed. When two paths join to one key, as
    ``{"a": {"b": 1}, "a.b": 2}``, the later in key order stays.
    """
    entries = f"map_entries(try_cast(try_parse_json(`{col}`) AS map<string, variant>))"
    spread = df.withColumn(out, F.expr(entries))
    inner = (f"transform(map_entries(cast(e.value AS map<string, variant>)), "
             f"x -> struct(concat(e.key, {_quoted(sep)}, x.key) AS key, x.value AS value))")
    is_object = "schema_of_variant(e.value) LIKE 'OBJECT<%'"
    while not spread.where(F.expr(f"exists(`{out}`, e -> {is_object})")).isEmpty():
        spread = spread.withColumn(out, F.expr(
            f"flatten(transform(`{out}`, e -> CASE WHEN {is_object} THEN {inner} ELSE array(struct(e.key AS key, e.value AS value)) END))"))
    # the entries are bound to one name: were their column named in a lambda, the optimizer could put all the parsing there
    last = (f"transform(array(`{out}`), o -> filter(o, (e, i) -> NOT exists("
            f"slice(o, i + 2, greatest(size(o) - i - 1, 0)), f -> f.key = e.key)))[0]")
    return spread.withColumn(out, F.expr(f"transform({last}, e -> struct(e.key AS key, to_json(e.value) AS value))"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def merge_maps(*maps) -> Column:
    """Later maps win on equal keys (no reliance on the dedup policy)."""
    cols = [_c(m) for m in maps]
    acc = cols[0]
    for m in cols[1:]:
        keys = F.map_keys(m)
        acc = F.map_concat(F.map_filter(acc, lambda k, v: ~F.array_contains(keys, k)), m)
    return acc


def dedupe(arr) -> Column:
    """Distinct elements, first occurrence order kept."""
    return F.array_distinct(_c(arr))


def is_palindrome(x) -> Column:
    """Ignoring case and anything but ASCII letters and digits."""
    cleaned = F.regexp_replace(F.lower(_c(x)), "[^a-zA-Z0-9]", "")
    return cleaned == F.reverse(cleaned)


def truncate(x, max_length: int, suffix: str = "...") -> Column:
    """Text if it fits, else a prefix plus ``suffix``.

    The prefix length is ``max_length - len(suffix)``; when that is negative
    it counts from the end, like a Python slice (T-note in the tests).
    """
    c = _c(x)
    k = max_length - len(suffix)
    if k >= 0:
        head = F.substring(c, 1, k)
    else:
        head = F.substring(c, F.lit(1), F.greatest(F.length(c) + F.lit(k), F.lit(0)))
    return F.when(F.length(c) <= max_length, c).otherwise(F.concat(head, F.lit(suffix)))


def query_entries(q) -> Column:
    """Pieces of ``k=v&...`` with an ``=``: array<struct<k, v>> in input order."""
    pieces = F.split(_c(q), "&")
    kv = F.transform(pieces, lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("k"),
        F.substring(p, F.instr(p, "=") + 1, F.greatest(F.length(p), F.lit(1))).alias("v"),
        (F.instr(p, "=") > 0).alias("ok")))
    return F.transform(F.filter(kv, lambda e: e["ok"]), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_query(q) -> Column:
    """Map of a query string; first position of a key, last value wins.

    Pieces are sorted by (key, position), so the work grows as n log n in the number of parameters.
    """
    order = F.array_sort(F.transform(query_entries(q), lambda x, i: F.struct(
        x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))
    ends = _bound(order, lambda t: F.struct(
        F.filter(t, lambda x, i: (i == 0) | (F.get(t, i - 1)["k"] != x["k"])).alias("first"),
        F.filter(t, lambda x, i: (i == F.size(t) - 1) | (F.get(t, i + 1)["k"] != x["k"])).alias("last")))
    entries = _bound(ends, lambda e: F.array_sort(F.transform(e["first"], lambda x, n: F.struct(
        x["i"].alias("i"), x["k"].alias("key"), F.get(e["last"], n)["v"].alias("value")))))
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))


def build_query(m) -> Column:
    """``k=v`` pairs joined by ``&`` in map order; '' for an empty map."""
    return F.array_join(F.transform(F.map_entries(_c(m)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")


def build_url(base, endpoint, params) -> Column:
    """Base without trailing '/', '/', endpoint without leading '/', '?' + query if any."""
    url = F.concat(F.rtrim(_c(base), F.lit("/")), F.lit("/"), F.ltrim(_c(endpoint), F.lit("/")))
    q = build_query(params)
    return F.when(F.size(_c(params)) > 0, F.concat(url, F.lit("?"), q)).otherwise(url)


def _case_split(x: Column, sep: str) -> Column:
    s1 = F.regexp_replace(x, r"(.)([A-Z][a-z]+)", f"$1{sep}$2")
    return F.lower(F.regexp_replace(s1, r"([a-z0-9])([A-Z])", f"$1{sep}$2"))


def to_snake_case(x) -> Column:
    """J14."""
    return _case_split(_c(x), "_")


def to_kebab_case(x) -> Column:
    """J17."""
    return _case_split(_c(x), "-")


def title_case(x) -> Column:
    """Python ``str.title``: a letter is upper-cased after a non-letter, else lower-cased."""
    chars = F.split(_c(x), "")
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(ch)).otherwise(F.lower(ch))), "")


def to_camel_case(x) -> Column:
    """First ``_`` piece as is, the rest title-cased, joined."""
    parts = F.split(_c(x), "_")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(rest, title_case), ""))


def to_pascal_case(x) -> Column:
    """Every ``_`` piece title-cased, joined."""
    return F.array_join(F.transform(F.split(_c(x), "_"), title_case), "")


def sha256_hex(x) -> Column:
    """SHA-256 hex digest of the UTF-8 text."""
    return F.sha2(_c(x), 256)


def valid_password(x) -> Column:
    """Minimum length rule."""
    return F.length(_c(x)) >= MIN_PASSWORD


def response_json(status, data, headers) -> Column:
    """{status_code, data, headers} as one JSON text."""
    return F.to_json(F.struct(_c(status).alias("status_code"), _c(data).alias("data"),
                              _c(headers).alias("headers")))
