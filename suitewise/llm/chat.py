"""Operator 5: chat formatting over typed content parts, native expressions only.

A message is an ordered array of parts ``struct<kind, text, ref, n_tokens>``. The
visitor turns each part into its place in the output: text into escaped text, and
image, audio and document parts into one placeholder each, while the attachment
list records kind, reference, turn, part and expanded token count. A turn becomes
``<|im_start|>role NEWLINE body<|im_end|> NEWLINE``.

Escaping is reversible: a backslash becomes ``\\b``, the opening ``<|`` of every
control string ``\\l`` and, in roles, a newline ``\\n``. The opening is looked for in the
joined body, so no text can hold a marker, nor can several parts that follow each other.

Edge cases: null text, role or parts count as empty; an unknown or null kind is
kept as a document part; a null token count is 0; rows with equal turn numbers are
ordered by role and body, null turns come first; a null conv_id is a conversation
of its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART_TYPE = "array<struct<kind:string,text:string,ref:string,n_tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<|"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _visit(part: Column) -> Column:
    """What a part leaves in the flat body before openings are escaped: a placeholder is a code that no text
    can hold, as every backslash of a text is followed by ``b``."""
    seen = F.when(part["kind"] == "text", F.replace(F.coalesce(part["text"], F.lit("")), F.lit("\\"), F.lit("\\b")))
    for kind in ("image", "audio"):
        seen = seen.when(part["kind"] == kind, F.lit(f"\\{kind[0]}"))
    return seen.otherwise(F.lit("\\d"))


def _body(parts: Column) -> Column:
    """The flat body of a message: texts joined and escaped, placeholders in their places."""
    body = F.replace(F.array_join(F.transform(parts, _visit), ""), F.lit("<|"), F.lit("\\l"))
    for kind, shown in PLACEHOLDERS.items():
        body = F.replace(body, F.lit(f"\\{kind[0]}"), F.lit(shown))
    return body


def text_parts(text: Column) -> Column:
    """The parts of a message that is text alone."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("bigint").alias("n_tokens")))


def format_chats(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans, attachments, expanded token count.

    ``messages``: conv_id, turn, role, parts. ``loss`` holds the (start, length) in
    code points of every body of ``learn_role``; placeholders inside it count as text.
    """
    parts = F.coalesce(F.col("parts").cast(PART_TYPE), F.array().cast(PART_TYPE))
    role = F.coalesce("role", F.lit(""))
    turns = messages.select(
        "conv_id", "turn", role.alias("role"),
        _body(parts).alias("body"),
        F.transform(F.filter(F.transform(parts, lambda p, i: F.struct(
            F.when(p["kind"].isin(*PLACEHOLDERS), p["kind"]).otherwise(F.lit("document")).alias("kind"),
            p["ref"].alias("ref"), F.coalesce(p["n_tokens"], F.lit(0)).alias("n_tokens"), i.alias("part"),
            (F.coalesce(p["kind"], F.lit("")) == "text").alias("plain"))),
            lambda a: ~a["plain"]), lambda a: a.dropFields("plain")).alias("seen"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    pieces = turns.select(
        "*", head.alias("head"), F.concat(head, F.col("body"), F.lit(END + "\n")).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = pieces.select(
        "conv_id", F.row_number().over(order).alias("n"), "piece", "seen",
        F.when(F.col("role") == learn_role, F.struct(
            (before + F.length("head")).cast("bigint").alias("start"),
            F.length("body").cast("bigint").alias("len"))).alias("span"))
    rows = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "seen", "span"))).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: F.transform(x["seen"], lambda a: F.struct(
        x["n"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"),
        a["n_tokens"].alias("n_tokens")))))
    return rows.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments")
    ).withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("bigint"), lambda total, a: total + a["n_tokens"]))


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back into its (role, text) turns."""
    segments = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda s: s != "")
    return F.transform(segments, lambda s: F.struct(
        unescape(F.substring_index(F.replace(s, F.lit(START)), "\n", 1)).alias("role"),
        unescape(F.regexp_replace(s, r"\A[^\n]*\n", "")).alias("text")))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, all read back from the formatted text and its loss spans."""
    turns = parse_turns(F.col("formatted"))
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")
    return formatted.select("*", turns.alias("_turns"), learnt.alias("_learnt")).select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda x: F.concat(
            x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_learnt").cast("bigint").alias("loss_chars"), F.sha2("_learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").alias("n_attachments"), "expanded_tokens")
