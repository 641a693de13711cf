"""Corpus pipeline: from raw documents to token ids, each stage written and read again.

1. language: documents whose language cannot be told (no letter, no text) go;
2. near duplicates: the document of smallest id of each group stays;
3. repeats: byte strings of 100 that start earlier in the corpus are cut out, broken characters at a cut are
   dropped, ``n_chars`` follows the text, and documents left empty go;
4. mixing: rates over soft memberships for targets without the toxic documents' share; a document stays when its
   rate rounds to one or more, and its rate falls with its toxic membership;
5. encoding: token ids of every text, and whether they decode to it.

Edge cases are those of the operators; rows that repeat an id are decided alike. An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitewise.llm import bpe, langid, mixing, near_dedup, suffix_dedup
from suitewise.llm.common import shared_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids``, null ids included."""
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.learn_documents(docs))
    return found.where(F.col("lang_pred") != "und").select(*docs.columns)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, near_dedup.near_groups(docs).where("kept"))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))

    def whole(batches):
        import pyarrow as pa
        for batch in batches:
            at = batch.schema.get_field_index("kept")
            texts = [x.decode("utf-8", "ignore") for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, "kept", pa.array(texts, pa.string()))

    left = suffix_dedup.remove_repeats(docs, keep=others).select("doc_id", *others, "kept")
    fields = ", ".join(f"`{f.name}` {'string' if f.name == 'kept' else f.dataType.simpleString()}"
                       for f in left.schema.fields)
    texts = left.mapInArrow(whole, fields).where(F.col("kept") != "")
    return texts.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("bigint")).select(
        *docs.columns)


def clean_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix_balanced(docs, table(spark, sf_dir, "labels"), drop="toxic")
    return _only(docs, mixed.where(F.col("rate") >= 0.5))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                          (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("intact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", no_near_duplicates),
    ("repeats", no_repeats),
    ("mixing", clean_mix),
    ("encoding", token_ids),
]

ORACLE_SQL = None  # language identification and the classifier have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
