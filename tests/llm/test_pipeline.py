"""The corpus pipeline, stage by stage on a small table, against brute force."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from suitewise.llm import bpe, mixing

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12 %%", "en", "s", 5), (10_002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    first = docs.where("doc_id < 10000").orderBy("doc_id").first()
    docs = docs.unionByName(spark.createDataFrame([(10_003, *first[1:])], docs.schema)).cache()
    language = corpus_pipeline.known_language(spark, docs, SF).cache()
    assert {r[0] for r in docs.select("doc_id").exceptAll(language.select("doc_id")).collect()} == {10_001, 10_002}
    near = corpus_pipeline.no_near_duplicates(spark, language, SF).cache()
    assert near.columns == docs.columns and near.where("doc_id = 10003").count() == 0
    repeats = corpus_pipeline.no_repeats(spark, near, SF).cache()
    assert repeats.columns == docs.columns
    assert repeats.where(F.length("text") != F.col("n_chars")).count() == 0
    seen = set()
    for r in repeats.orderBy("doc_id").collect():
        assert r["text"]
    for r in near.orderBy("doc_id").collect():
        raw = r["text"].encode()
        seen.update(raw[i:i + 100] for i in range(len(raw) - 99))
    assert repeats.count() <= near.count() and seen
    mixed = corpus_pipeline.clean_mix(spark, repeats, SF)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.token_ids(spark, repeats, SF)
    usual = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    texts = {r["doc_id"]: r["text"] for r in repeats.collect()}
    for r in out.collect():
        assert r["intact"] and r["ids"] == usual.encode_ordinary(texts[r["doc_id"]])


def test_mixing_keeps_clean_documents_left_out_of_the_fit(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(10)) == 0
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels.where(~held))
    kept = corpus_pipeline.clean_mix(spark, docs, sf).select("doc_id", F.lit(True).alias("stays"))
    found = mixing.label_domains(labels.where(held)).join(docs, "doc_id").join(kept, "doc_id", "left").withColumn(
        "marked", F.lower("text").rlike("trash|pathetic|idiot|worthless|stupid|clown|loser|scum|moron"))
    share = {(r["domain"], r["marked"]): r["s"] for r in found.groupBy("domain", "marked").agg(
        F.avg(F.coalesce("stays", F.lit(False)).cast("int")).alias("s")).collect()}
    print("stay, left out of the fit:", share)
    assert share["high", False] > 0.97 and share["low", False] > 0.9 and share["toxic", True] < 0.4


def test_stage_names_and_oracle():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mixing", "encoding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_an_empty_table_passes_through_every_stage(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "intact"] and out.collect() == []
