"""Operator 13: importance resampling towards a target distribution, on Arrow kernels.

Texts pass through ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten``; ``dictionary_encode`` numbers the
words of a slice. Shifted copies of the indices form runs of words. CRC-32 is linear, so the checksum of a run follows
from that of its beginning by a table per length of the added word: it is worked out once for every distinct pair of
words, ``take``n to the places of the pair and extended by one word for triples. Checksums modulo ``BUCKETS`` are the
features. The gain of a bucket is the log ratio of its smoothed shares in the target and in the corpus; the gains are
taken to the places and summed per document by a segment reduction. With Gumbel noise from a hash of the id, the
highest scores are a weighted draw without replacement.

Plan: two passes over the texts (counts, then weights), nothing but 10,000 counts a task and four numbers a document
is shuffled; the driver holds the 10,000 gains. The ranking is ordered by ranges, without a window over all rows.

Edge cases: a null or empty text has no words, weight 0 and is never drawn; words of any length are taken whole; a
null id hashes as the empty string and sorts first among ties; rows that repeat an id are scored each for itself; with
an empty target or corpus the smoothed shares are even there; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitewise.llm.common import cut
from suitewise.operators.ordered import global_rank

BUCKETS = 10_000
RUNS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 4 << 20


class Checksums:
    """CRC-32 of joined strings from the CRC-32 of their parts."""

    def __init__(self):
        value = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
        high = [(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)]
        # appending one zero byte, as a table of 256 for each byte of the checksum
        self.doubled = [np.stack([value[h & 0xFF] ^ (h >> np.uint32(8)) for h in high])]
        self.by_length: dict[int, np.ndarray] = {0: np.stack(high)}

    @staticmethod
    def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = table[0][crc & 0xFF]
        for k in range(1, 4):
            out = out ^ table[k][(crc >> np.uint32(8 * k)) & 0xFF]
        return out

    def table(self, length: int) -> np.ndarray:
        """The tables that append ``length`` zero bytes."""
        if length not in self.by_length:
            out, bit = self.by_length[0], 0
            while length >> bit:
                if bit == len(self.doubled):
                    self.doubled.append(self._through(self.doubled[-1], self.doubled[-1]))
                if length >> bit & 1:
                    out = self._through(self.doubled[bit], out)
                bit += 1
            if len(self.by_length) > 4096:
                self.by_length = {0: self.by_length[0]}
            self.by_length[length] = out
        return self.by_length[length]

    def tables(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tables of the distinct lengths, flat, and where each length's tables start."""
        distinct, at = np.unique(lengths, return_inverse=True)
        flat = np.concatenate([self.table(n).ravel() for n in distinct.tolist()]) if len(distinct) else np.zeros(0, np.uint32)
        return flat, at.astype(np.int64) * 1024


def append(flat: np.ndarray, start: np.ndarray, crc: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Checksums of strings (``crc``) followed by others (``tail``) whose length's tables begin at ``start``."""
    out = tail.copy()
    for k in range(4):
        out ^= flat[start + (256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(0xFF)).astype(np.int64))]
    return out


class Slice:
    """The words of some texts and the buckets of all runs that begin at each word (-1: the text ends before)."""

    def __init__(self, texts: pa.Array, checksums: Checksums):
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BREAKS)
        flat = pc.list_flatten(lists)
        filled = pc.greater(pc.binary_length(flat), 0)
        words = flat.filter(filled)
        upto = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))]
        self.offsets = upto[np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]].astype(np.int64)
        n = len(words)
        encoded = words.dictionary_encode()
        at = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spelt = encoded.dictionary.cast(pa.binary())
        crc = np.fromiter(map(zlib.crc32, spelt.to_pylist()), np.uint32, len(spelt))
        lengths = pc.binary_length(spelt).to_numpy(zero_copy_only=False).astype(np.int64)
        tables, start = checksums.tables(lengths)
        spaced = append(tables, start, np.full(len(spelt), zlib.crc32(b" "), np.uint32), crc)
        tables, start = checksums.tables(lengths + 1)
        own = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.buckets = [np.asarray(crc % BUCKETS, np.int64)[at]]
        run = None
        for k in range(1, RUNS):
            first, last = at[:max(n - k, 0)], at[k:]
            if k == 1:  # each distinct pair once
                pairs = pa.array(first * max(len(spelt), 1) + last).dictionary_encode()
                a, b = np.divmod(pairs.dictionary.to_numpy(), max(len(spelt), 1))
                run = append(tables, start[b], crc[a], spaced[b])
                run = pa.array(run).take(pairs.indices).to_numpy(zero_copy_only=False)
            else:
                run = append(tables, start[last], run[:len(last)], spaced[last])
            bucket = np.full(n, -1, np.int64)
            bucket[:len(last)] = np.where(own[:max(n - k, 0)] == own[k:], (run % BUCKETS).astype(np.int64), -1)
            self.buckets.append(bucket)

    def counts(self) -> np.ndarray:
        return sum(np.bincount(b[b >= 0], minlength=BUCKETS) for b in self.buckets)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per word over the words of each text."""
        return np.diff(np.r_[0, np.cumsum(values)][self.offsets])


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE_BYTES`` of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES, "right")))
        yield start, end
        start = end


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts per bucket."""
    def count(batches):
        checksums, total = Checksums(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                total += Slice(batch.column(0).slice(a, b - a), checksums).counts()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in texts.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(
            F.sum("n").alias("n")).collect():  # BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares, per bucket."""
    s, t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * s) / ((a + 1.0) * t)))
                     for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    def run(batches):
        checksums, padded = Checksums(), np.r_[gain, 0]  # bucket -1: no run
        for batch in batches:
            for a, b in slices(batch.column(1)):
                own = Slice(batch.column(1).slice(a, b - a), checksums)
                features = own.per_text(sum((x >= 0).astype(np.int64) for x in own.buckets))
                weight = own.per_text(sum(padded.take(x) for x in own.buckets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(own.offsets)), pa.array(features), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(
        run, f"doc_id {ids}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for a number u in (0, 1) hashed from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank; of the documents with ``least_words`` words the ``percent``
    with the highest scores have a rank."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = cut(weigh(docs, gain).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("bigint"))
                 .withColumn("long_enough", F.col("n_words") >= least_words))
    drawn = percent * scored.where("long_enough").count() // 100
    ranked = global_rank(scored, [F.desc("long_enough"), F.desc("score"), F.col("doc_id"), F.col("n_features"),
                                  F.col("weight")], "place")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


def resample_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH RECURSIVE k(n, v, step) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM k WHERE step < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM k WHERE step = 8),
src AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS MATERIALIZED (
  SELECT side, id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM src),
f AS MATERIALIZED (
  SELECT side, id, unnest(list_concat(words,
    list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS g
  FROM w),
d AS (SELECT DISTINCT g, hex(encode(g)) AS h FROM f),
b AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i:
      (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM d, tab),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (g) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM n) + 10000) AS DOUBLE)
                                 / CAST((s + 1) * ((SELECT sum(t) FROM n) + 10000) AS DOUBLE))) AS gain
  FROM n),
wt AS (
  SELECT f.id, count(*) AS n, sum(gain) AS weight
  FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY f.id),
sc AS (
  SELECT w.id AS doc_id, len(words) AS words, CAST(coalesce(wt.n, 0) AS BIGINT) AS n_features,
         CAST(coalesce(wt.weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(wt.weight, 0) + floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN wt ON wt.id = w.id WHERE side = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY words >= 20) AS total
  FROM sc)
SELECT doc_id, n_features, weight, score,
       CASE WHEN words >= 20 AND place <= (5 * total) // 100 THEN place END AS rank
FROM r
"""
