"""Operator 4: multilingual mixture inference for language identification.

Learning counts byte trigrams (hashed into ``BUCKETS`` cells) per language over
every labelled training text and gives one smoothed likelihood table of languages
x BUCKETS numbers, the only thing broadcast. Inference treats a text as a mixture
of languages: expectation-maximisation estimates the proportions from its trigram
likelihoods; nested language sets (largest proportions first) are refitted and
compared by penalised likelihood, and the largest proportion of the best set names
the document's language.

Edge cases: null text or text without any letter is ``und`` with score 0; a null
label or null text teaches nothing; with nothing learned every text is ``und``;
ties go to the language first in code order; texts of any length are used whole;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
EM_STEPS = 10
PENALTY = 6.0  # price of one more language, times log(trigrams)
SMOOTHING = 0.5
BLOCK_BYTES = 1 << 19

# every ASCII byte that is no letter counts as a blank, so marks and digits carry no language
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[c for c in range(128) if not chr(c).isalpha()]] = 32
_BLANK[np.arange(65, 91)] += 32


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every trigram that is not all blank; texts are padded with blanks."""
    raw = [b" " + t.lower().encode() + b" " for t in texts]
    codes = _BLANK[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    sizes = np.array([len(r) for r in raw])
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]
    number = np.repeat(np.arange(len(raw)), sizes)
    keep = (number[:-2] == number[2:]) & (packed != 0x202020)
    mixed = packed[keep] * np.uint32(2654435761)
    return number[:-2][keep], (mixed >> np.uint32(17)).astype(np.int64)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BLOCK_BYTES characters (a longer text is a run of its own)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BLOCK_BYTES:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in code order and their log likelihoods, shape (BUCKETS, languages)."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, block in _blocks(texts):
                names = langs[start:start + len(block)]
                known = sorted(set(names))
                code = {x: i for i, x in enumerate(known)}
                number, bucket = _trigrams(block)
                of = np.array([code[x] for x in names], np.int64)[number]
                table = np.bincount(of * BUCKETS + bucket, minlength=len(known) * BUCKETS).reshape(-1, BUCKETS)
                for x, i in code.items():
                    sums[x] = sums.get(x, 0) + table[i]
        for x, row in sums.items():
            hit = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(row[hit], pa.int64())],
                names=["lang", "bucket", "n"])

    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = (rows.mapInArrow(count, "lang string, bucket int, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())  # languages x BUCKETS at most
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((BUCKETS, len(names)), SMOOTHING)
    at = {x: i for i, x in enumerate(names)}
    columns = np.array([at[x] for x in counts.column("lang").to_pylist()], np.int64)
    np.add.at(table, (counts.column("bucket").to_numpy(), columns), counts.column("n").to_numpy())
    return names, np.log(table / table.sum(axis=0)) if names else table


def _mixture(logs: np.ndarray, n: np.ndarray, starts: np.ndarray, of: np.ndarray, allowed: np.ndarray,
             steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log likelihood of every text, by EM over the allowed languages."""
    top = logs.max(axis=1, keepdims=True)
    odds = np.exp(logs - top)
    total = np.add.reduceat(n, starts)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        weight = odds * share[of]
        weight *= (n / np.maximum(weight.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(weight, starts, axis=0) / total[:, None]
    fit = n * (np.log(np.maximum((odds * share[of]).sum(axis=1), 1e-300)) + top[:, 0])
    return share, np.add.reduceat(fit, starts)


def infer(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number (-1: no evidence), its proportion, and the size of the chosen language set."""
    best, score, size = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    number, bucket = _trigrams(texts)
    if not len(number) or not logs.shape[1]:
        return best, score, size
    keys, n = np.unique(number * BUCKETS + bucket, return_counts=True)
    texts_at, starts = np.unique(keys // BUCKETS, return_index=True)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    n = n.astype(float)
    own = logs[keys % BUCKETS]
    langs = logs.shape[1]
    full, fit = _mixture(own, n, starts, of, np.ones((len(starts), langs)), EM_STEPS)
    price = PENALTY * np.log(np.add.reduceat(n, starts) + 1)
    order = np.argsort(-full, axis=1, kind="stable")
    alone = np.take_along_axis(np.add.reduceat(own * n[:, None], starts, axis=0), order[:, :1], axis=1)[:, 0]
    chosen, chosen_size, value = order[:, 0].copy(), np.ones(len(starts), np.int64), alone - price
    # a text that no set can improve by the price of one more language keeps a single one
    open_ = np.flatnonzero(fit - 2 * price > value)
    for k in range(2, langs + 1):
        if not len(open_):
            break
        rows = np.flatnonzero(np.isin(of, open_))
        sub_of = np.searchsorted(open_, of[rows])
        sub_starts = np.flatnonzero(np.r_[True, sub_of[1:] != sub_of[:-1]])
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        share, got = _mixture(own[rows], n[rows], sub_starts, sub_of, allowed, EM_STEPS)
        better = got - k * price[open_] > value[open_]
        at = open_[better]
        value[at] = (got - k * price[open_])[better]
        chosen[at], chosen_size[at] = share[better].argmax(axis=1), k
        open_ = open_[fit[open_] - (k + 1) * price[open_] > value[open_]]
    best[texts_at], size[texts_at] = chosen, chosen_size
    score[texts_at] = np.clip(full[np.arange(len(starts)), chosen], 0.0, 1.0)
    return best, score, size


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and n_langs (size of the chosen language set)."""
    known, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((known, logs))  # languages x BUCKETS numbers
    added = ("lang_pred", "score", "n_langs")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    names = [*kept.columns, *added]
    at = kept.columns.index(text)

    def run(batches):
        langs, table = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            pred, score, size = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
            for start, block in _blocks([t or "" for t in texts]):
                best, share, k = infer(block, table)
                for i, b in enumerate(best):
                    if b >= 0 and any(map(str.isalpha, block[i])):
                        pred[start + i], score[start + i], size[start + i] = langs[b], share[i], k[i]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(size, pa.int32())],
                names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, n_langs int")


def held_out(doc_id: Column) -> Column:
    """The documents that no model may learn from; a null id is not held out (and teaches nothing)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_documents(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Likelihood table from the documents outside the held-out third."""
    return learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Language of every whole document text."""
    facts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(facts, learn_documents(docs)).select("doc_id", "held_out", "lang_pred", "score", "n_langs")
