"""Operator 7: stupid-backoff language-model scores from hash-partitioned count tables.

A document's words are scored by the counts of all *other* documents: a word has
log(count(context word) / count(context)) for the longest context seen elsewhere,
each step back costs log(``ALPHA``), a word never seen elsewhere counts as seen once.

Plan: documents are dealt into blocks of about ``BLOCK_BYTES``. Most n-grams occur in one
block alone, where their count is known, so a block first explodes its n-grams and sends
each hash partition the rising top bits of the hashes, so many that few values meet another by
chance (there are more values than bytes of text, at any size); the partition answers with a
bit for each, whether another block has it too. Only those n-grams follow with their whole hashes and
counts. A partition of the count table adds the rows of all blocks and answers every row
with the totals of its n-grams, in the same order. Back at the block the totals are joined
to the n-grams of each document, the document's own counts are taken off, and the scores
are summed per document. One row stands for many n-grams, since a row for each would be
several times the input; hot n-grams occur once per block, and partitions are even because
they cut the hash range. The first exchange changes nothing but the bytes sent: an n-gram
of two blocks has equal top bits in both.

Edge cases: null or wordless texts have no words and score 0; the first words of a
text have shorter contexts; texts of any length are scored whole; rows with equal
ids are separate documents; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitewise.llm.common import cut
from suitewise.llm.near_dedup import Shingler, lower_bytes, spans

ORDER = 3  # of the registered query
ALPHA = 0.4
BLOCK_BYTES = 1 << 23
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def ngrams(column: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Text number of every word; per length n the hashes of n-grams and the word each ends at."""
    shingler = Shingler()
    data, offsets = lower_bytes(column)
    words, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in spans(offsets):
        word, row = shingler.words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        words.append(word)
        rows.append(row + a)
    word, row = np.concatenate(words), np.concatenate(rows)
    grams, ends = [_spread(word)], [np.arange(len(word))]
    for n in range(2, order + 1):
        end = np.arange(n - 1, len(word))
        end = end[row[end] == row[end - n + 1]] if len(end) else end
        h = np.zeros(len(end), np.uint64)
        for j in range(n):
            h = _spread(h * _STEP + word[end - n + 1 + j] + np.uint64(n))
        grams.append(h)
        ends.append(end)
    return row, grams, ends


def _text(table: pa.Table) -> pa.Array:
    column = table["text"].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


_LEVELS = (2, 4, 8, 16)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts of one or more in two bits each; what does not fit goes on with 4, 8, 16 and 64 bits."""
    rest, out = counts.astype(np.int64) - 1, [np.array([len(counts)], "<u8").tobytes()]
    for bits in _LEVELS:
        full = (1 << bits) - 1
        level = np.minimum(rest, full).astype("<u2")
        if bits < 8:
            level = np.r_[level, np.zeros(-len(level) % (8 // bits), "<u2")].reshape(-1, 8 // bits)
            level = np.bitwise_or.reduce(level << np.arange(0, 8, bits, dtype=np.uint16), axis=1)
        out.append(level.astype("<u2" if bits == 16 else np.uint8).tobytes())
        rest = rest[rest >= full] - full
    return b"".join([*out, rest.astype("<i8").tobytes()])


def _wide(raw: bytes) -> np.ndarray:
    n, at = int(np.frombuffer(raw, "<u8", 1)[0]), 8
    out, open_ = np.ones(n, np.int64), np.arange(n)
    for bits in _LEVELS:
        full, each = (1 << bits) - 1, max(1, 8 // bits)
        level = np.frombuffer(raw, "<u2" if bits == 16 else np.uint8, -(-len(open_) // each), at)
        at += level.nbytes
        if bits < 8:
            level = (level[:, None] >> np.arange(0, 8, bits, dtype=np.uint8) & full).reshape(-1)[:len(open_)]
        out[open_] += level
        open_ = open_[level == full]
    out[open_] += np.frombuffer(raw, "<i8", len(open_), at)
    return out


def _packed(values: np.ndarray) -> bytes:
    """Rising numbers in about 2 + log2(span / count) bits each: low bits as they are, the rest as gaps in unary."""
    n, first = len(values), values[:1]
    rest = values - first
    low = max(0, int(rest[-1]).bit_length() - n.bit_length())
    octets = rest.astype("<u8").view(np.uint8).reshape(n, 8)
    whole, bits = low >> 3, low & 7
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1, np.uint8)
    unary[high] = 1
    tail = np.unpackbits(octets[:, whole:whole + 1], axis=1, bitorder="little")[:, :bits] if bits else octets[:0]
    return b"".join((bytes([low]), np.array([n], "<u8").tobytes(), first.astype("<u8").tobytes(),
                     octets[:, :whole].tobytes(), np.packbits(tail).tobytes(), np.packbits(unary).tobytes()))


def _unpacked(raw: bytes) -> np.ndarray:
    low, (n, first) = raw[0], np.frombuffer(raw, "<u8", 2, 1)
    n, whole, bits = int(n), low >> 3, low & 7
    octets = np.zeros((n, 8), np.uint8)
    octets[:, :whole] = np.frombuffer(raw, np.uint8, n * whole, 17).reshape(n, whole)
    at = 17 + n * whole
    size = -(-n * bits // 8)
    if bits:
        tail = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * bits).reshape(n, bits)
        octets[:, whole] = np.packbits(tail, axis=1, bitorder="little")[:, 0]
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=at + size))) - np.arange(n)
    return (octets.reshape(-1).view("<u8") | high.astype(np.uint64) << np.uint64(low)) + first


def _tops(own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct top bits of rising hashes, and the place of each hash among them."""
    top = own >> np.uint64(64 - bits)
    new = np.r_[np.ones(min(1, len(top)), bool), top[1:] != top[:-1]]
    return top[new], np.cumsum(new) - 1


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms), per_word, n_backoffs."""
    rows = docs.select("doc_id", "text")
    ids = rows.schema["doc_id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    parts = blocks  # a partition of the count table is about as large as a block
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(blocks)).alias("block"),
                        "doc_id", "text")
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    bits = max(8, int(total).bit_length())  # more values than there are n-grams of a length

    def cuts(own):
        """(part, from, to) of the rising hashes."""
        at = [0, *np.searchsorted(own, edges, side="left").tolist(), len(own)]
        return [(p, a, b) for p, (a, b) in enumerate(zip(at, at[1:])) if a < b]

    def rows_of(rows, names):
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64() if c in ("part", "block", "n") else pa.binary())
                         for i, c in enumerate(names)})

    def announce(key, table):
        rows = []
        for n, h in enumerate(ngrams(_text(table), order)[1], 1):
            own = np.unique(h)
            rows += [(p, key[0].as_py(), n, _packed(_tops(own[a:b], bits)[0])) for p, a, b in cuts(own)]
        return rows_of(rows, ("part", "block", "n", "tops"))

    def mark(key, table):
        n_of, tops = table["n"].to_numpy(), [_unpacked(t) for t in table["tops"].to_pylist()]
        seen = [b""] * len(tops)
        for n in range(1, order + 1):
            rows = np.flatnonzero(n_of == n)
            if len(rows):
                _, at, blocks_of = np.unique(np.concatenate([tops[i] for i in rows]), return_inverse=True, return_counts=True)
                several = np.split(blocks_of[at] > 1, np.cumsum([len(tops[i]) for i in rows])[:-1])
                for i, s in zip(rows, several):
                    seen[i] = np.packbits(s).tobytes()
        return pa.table({"block": table["block"], "n": table["n"], "part": table["part"],
                         "seen": pa.array(seen, pa.binary())})

    def shared_of(rows):
        """The bits by (length, part)."""
        return dict(zip(zip(rows["n"].to_pylist(), rows["part"].to_pylist()), rows["seen"].to_pylist()))

    def several(seen, own):
        top, at = _tops(own, bits)
        return np.unpackbits(np.frombuffer(seen, np.uint8), count=len(top)).astype(bool)[at]

    def explode(key, texts, marks):
        shared, rows = shared_of(marks), []
        for n, h in enumerate(ngrams(_text(texts), order)[1], 1):
            own, count = np.unique(h, return_counts=True)
            for p, a, b in cuts(own):
                sent = several(shared[n, p], own[a:b])
                if sent.any():
                    rows.append((p, key[0].as_py(), n, shared[n, p], _packed(own[a:b][sent]), _narrow(count[a:b][sent])))
        return rows_of(rows, ("part", "block", "n", "seen", "grams", "counts"))

    def add_up(key, table):
        grams = [_unpacked(g) for g in table["grams"].to_pylist()]
        every, at = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.zeros(len(every), np.int64)
        np.add.at(totals, at, np.concatenate([_wide(c) for c in table["counts"].to_pylist()]))
        pieces = np.split(totals[at], np.cumsum([len(g) for g in grams])[:-1])
        return pa.table({"block": table["block"], "n": table["n"], "part": table["part"], "seen": table["seen"],
                         "totals": pa.array([_narrow(p) for p in pieces], pa.binary())})

    def score(key, texts, answers):
        row, grams, ends = ngrams(_text(texts), order)
        shared = shared_of(answers)
        answered = dict(zip(zip(answers["n"].to_pylist(), answers["part"].to_pylist()), answers["totals"].to_pylist()))
        n_words = np.bincount(row, minlength=texts.num_rows)
        counts = []  # per length: count elsewhere of the n-gram that ends at each word (0: none or not seen)
        for n, (h, end) in enumerate(zip(grams, ends), 1):
            own, at, totals = np.unique(h, return_inverse=True, return_counts=True)  # right if no other block has it
            for p, a, b in cuts(own):
                if (n, p) in answered:
                    totals[a:b][several(shared[n, p], own[a:b])] = _wide(answered[n, p])
            pair, back, mine = np.unique(row[end] * max(1, len(own)) + at, return_inverse=True, return_counts=True)
            elsewhere = np.zeros(len(row), np.int64)
            elsewhere[end] = totals[at] - mine[back]
            counts.append(elsewhere)
        value, steps, open_ = np.zeros(len(row)), np.zeros(len(row), np.int64), np.ones(len(row), bool)
        place = np.arange(len(row))
        first = np.cumsum(n_words) - n_words
        depth = place - first[row]  # words before it in its text
        for n in range(order, 1, -1):
            hit = open_ & (counts[n - 1] > 0)
            value[hit] += np.log(counts[n - 1][hit] / counts[n - 2][place[hit] - 1])
            open_ &= ~hit
            miss = open_ & (depth >= n - 1)
            value[miss] += math.log(ALPHA)
            steps[miss] += 1
        value[open_] += np.log(np.maximum(counts[0][open_], 1))
        unigrams = np.bincount(row[open_], minlength=texts.num_rows)  # each still lacks - log(words elsewhere)
        return pa.table({
            "doc_id": texts["doc_id"], "n_words": pa.array(n_words),
            "partial": pa.array(np.bincount(row, value, minlength=texts.num_rows)), "unigrams": pa.array(unigrams),
            "n_backoffs": pa.array(np.bincount(row, steps, minlength=texts.num_rows).astype(np.int64))})

    announced = dealt.groupBy("block").applyInArrow(announce, "part bigint, block bigint, n bigint, tops binary")
    marks = announced.groupBy("part").applyInArrow(mark, "block bigint, n bigint, part bigint, seen binary")
    sent = dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(
        explode, "part bigint, block bigint, n bigint, seen binary, grams binary, counts binary")
    answers = sent.groupBy("part").applyInArrow(
        add_up, "block bigint, n bigint, part bigint, seen binary, totals binary")
    scored = cut(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"doc_id {ids}, n_words bigint, partial double, unigrams bigint, n_backoffs bigint"))
    words = scored.agg(F.sum("n_words")).first()[0] or 0
    log_score = F.col("partial") - F.col("unigrams") * F.log(F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)))
    return scored.select("doc_id", "n_words", log_score.alias("log_score"), "n_backoffs").withColumn(
        "per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0)))
