"""Operator 10: byte-level BPE by corpus-level merge replay, and decoding.

The words (pattern matches) of a whole batch of texts are collected once. An
inverted index from merge rank to word positions holds every adjacent token pair;
the lowest rank present is applied at all its positions at once, and only the two
touched neighbours of each merged position are looked up anew. The texts' ids are
then gathered from their words. Decoding maps ids to bytes and concatenates.

Replaying one rank at all places equals the usual word-by-word rule as long as no
merge gives rise to a lower rank; words where that happens are encoded again word
by word, so the ids are always those of the usual rule.

Edge cases: null text is empty; an empty text has no ids; texts and words of any
length are encoded whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_NONE = -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Merge replay over batches of words, for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.merged: dict[int, int] = {}  # pair key -> rank of the joined bytes, or _NONE
        size = max(ranks.values()) + 1
        self.bits = 16 if size <= 1 << 16 else 32
        self.length = np.zeros(size, np.int64)
        for t, r in ranks.items():
            self.length[r] = len(t)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(r, b"") for r in range(size)), np.uint8)

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.bits == 16:
            return left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        return left.astype(np.int64) << self.bits | right

    def _pair_ranks(self, keys: list[int]) -> list[int]:
        """Rank of the joined bytes of every pair key, or _NONE."""
        merged, low = self.merged, (1 << self.bits) - 1
        for key in keys:
            if key not in merged:
                merged[key] = self.ranks.get(self.bytes_of[key >> self.bits] + self.bytes_of[key & low], _NONE)
        return [merged[key] for key in keys]

    def one_word(self, word: bytes) -> list[int]:
        """The usual rule: join the leftmost pair of lowest rank until none is left."""
        n = len(word)
        token = [bytes([b]) for b in word]
        after, before = [*range(1, n), _NONE], [_NONE, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if token[i] else _NONE
            if j == _NONE or self.ranks.get(token[i] + token[j]) != rank:
                continue  # one of the two has been joined since
            token[i], token[j] = token[i] + token[j], b""
            after[i] = after[j]
            if after[j] != _NONE:
                before[after[j]] = i
            for k in (before[i], i):
                if k != _NONE and after[k] != _NONE and (r := self.ranks.get(token[k] + token[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [self.ranks[t] for t in token if t]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words one after the other, and the number of ids of each word."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.array([len(w) for w in words])
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[np.cumsum(sizes) - 1] = _NONE
        before[np.cumsum(sizes) - sizes] = _NONE
        alive = np.ones(n, bool)
        rank_at = np.full(n, _NONE, np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def enter(places: np.ndarray, now: int) -> None:
            """(Re)index the pairs that begin at ``places``."""
            nxt = after[places]
            rank_at[places[nxt == _NONE]] = _NONE
            places, nxt = places[nxt != _NONE], nxt[nxt != _NONE]
            if not len(places):
                return
            keys = self._keys(token[places], token[nxt])
            order = np.argsort(keys)
            keys, places = keys[order], places[order]
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            bounds = [*cuts.tolist(), len(keys)]
            ranks = self._pair_ranks(keys[cuts].tolist())
            rank_at[places] = np.repeat(np.array(ranks, np.int32), np.diff(bounds))
            for r, a, b in zip(ranks, bounds, bounds[1:]):
                if r == _NONE:
                    continue
                if r < now:
                    odd.append(word_of[places[a:b]])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(places[a:b])

        enter(np.arange(n, dtype=np.int32), _NONE)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            places = np.concatenate(found)
            places = _distinct(places[alive[places] & (rank_at[places] == rank)])
            if not len(places):
                continue
            right = after[places]
            if len(places) > 1 and (places[1:] == right[:-1]).any():  # a run such as "aaaa": leftmost first
                taken, blocked = [], _NONE
                for p, q in zip(places.tolist(), right.tolist()):
                    if p != blocked:
                        taken.append(p)
                        blocked = q
                places = np.array(taken, np.int32)
                right = after[places]
            beyond = after[right]
            token[places] = rank
            alive[right] = False
            after[places] = beyond
            inner = beyond != _NONE
            before[beyond[inner]] = places[inner]
            left = before[places]
            enter(_distinct(np.concatenate([left[left != _NONE], places])), rank)
        ids, of = token[alive], word_of[alive]
        counts = np.bincount(of, minlength=len(words))
        if odd:
            ends = np.cumsum(counts)
            pieces = np.split(ids, ends[:-1])
            for w in np.unique(np.concatenate(odd)).tolist():
                pieces[w] = np.array(self.one_word(words[w]))
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[gather(self.start[ids], self.length[ids])].tobytes()


def _distinct(places: np.ndarray) -> np.ndarray:
    """Sorted, each place once."""
    places = np.sort(places)
    return places[np.r_[True, places[1:] != places[:-1]]] if len(places) else places


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class _Numbered(dict):
    """Numbers every new key."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


# a blank after white space and before white space or the end: there a cut could split one match
_RUN_OF_BLANKS = re.compile(r"\s (?:\s|\Z)")
TABLE_BYTES = 48 << 20  # distinct pieces, words and pairs held at a time; encoding simply starts new tables beyond
ENTRY_BYTES = 150  # what a key of a table takes besides its text
SLICE_BYTES = 4 << 20  # text encoded at a time; a longer text is a slice of its own


class _Pieces:
    """Ids of every distinct blank-delimited piece of a task's texts, each split and encoded once."""

    def __init__(self, codec: Codec, pattern: str):
        self.codec, self.find = codec, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.number, self.known, self.text_bytes = _Numbered(), 0, 0
        self.words, self.word_ids, self.word_counts = _Numbered(), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def split(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a text. No match goes on past a blank after a non-blank, so texts are
        cut before such blanks; a text in which that could differ is one piece of its own."""
        if _RUN_OF_BLANKS.search(text):
            return np.array([self.number[" " + text]], np.int32)
        first, *rest = text.split(" ")
        out = np.fromiter(map(self.number.__getitem__, rest), np.int32, len(rest))
        return np.append(np.int32(self.number[" " + first]), out) if first else out

    def encode_new(self) -> None:
        sizes_of: list[int] = []

        def matches():
            for piece in itertools.islice(self.number, self.known, None):
                self.text_bytes += 2 * len(piece)  # in the piece and in its words
                # pieces hold no blank; one put before them marks those that do not follow a blank
                found = self.find(piece[1:] if piece[:1] == " " else " " + piece)
                sizes_of.append(len(found))
                yield from found

        of = np.fromiter(map(self.words.__getitem__, matches()), np.int64)
        sizes = np.array(sizes_of, np.int64)
        self.known = len(self.number)
        new = list(itertools.islice(self.words, len(self.word_counts), None))
        ids, counts = self.codec.encode_words([w.encode() for w in new])
        self.word_ids = np.concatenate([self.word_ids, ids.astype(np.int32)])
        self.word_counts = np.concatenate([self.word_counts, counts])
        starts = np.cumsum(self.word_counts) - self.word_counts
        self.ids = np.concatenate([self.ids, self.word_ids[gather(starts[of], self.word_counts[of])]])
        ends = np.cumsum(sizes)
        per_word = np.concatenate([[0], np.cumsum(self.word_counts[of])])
        self.counts = np.concatenate([self.counts, per_word[ends] - per_word[ends - sizes]])
        self.starts = np.cumsum(self.counts) - self.counts

    def size(self) -> int:
        """About how many bytes the tables take."""
        entries = len(self.number) + len(self.words) + len(self.codec.merged)
        return ENTRY_BYTES * entries + self.text_bytes + 4 * (len(self.ids) + len(self.word_ids))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and, on demand, ``decoded`` (bytes of those ids)."""
    added = ("ids", "decoded") if decode else ("ids",)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    names = [*kept.columns, *added]
    at = kept.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        for batch, ids_of, codec in _encoded(batches, at, path, pattern):
            ids = [ids_of(i) for i in range(batch.num_rows)]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))]
            if decode:
                columns.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, f"{fields}, ids array<int>" + ", decoded binary" * decode)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the bytes they decode to."""
    def run(batches):
        for batch, ids_of, codec in _encoded(batches, 1, path, pattern):
            counts, digests, decoded = [], [], []
            for i in range(batch.num_rows):
                ids = ids_of(i)
                counts.append(len(ids))
                digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, "
             "decoded_sha256 string")


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes.astype(np.int64) + 1)
    start = 0
    while start < len(upto):
        end = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_BYTES, "right"))
        yield start, max(start + 1, end)
        start = max(start + 1, end)


def _encoded(batches, at: int, path: str, pattern: str):
    """(slice, ids of its i-th text, codec) for slices of a task's batches; the tables live as long as the task
    or until they reach ``TABLE_BYTES``."""
    codec = Codec(load_ranks(path))
    table = _Pieces(codec, pattern)
    for whole in batches:
        for start, end in _slices(whole.column(at)):
            batch = whole.slice(start, end - start)
            if table.size() > TABLE_BYTES:
                table.clear()
                codec.merged.clear()
            pieces = [table.split(x.as_py() or "") for x in batch.column(at)]
            table.encode_new()

            def ids_of(i, pieces=pieces):
                return table.ids[gather(table.starts[pieces[i]], table.counts[pieces[i]])]

            yield batch, ids_of, codec
