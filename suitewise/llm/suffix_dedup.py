"""Operator 6: exact removal of repeated byte strings by prefix-free parsing and suffix arrays.

Texts are taken as UTF-8 bytes; a *window* is a string of ``LENGTH`` bytes. Every
byte is removed that a window covers which also starts earlier (smaller id, or same
document and earlier start); windows never cross documents.

Parsing. A rolling hash runs over all 32-byte strings; the smallest hash inside a
window is its *trigger*. Consecutive windows with one trigger form a *phrase*, and
phrases overlap by LENGTH - 1 bytes, so every window is exactly one phrase suffix
longer than the overlap and equal windows sit at the same place of their triggers.
The distinct phrases are the dictionary, the phrase sequence of a text its parse.

Order. Windows can only be equal below one trigger string. For the dictionary phrases
of a trigger two suffix arrays are built: one sorts what follows the trigger (parse
side), the other the phrase parts before it, read backwards (dictionary side), each
with the common prefix lengths of neighbours. The windows that reach ``o`` bytes
before the trigger are equal where both arrays agree to depth o and LENGTH - o; so
the pair of intervals is the window's place in corpus order (cut at LENGTH bytes),
and its first occurrence is the smallest (id, start) among its phrases.

As Spark jobs: triggers that occur once are settled by a keyed count; the rest of the
phrases are brought to one row per distinct phrase with its first occurrence (both
with map-side combining, so hot phrases do not gather); phrases of triggers with
several distinct phrases go to the task that owns the trigger, at most about
``GROUP`` to a task: larger groups are dealt by phrase hash, and their local
first occurrences meet in one more keyed minimum. Texts are shuffled by id.

Edge cases: null text is empty; texts shorter than a window stay whole; texts are
handled at any length; equal or null ids are ordered by (id, text), nulls first, and
count as separate documents; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitewise.llm.common import cut

LENGTH = 100
TRIGGER = 32
SPAN = LENGTH - TRIGGER + 1  # trigger positions in a window
GROUP = 1024
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 18
_PLACE = 28  # low bits that hold the position while the smallest hash is sought
_MEMBERS = 100_000
_HASHED = 10_000  # windows hashed at a time


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (a power of two) bytes from every place, by doubling."""
    h, step, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    while step < size:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power % (1 << 64), step * 2
    return _mix(h)


def _smallest(keys: np.ndarray, span: int) -> np.ndarray:
    step = 1
    while step * 2 <= span:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return np.minimum(keys[:-(span - step)], keys[span - step:]) if step < span else keys


class Parser:
    """Phrases of slices of concatenated texts."""

    def __init__(self):
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])

    def parse(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text number, first window, trigger, last window, trigger hash, phrase hash) of all phrases, in order.

        ``data``: texts one after the other, ``ends``: where each ends; places count from the slice's start.
        """
        none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
        if len(data) < LENGTH:
            return none
        h = _grams(data, TRIGGER)
        low = np.uint64((1 << _PLACE) - 1)
        least = _smallest(h & ~low | np.arange(len(h), dtype=np.uint64), SPAN)
        trigger = (least & low).astype(np.int64)
        sizes = np.diff(ends, prepend=0)
        room = np.repeat(ends, sizes)[:len(trigger)] - LENGTH  # last window of the text at each place
        trigger[np.arange(len(trigger)) > room] = -1
        first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
        last = np.r_[first[1:], len(trigger)] - 1
        real = trigger[first] >= 0
        first, last = first[real], last[real]
        if not len(first):
            return none
        trigger = trigger[first]
        self._grow(len(data))
        sums = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * self.powers[:len(data)])]
        phrase = _mix((sums[last + LENGTH] - sums[first]) * self.inverses[first])
        phrase ^= _mix(((trigger - first) << 8 | (last - first)).astype(np.uint64) + np.uint64(_BASE))
        return np.searchsorted(ends, first, side="right"), first, trigger, last, h[trigger], phrase


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets between its texts (null is empty)."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _SLICE bytes; a longer text is a slice of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + _SLICE, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def _phrases(parser: Parser, column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Per slice: (row, packed place, trigger hash, phrase hash).

    A packed place is first window << 16 | (trigger - first) << 8 | (last - first), places counted in the text.
    """
    data, offsets = _bytes_of(column)
    for a, b in _slices(offsets):
        base = offsets[a]
        text, first, trigger, last, key, phrase = parser.parse(data[base:offsets[b]], offsets[a + 1:b + 1] - base)
        own = first - (offsets[a + text] - base)
        yield a + text, own << 16 | (trigger - first) << 8 | (last - first), key.view(np.int64), phrase.view(np.int64)


def _firsts_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first row of every distinct key tuple, and how often it occurs."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.r_[at, len(order)])


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _trigger_rows(batches):
    """(key, n, rid, place): every trigger of every text, with its count and first phrase in the text."""
    parser = Parser()
    for batch in batches:
        rid = batch.column(0).to_numpy()
        for row, place, key, _ in _phrases(parser, batch.column(1)):
            at, n = _firsts_of([row, key])
            yield _batch(["key", "n", "rid", "place"], [key[at], n.astype(np.int64), rid[row[at]], place[at]])


def _phrase_rows(batches):
    """(key, phrase, rid, place): phrases whose trigger is not known to be unique, once per text."""
    parser = Parser()
    for batch in batches:
        rid = batch.column(0).to_numpy()
        settled, cuts = _lists(batch.column(2))
        for row, place, key, phrase in _phrases(parser, batch.column(1)):
            if not len(row):
                continue
            a, b = row[0], row[-1] + 1
            # (row, place) of the settled phrases of this slice; both are below 2**62 together
            have = np.repeat(np.arange(a, b), np.diff(cuts[a:b + 1])), settled[cuts[a]:cuts[b]]
            loose = ~_contained(row - a, place, have[0] - a, have[1])
            row, place, key, phrase = row[loose], place[loose], key[loose], phrase[loose]
            at, _ = _firsts_of([row, key, phrase])
            yield _batch(["key", "phrase", "rid", "place"], [key[at], phrase[at], rid[row[at]], place[at]])


def _contained(row: np.ndarray, place: np.ndarray, in_row: np.ndarray, in_place: np.ndarray) -> np.ndarray:
    """Which (row, place) occur among the second pairs. Places hold a text's position, so they fit 47 bits."""
    return np.isin(row << 47 | place, in_row << 47 | in_place)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array<bigint> column (null is empty)."""
    sizes = np.nan_to_num(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(sizes)]


def _depths(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array (rank of every member, groups apart) and common prefix length with the neighbour before."""
    keyed = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), strings], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    differ = strings[order][1:] != strings[order][:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    common[group[order][1:] != group[order][:-1]] = -1
    return rank, np.r_[-1, common]


def first_windows(group: np.ndarray, rid: np.ndarray, first: np.ndarray, left: np.ndarray, more: np.ndarray,
                  data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every distance o before the trigger: members whose window there is the first of its class.

    ``left``: trigger - first window, ``more``: last - first window; the phrase of a member is the more + LENGTH
    bytes from ``starts``. Yields (o, member numbers); members of one group share the trigger.
    """
    order = np.lexsort((first + left, rid))  # corpus order of windows at one distance
    group, left, more, starts = group[order], left[order], more[order], starts[order]
    after = np.arange(LENGTH)
    have = more + LENGTH - left
    at = np.minimum((starts + left)[:, None] + after, len(data) - 1)
    right, right_common = _depths(np.where(after < have[:, None], data[at], 0), group)
    back = np.arange(SPAN)
    at = np.maximum((starts + left - 1)[:, None] - back, 0)
    before, before_common = _depths(np.where(back < left[:, None], data[at], 0), group)
    for o in range(SPAN):
        here = np.flatnonzero((left - more <= o) & (o <= left))
        if len(here):
            follows = np.cumsum(right_common < LENGTH - o)[right[here]]
            precedes = np.cumsum(before_common < o)[before[here]]
            _, at = np.unique(follows * (len(group) + 1) + precedes, return_index=True)
            yield o, order[here[at]]


def _member_chunks(batches) -> Iterator[pa.Table]:
    """The sorted members of a task in chunks of whole (key, salt) groups."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < _MEMBERS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, salt = table["key"].to_numpy(), table["salt"].to_numpy()
        whole = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])[-1])
        if whole:
            yield table.slice(0, whole)
        held, rows = table.slice(whole).to_batches(), table.num_rows - whole
    if rows:
        yield pa.Table.from_batches(held)


def _window_rows(batches):
    """(split, w1, w2, rid, place): first windows, as runs in whole groups (split false), else one by one with
    a 128-bit hash of their bytes."""
    for table in _member_chunks(batches):
        table = table.combine_chunks()
        key, salt = table["key"].to_numpy(), table["salt"].to_numpy()
        new = np.r_[False, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
        group = np.cumsum(new)
        rid, place = table["rid"].to_numpy(), table["place"].to_numpy()
        split = table["split"].to_numpy(zero_copy_only=False)
        data, offsets = _bytes_of(table["ext"].combine_chunks() if table["ext"].num_chunks != 1 else table["ext"].chunk(0))
        first, left, more = place >> 16, place >> 8 & 255, place & 255
        found = [(np.full(len(m), o), m) for o, m in
                 first_windows(group, rid, first, left, more, data, offsets[:-1])]
        distance, member = (np.concatenate(x) for x in zip(*found))
        at = first[member] + left[member] - distance
        order = np.lexsort((at, member))
        member, at = member[order], at[order]
        apart = split[member]
        m, x = member[~apart], at[~apart]
        if len(m):
            head = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (x[1:] != x[:-1] + 1)])
            run = np.diff(np.r_[head, len(m)])
            zero = np.zeros(len(head), np.int64)
            yield _batch(["split", "w1", "w2", "rid", "place"],
                         [np.zeros(len(head), bool), zero, zero, rid[m[head]], x[head] << 16 | run - 1])
        m, x = member[apart], at[apart]
        for a in range(0, len(m), _HASHED):
            who, where = m[a:a + _HASHED], x[a:a + _HASHED]
            window = data[(offsets[who] + where - first[who])[:, None] + np.arange(LENGTH)].astype(np.uint64)
            w1 = _mix(((window + np.uint64(1)) * _WEIGHTS[0]).sum(axis=1, dtype=np.uint64))
            w2 = _mix(((window + np.uint64(1)) * _WEIGHTS[1]).sum(axis=1, dtype=np.uint64))
            yield _batch(["split", "w1", "w2", "rid", "place"],
                         [np.ones(len(who), bool), w1.view(np.int64), w2.view(np.int64), rid[who], where << 16])


_WEIGHTS = np.random.default_rng(6).integers(1, 1 << 63, (2, LENGTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _numbered(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """(rid, text), where rid rises in corpus order and is one document's alone; and rid with doc_id and the kept
    columns, or None where rid says it all."""
    facts = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if facts["n"] == facts["ids"]:
        rows = docs.withColumn("rid", F.col("doc_id").cast("bigint"))
        return rows.select("rid", "text"), rows.select("rid", "doc_id", *keep) if keep else None
    rows = cut(docs.select("doc_id", "text", *keep).orderBy(
        F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))).withColumn("rid", F.monotonically_increasing_id())
    return rows.select("rid", "text"), rows.select("rid", "doc_id", *keep)


def _final_rows(batches):
    """(rid, carried columns, n_bytes, n_removed, spans, kept): complements of the first windows."""
    for batch in batches:
        data, offsets = _bytes_of(batch.column(1))
        lists = [_lists(batch.column(c)) for c in (2, 3)]
        kept, spans, removed = [], [], []
        for i in range(batch.num_rows):
            own = data[offsets[i]:offsets[i + 1]]
            windows = len(own) - LENGTH + 1
            parts = [v[c[i]:c[i + 1]] for v, c in lists]
            if windows <= 0 or sum(int(((p & 255) + 1).sum()) for p in parts) == windows:
                kept.append(own.tobytes())
                spans.append([])
                removed.append(0)
                continue
            p = np.sort(np.concatenate(parts))
            lo, hi = p >> 16, (p >> 16) + (p & 255)
            # runs of windows that are not first, then the bytes they cover, joined where they touch
            gap_lo, gap_hi = np.r_[0, hi + 1], np.r_[lo - 1, windows - 1]
            gap = gap_lo <= gap_hi
            start, stop = gap_lo[gap], gap_hi[gap] + LENGTH
            head = np.r_[True, start[1:] > stop[:-1]]
            start, stop = start[head], stop[np.r_[head[1:], True]]
            keep = np.ones(len(own), bool)
            mark = np.zeros(len(own) + 1, np.int64)
            mark[start] += 1
            mark[stop] -= 1
            keep = np.cumsum(mark[:-1]) == 0
            kept.append(own[keep].tobytes())
            spans.append([{"start": int(a), "len": int(b - a)} for a, b in zip(start, stop)])
            removed.append(int((stop - start).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *batch.columns[4:], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())]))),
             pa.array(kept, pa.binary())],
            names=["rid", *batch.schema.names[4:], "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, group: int = GROUP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, len of maximal removed runs), kept (remaining bytes), and the
    columns of ``docs`` named in ``keep``."""
    texts, own = _numbered(docs, keep)
    # triggers that occur once in the corpus: their windows are all first
    triggers = texts.select("rid", "text").mapInArrow(_trigger_rows, "key bigint, n bigint, rid bigint, place bigint")
    single = triggers.groupBy("key").agg(F.sum("n").alias("n"), F.min("rid").alias("rid"),
                                         F.min("place").alias("place")).where("n = 1")
    settled = single.groupBy("rid").agg(F.collect_list("place").alias("settled"))
    known = texts.join(settled, "rid", "left")
    # the dictionary of all other phrases: first occurrence of each, and how many share its trigger
    dictionary = (
        known.select("rid", "text", "settled")
        .mapInArrow(_phrase_rows, "key bigint, phrase bigint, rid bigint, place bigint")
        .groupBy("key", "phrase").agg(F.min("rid").alias("rid"), F.min_by("place", "rid").alias("place")))
    counted = dictionary.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    lone = counted.where("n = 1").select("rid", "place")
    shared = counted.where("n > 1").groupBy("rid").agg(F.collect_list(F.struct("key", "phrase", "place", "n")).alias("m"))
    # left joins on (rid, text) throughout: the three uses of the texts then share one shuffle
    member = texts.join(shared, "rid", "left").select("rid", F.encode("text", "UTF-8").alias("raw"), "m").select(
        "rid", F.inline(F.transform("m", lambda x: F.struct(
            x["key"].alias("key"), x["place"].alias("place"),
            (x["n"] > group).alias("split"),
            F.pmod(x["phrase"], F.ceil(x["n"] / group)).cast("int").alias("salt"),
            F.substring("raw", (F.shiftright(x["place"], 16) + 1).cast("int"),
                        (x["place"].bitwiseAND(255) + LENGTH).cast("int")).alias("ext")))))
    windows = (member.repartition("key", "salt").sortWithinPartitions("key", "salt")
               .mapInArrow(_window_rows, "split boolean, w1 bigint, w2 bigint, rid bigint, place bigint"))
    merged = (windows.where("split").groupBy("w1", "w2", "rid").agg(F.min("place").alias("place"))
              .groupBy("w1", "w2").agg(F.min("rid").alias("rid"), F.min_by("place", "rid").alias("place")))
    found = (lone.unionByName(windows.where("not split").select("rid", "place"))
             .unionByName(merged.select("rid", "place")).groupBy("rid").agg(F.collect_list("place").alias("found")))
    result = ("n_bytes", "n_removed", "spans", "kept")
    if own is not None:
        found = own.join(found, "rid", "left")
    carried = [] if own is None else [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:]]
    out = (known.join(found, "rid", "left").select("rid", "text", "settled", "found", *([] if own is None else own.columns[1:]))
           .mapInArrow(_final_rows, ", ".join(["rid bigint", *carried]) + ", n_bytes bigint, n_removed bigint, "
                       "spans array<struct<start:bigint,len:bigint>>, kept binary"))
    if own is None:
        return out.withColumnRenamed("rid", "doc_id")
    return out.select("doc_id", *keep, *result)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of what stays."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
