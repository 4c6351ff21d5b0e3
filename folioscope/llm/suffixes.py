"""Suffix-array dedup: bytes inside strings of 200 bytes that occur more than once.

Texts are pooled in bundles and the starts that matter are put in suffix order in two stages.
A suffix that is smaller than its successor is sorted directly, on its bytes; every other
suffix is its first byte and a suffix that follows, so a scan of the buckets in order of the
first byte places all of those without comparing anything. Common prefixes of neighbours then
tell which strings of 200 bytes occur again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm import text as tx
from folioscope.llm.repeats import Units, finish, merge_spans, number_rows, repeated_runs

LENGTH, GRAM = 200, 32


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The last is not; equal bytes follow
    their successor."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = np.flatnonzero(data[:-1] != data[1:])
    if not len(differs):
        return out
    at = np.searchsorted(differs, np.arange(n - 1))
    known = at < len(differs)
    turn = differs[np.minimum(at, len(differs) - 1)]
    out[:-1] = known & (data[turn] < data[turn + 1])
    return out


def _words(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number: a view, nothing is copied."""
    return np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))


def _direct_sort(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """`at` in order of the `depth` bytes from each place: eight at a time, going on only
    with those that are still tied."""
    keys = words[at].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    live, new = np.arange(len(at)), np.ones(len(at), bool)
    new[1:] = keys[1:] != keys[:-1]
    for step in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        live, group = live[tied], np.cumsum(new)[tied]
        if not len(live):
            break
        keys = words[np.minimum(at[live] + step, len(words) - 1)].astype(np.uint64)
        order = np.lexsort((keys, group))
        at[live], keys = at[live][order], keys[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])
    return at


def two_stage_order(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts` (ascending) in the order of their suffixes, by `depth` bytes at least."""
    n = len(data)
    if not n or not len(starts):
        return starts
    small = smaller_than_next(data)
    #: Each start needs those after it, up to one that is sorted directly (or the last of all).
    direct = np.flatnonzero(small | (np.arange(n) == n - 1))
    stop = direct[np.minimum(np.searchsorted(direct, starts), len(direct) - 1)]
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, stop + 1, -1)
    needed = np.cumsum(marks[:-1]) > 0
    words = _words(np.concatenate([data, np.zeros(depth + 16, np.uint8)]))
    sorted_small = _direct_sort(words, np.flatnonzero(needed & small), depth)
    by_first = data[sorted_small]
    cuts = np.searchsorted(by_first, np.arange(257))
    induced = needed & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[n - 1]:
        waiting[int(data[n - 1])].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def hand_on(block: np.ndarray, bucket: int) -> np.ndarray:
        """Puts the predecessors of a block in line in their buckets; those of this bucket are
        returned, for its next round."""
        before = block[block > 0] - 1
        before = before[induced[before]]
        first = data[before]
        own = before[first == bucket]
        before, first = before[first > bucket], first[first > bucket]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(at, [*at[1:], len(first)]):
                waiting[int(first[a])].append(before[a:b])
        return own

    for bucket in range(256):
        block = np.concatenate(waiting[bucket]) if waiting[bucket] else np.zeros(0, np.int64)
        while len(block):
            out.append(block)
            block = hand_on(block, bucket)
        block = sorted_small[cuts[bucket] : cuts[bucket + 1]]
        if len(block):
            out.append(block)
            hand_on(block, bucket)
    order = np.concatenate(out)
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix, up to `depth`, of each suffix and the one before it: eight bytes at a
    time, what lies beyond the end taken off."""
    out = np.zeros(len(order), np.int64)
    words = _words(np.concatenate([data, np.zeros(depth + 16, np.uint8)]))
    live, a, b = np.arange(1, len(order)), order[:-1], order[1:]
    most = np.minimum(depth, len(data) - np.maximum(a, b))
    for step in range(0, depth, 8):
        differ = (words[a + step] ^ words[b + step]).astype(np.uint64)
        out[live] = step + 8
        ends = differ != 0
        out[live[ends]] = step + sum((differ[ends] < np.uint64(1 << 64 - 8 * i)).astype(np.int64) for i in range(1, 8))
        go = ~ends & (step + 8 < most[live - 1])
        live, a, b = live[go], a[go], b[go]
        if not len(live):
            break
    out[1:] = np.minimum(out[1:], most)
    return out


def strings_again(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Numbers of groups of equal strings: for each start (ascending) the number of its
    string, equal strings having equal numbers. All strings are whole."""
    order = two_stage_order(data, starts, length)
    fresh = common_prefixes(data, order, length) < length
    number = np.empty(len(starts), np.int64)
    number[np.searchsorted(starts, order)] = np.cumsum(fresh)
    return number


def examine(length: int):
    def work(rows: list[dict]) -> list[list[dict]]:
        data = np.frombuffer(b"".join(r["area"] for r in rows), np.uint8)
        sizes = np.array([len(r["area"]) for r in rows])
        runs = np.array([r["n"] for r in rows])
        base = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(rows)), runs)
        step = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
        number = strings_again(data, base[which] + step, length)
        times = np.bincount(number, weights=np.array([r["copies"] for r in rows])[which])
        again = times[number] > 1
        out: list[list[dict]] = [[] for _ in rows]
        turn = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (again[1:] != again[:-1])]))
        for a, b in zip(turn, np.concatenate([turn[1:], [len(which)]]) - 1):
            if again[a]:
                out[which[a]].append({"a": int(step[a]), "b": int(step[b]), "first": None, "again": True})
        return out

    return work


RESULT = [("text", "string"), ("kept", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("removed", "array<struct<start:int,end:int>>")]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        data, offsets = tx.buffers(batch.column("text"))
        kept, cut, gone = [], [], []
        for row, own in enumerate(spans):
            raw = data[offsets[row] : offsets[row + 1]].tobytes()
            merged = merge_spans(own)
            at, parts = 0, []
            for s, e in merged:
                parts.append(raw[at:s])
                at = e
            kept.append(b"".join([*parts, raw[at:]]))
            cut.append([{"start": s, "end": e} for s, e in merged])
            gone.append(sum(e - s for s, e in merged))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["row", "text", "kept", "n_bytes", "n_removed", "removed"])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, text, kept (the bytes that stay), n_bytes, n_removed
    and removed (maximal spans of bytes that go, in all copies).

    Texts are UTF-8 bytes; null and empty texts have none. Repeated rows are texts of their
    own, so they empty each other if they are long enough; texts below `length` bytes stay.
    Null and repeated ids are carried. Other columns have no part in it; with `carry` they come
    back, as they are, in a struct `rest`.
    """
    rows = number_rows(docs, doc_id, text, carry)
    spans = repeated_runs(rows, Units(length, gram, words=False), False, examine(length))
    return finish(rows, spans, _cut, RESULT)


