"""Benchmark decontamination by winnowing.

Both sides keep the k-gram of least hash in every window of consecutive words (winnowing), so
any shared run of WINDOW words has a kept k-gram in common. Fingerprints of documents are
joined with those of the items, and each hit is extended to all windows of words around it
that an item has too; together they are the shared runs. Items of fewer words than a window have their
whole word sequence as the fingerprint, looked up at every position.

Items are compiled into tables of at most `block_bytes` of text. One such table, whose size is
checked, goes to all tasks; a larger benchmark is cut into blocks and the documents are
matched against one block after another, as a stated query set.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import text as tx

WINDOW, GRAM = 10, 4
BLOCK_BYTES = 32 << 20
RESULT = [("n_words", "long"), ("n_hit", "long"), ("hit_items", "array<string>"), ("hit_spans", "array<struct<start:int,end:int>>")]


def winnow(words: np.ndarray, starts: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of the kept k-grams: the least hash (by its upper half), leftmost on ties, of each run
    of `window` words that stays in one text. starts: first word of each text, and the end."""
    grams = tx.gram_hash(words, k)
    if len(words) < window:
        return np.zeros(0, np.int64)
    least = tx.sliding_least(tx.placed(grams), window - k + 1)
    ok = window_starts(starts, window, len(words))[: len(least)]
    return np.unique((least[ok] & tx.PLACE).astype(np.int64))


def window_starts(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Whether each word begins a run of `window` words that stays in one text."""
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(starts) >= window
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - window + 1, -1)
    return np.cumsum(inside)[:n] > 0


class Items:
    """The items of one block: the fingerprints that they keep, and their windows by hash."""

    def __init__(self, rows: list[tuple[str, str]], window: int, k: int) -> None:
        self.window, self.k, self.names = window, k, [n for n, _ in rows]
        data, offsets = tx.buffers(pa.array([t for _, t in rows], pa.string()))
        self.data = tx.LOWER[data]
        self.start, self.end, first = tx.word_bounds(self.data, offsets, tx.ALNUM)
        words, owner = tx.word_hashes(self.data, self.start, self.end), tx.rows_of(first)
        self.words = words
        self.prints = np.unique(tx.gram_hash(words, k)[winnow(words, first, window, k)])
        #: Length of windows -> their hashes in order, with place and item; of equal windows of an item one.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.diff(first)
        for n in sorted({min(window, int(x)) for x in lengths if x}):
            own = np.flatnonzero(window_starts(first, n, len(words)))
            own = own[(lengths[owner[own]] == n) | (n == window)]
            hashes = tx.gram_hash(words, n)[own]
            order = np.lexsort((own, owner[own], hashes))
            own, hashes = own[order], hashes[order]
            new = np.ones(len(own), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[own[1:]] != owner[own[:-1]])
            self.windows[n] = hashes[new], own[new], owner[own[new]]

    def match(self, words: np.ndarray, first: np.ndarray, raw) -> list[tuple[int, int, int]]:
        """(start, end, item) of windows that an item has too, in words; of those of one text that are
        equal all but the first are named with item -1. raw(i): the bytes of word i.

        A kept fingerprint of a text that an item keeps too is extended to the windows around it. All of
        it is linear in the words and hits, however often a word, a window or a hit is repeated."""
        hits: list[tuple[int, int, int]] = []
        for n, (hashes, places, owners) in self.windows.items():
            if len(words) < n or not len(hashes):
                continue
            grams = tx.gram_hash(words, n)
            starts = np.flatnonzero(window_starts(first, n, len(words)))
            if n == self.window:
                kept = winnow(words, first, n, self.k)
                own = tx.gram_hash(words, self.k)[kept]
                at = np.minimum(np.searchsorted(self.prints, own), len(self.prints) - 1)
                kept = kept[self.prints[at] == own] if len(self.prints) else kept[:0]
                around = np.unique((kept[:, None] - np.arange(n - self.k + 1)).ravel())
                starts = np.intersect1d(around, starts, assume_unique=True)
            lo, hi = (np.searchsorted(hashes, grams[starts], side) for side in ("left", "right"))
            some = hi > lo
            starts, lo, hi = starts[some], lo[some], hi[some]
            if not len(starts):
                continue
            steps = np.arange(n)
            same = (words[starts[:, None] + steps] == self.words[places[lo][:, None] + steps]).all(1)
            starts, lo, hi = starts[same], lo[same], hi[same]
            row = np.searchsorted(first, starts, "right") - 1
            order = np.lexsort((starts, lo, row))
            new = np.ones(len(order), bool)
            new[1:] = (row[order][1:] != row[order][:-1]) | (lo[order][1:] != lo[order][:-1])
            checked = False
            for i, fresh in zip(order.tolist(), new.tolist()):
                s = int(starts[i])
                if fresh:
                    #: one of each kind of window is compared byte by byte
                    at = int(places[lo[i]])
                    checked = all(raw(s + j) == bytes(self.data[self.start[at + j] : self.end[at + j]]) for j in range(n))
                    if checked:
                        hits += [(s, s + n, int(item)) for item in owners[lo[i] : hi[i]]]
                elif checked:
                    hits.append((s, s + n, -1))
        return hits


def _match_batch(column: pa.Array, items: Items) -> dict:
    data, offsets = tx.buffers(column)
    n_words, n_hit, names, spans = [], [], [], []
    for a, b in tx.slices(offsets):
        part = tx.LOWER[data[offsets[a] : offsets[b]]]
        start, end, first = tx.word_bounds(part, offsets[a : b + 1] - offsets[a], tx.ALNUM)
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        words = tx.word_hashes(part, start, end)
        for s, e, item in items.match(words, first, lambda i: bytes(part[start[i] : end[i]])):
            found[int(np.searchsorted(first, s, "right")) - 1].append((s, e, item))
        n_words += np.diff(first).tolist()
        for row in range(b - a):
            merged: list[list[int]] = []
            for s, e, _ in sorted(found.get(row, ())):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            at = int(first[row])
            n_hit.append(sum(e - s for s, e in merged))
            names.append(sorted({items.names[i] for _, _, i in found.get(row, ()) if i >= 0}))
            spans.append([{"start": s - at, "end": e - at} for s, e in merged])
    return {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit_items": pa.array(names, pa.list_(pa.string())), "hit_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside shared runs), hit_items (ids as sorted strings)
    and hit_spans (merged runs, in words).

    Null and empty texts, and those without a word, have no words and no hits; items without
    words occur nowhere; items with a null id match but are named "". Repeated items are
    named once. An empty benchmark gives no hits. A column of docs that has a result's name is
    replaced. With more than one block the rows pass through Python once for each block, and
    each row's results of all blocks are merged in place, so rows never have to be matched up.
    """
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    out = docs
    for n in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == n)
        #: at most about block_bytes of text, which is what is collected and sent to the tasks
        rows = [(r["i"], r["t"]) for r in part.collect()]
        packed = docs.sparkSession.sparkContext.broadcast(rows)
        out = tx.with_results(out, _worker(packed, text, window, gram, merge=n > 0), RESULT)
    return out


def _worker(packed, text: str, window: int, gram: int, merge: bool):
    compiled: list[Items] = []  # one for each task

    def work(batch: pa.RecordBatch) -> dict:
        if not compiled:
            compiled.append(Items(packed.value, window, gram))
        got = _match_batch(batch.column(batch.schema.get_field_index(text)), compiled[0])
        return _merged(batch, got) if merge else got

    return work


def _merged(batch: pa.RecordBatch, got: dict) -> dict:
    """The results of an earlier block, which the batch has, joined with those of this one."""
    before = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("hit_items", "hit_spans")}
    names = [sorted({*a, *b}) for a, b in zip(before["hit_items"], got["hit_items"].to_pylist())]
    spans = []
    for a, b in zip(before["hit_spans"], got["hit_spans"].to_pylist()):
        merged: list[dict] = []
        for x in sorted(a + b, key=lambda x: (x["start"], x["end"])):
            if merged and x["start"] <= merged[-1]["end"]:
                merged[-1]["end"] = max(merged[-1]["end"], x["end"])
            else:
                merged.append(dict(x))
        spans.append(merged)
    hit = [sum(x["end"] - x["start"] for x in row) for row in spans]
    return {"n_words": got["n_words"], "n_hit": pa.array(hit, pa.int64()), "hit_items": pa.array(names, pa.list_(pa.string())), "hit_spans": pa.array(spans, got["hit_spans"].type)}
