"""Substring dedup with repeated-phrase automata.

Runs of words that occur in several documents are confirmed and joined to passages (runs that
the same areas share); the passages of a family are compiled into Aho-Corasick automata, one
for each bundle of families, and the words of all areas are streamed through the automaton of
their bundle, which locates every occurrence word for word. Families are dealt to tasks by
hash, so the automata are sharded and none grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm import text as tx
from folioscope.llm.repeats import Units, finish, merge_spans, number_rows, repeated_runs

WORDS, GRAM = 50, 8


def passages(words: list[np.ndarray], first: np.ndarray, runs: np.ndarray, length: int) -> dict[tuple[int, ...], int]:
    """The passages that at least two areas share, with the least document that has each.

    words: each area's words as numbers; a run of an area starts at one of its first `runs`."""
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)
    base = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(words)), runs)
    at = base[which] + np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
    run = tx.span_hash(tx.prefix_hash(tx.mix(flat.astype(np.uint64))), at, at + length)
    _, number = np.unique(run, return_inverse=True)
    members, least = np.zeros(number.max() + 1 if len(number) else 0, np.uint64), np.full(number.max() + 1 if len(number) else 0, (1 << 63) - 1)
    np.add.at(members, number, tx.mix(which.astype(np.uint64)))
    np.minimum.at(least, number, first[which])
    several = np.bincount(number)[number] > 1
    who = members[number]
    turn = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (who[1:] != who[:-1])]))
    out: dict[tuple[int, ...], int] = {}
    for a, b in zip(turn.tolist(), (np.concatenate([turn[1:], [len(which)]]) - 1).tolist()):
        if several[a]:
            key = tuple(flat[at[a] : at[b] + length].tolist())
            out[key] = min(out.get(key, 1 << 63), int(least[number[a]]))
    return out


def examine(length: int):
    def work(rows: list[dict]) -> list[list[dict]]:
        numbers: dict[bytes, int] = {}
        words = []
        for r in rows:
            data = np.frombuffer(r["area"], np.uint8)
            start, end, _ = tx.word_bounds(data, np.array([0, len(data)]), tx.NOT_SPACE)
            words.append(np.array([numbers.setdefault(r["area"][s:e], len(numbers)) for s, e in zip(start.tolist(), end.tolist())]))
        first, runs = np.array([r["first"] for r in rows]), np.array([r["n"] for r in rows])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, least in passages(words, first, runs, length).items():
            automaton.add_word(key, (len(key), least))
        if len(automaton):
            automaton.make_automaton()
        out = []
        for r, own in zip(rows, words):
            least = np.full(r["n"], r["first"])
            if len(automaton):
                for end, (size, doc) in automaton.iter(tuple(own.tolist())):
                    a = end - size + 1
                    np.minimum(least[a : a + size - length + 1], doc, out=least[a : a + size - length + 1])
            turn = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])).tolist()
            out.append([{"a": a, "b": b - 1, "first": int(least[a]), "again": None} for a, b in zip(turn, [*turn[1:], r["n"]])])
        return out

    return work


RESULT = [("text", "string"), ("kept", "string"), ("n_words", "long"), ("n_removed", "long"), ("removed", "array<struct<start:int,end:int>>")]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        data, offsets = tx.buffers(batch.column("text"))
        start, end, first = tx.word_bounds(data, offsets, tx.NOT_SPACE)
        kept, cut, gone = [], [], []
        for row, own in enumerate(spans):
            merged = merge_spans(own)
            stays = np.ones(first[row + 1] - first[row], bool)
            for s, e in merged:
                stays[s:e] = False
            raw, at = data[offsets[row] : offsets[row + 1]].tobytes(), offsets[row]
            here = np.flatnonzero(stays) + first[row]
            kept.append(b" ".join([raw[a:b] for a, b in zip((start[here] - at).tolist(), (end[here] - at).tolist())]).decode())
            cut.append([{"start": s, "end": e} for s, e in merged])
            gone.append(int(len(stays) - stays.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(kept, pa.string()), pa.array(np.diff(first)), pa.array(gone, pa.int64()), pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["row", "text", "kept", "n_words", "n_removed", "removed"])


def dedup_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, text, kept (the words that stay, joined by spaces),
    n_words, n_removed and removed (spans of words that go: those of passages of `words` words
    or more that an earlier document has too).

    Earlier means a smaller id; a null id is later than all others, and rows with the same id
    don't remove from each other. Null, empty and shorter texts stay as they are. Other columns
    have no part in it; with `carry` they come back, as they are, in a struct `rest`.
    """
    rows = number_rows(docs, doc_id, text, carry)
    spans = repeated_runs(rows, Units(words, gram, words=True), True, examine(words))
    return finish(rows, spans, _cut, RESULT)
