import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import suffixes
from folioscope.llm import text as tx
from folioscope.llm.phrases import dedup_phrases
from folioscope.llm.repeats import number_rows
from folioscope.llm.suffixes import dedup_substrings, two_stage_order

SCHEMA = "doc_id long, text string, h string, rid int"


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.integers(0, 2**32))
def test_two_stage_order(raw, seed):
    raw = bytes(b % 3 for b in raw)
    data = np.frombuffer(raw, np.uint8)
    starts = np.array(sorted(random.Random(seed).sample(range(len(raw)), random.Random(seed).randint(1, len(raw)))))
    got = two_stage_order(data, starts, 128).tolist()
    assert got == sorted(starts.tolist(), key=lambda i: raw[i:])


def brute_bytes(rows, length):
    seen = defaultdict(int)
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] += 1
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = set()
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append((doc, len(raw), len(gone), bytes(b for i, b in enumerate(raw) if i not in gone)))
    return out


def brute_words(rows, length):
    import re

    first = {}
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    key = lambda d: (1 << 63) - 1 if d is None else d
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            first[g] = min(first.get(g, 1 << 63), key(doc))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < key(doc):
                gone.update(range(i, i + length))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def fixture_rows(seed):
    r = random.Random(seed)
    vocabulary = ["alpha", "bé", "c", "dd", "日本"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(6)]
    rows = [(None, None), (3, ""), (3, "   "), (5, None)]
    for i in range(40):
        t = r.choice(base)
        cut = r.randint(0, len(t))
        text = r.choice([t, t[:cut] + "X" + t[cut:], t[cut:] + " " + r.choice(base), "a" * r.randint(0, 90), "ab " * r.randint(0, 40)])
        rows.append((r.choice([i, i, 7, None]), text))
    return rows


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))


@pytest.mark.parametrize("crowded", [1, 192])
def test_substrings(spark, crowded, monkeypatch):
    rows = fixture_rows(1)
    monkeypatch.setattr(suffixes.repeated_runs, "__defaults__", (crowded,))
    got = dedup_substrings(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), length=20, gram=6)
    assert ordered((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got.collect()) == ordered(brute_bytes(rows, 20))


@pytest.mark.parametrize("crowded", [1, 192])
def test_phrases(spark, crowded, monkeypatch):
    rows = fixture_rows(2)
    monkeypatch.setattr(suffixes.repeated_runs, "__defaults__", (crowded,))
    got = dedup_phrases(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), words=8, gram=3)
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in got.collect()) == ordered(brute_words(rows, 8))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(empty).count() == 0
    assert dedup_phrases(empty).count() == 0


def test_whole_tables(spark, data):
    from folioscope.llm import queries as q

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in q.op8_phrase_dedup(spark, data).collect())
    assert got == sorted((d, n, g, sha(k)) for d, n, g, k in brute_words(docs, 50))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in q.op9_suffix_dedup(spark, data).collect())
    assert got == sorted((d, n, g, sha(k)) for d, n, g, k in brute_bytes(docs, 200))


def test_rows_keep_their_numbers_when_split_anew(spark, tmp_path):
    rows = fixture_rows(3)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    numbered = [{(r.row.doc_id, r.text): r.rid for r in number_rows(x, "doc_id", "text", False).collect()} for x in (docs, docs.repartition(3), docs.coalesce(1))]
    assert numbered[0] == numbered[1] == numbered[2]


@pytest.mark.parametrize("crowded", [1, 192])
def test_equal_rows(spark, crowded, monkeypatch):
    rows = [x for x in fixture_rows(4) for _ in range(2)]
    monkeypatch.setattr(suffixes.repeated_runs, "__defaults__", (crowded,))
    df = spark.createDataFrame([(*r, str(i), 1) for i, r in enumerate(rows)], SCHEMA)
    got = dedup_substrings(df, length=20, gram=6)
    assert ordered((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got.collect()) == ordered(brute_bytes(rows, 20))
    got = dedup_phrases(df, words=8, gram=3)
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in got.collect()) == ordered(brute_words(rows, 8))
    carried = dedup_substrings(df, length=20, gram=6, carry=True)
    assert sorted(int(r.rest.h) for r in carried.collect()) == list(range(len(rows)))


def test_rows_keep_their_repeats_when_split_anew(spark, tmp_path):
    """The input is split otherwise after the candidates are written than before."""
    rows = [(i, t) for i, (_, t) in enumerate(fixture_rows(5))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    try:
        planned = dedup_substrings(docs, length=20, gram=6), dedup_phrases(docs, words=8, gram=3)
        before = docs.rdd.getNumPartitions()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "3k")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
        assert spark.read.parquet(f"{tmp_path}/d").rdd.getNumPartitions() > before
        got = [ordered((r.doc_id, r[i], r.n_removed, bytes(r.kept) if i == "n_bytes" else r.kept.encode()) for r in p.collect()) for p, i in zip(planned, ("n_bytes", "n_words"))]
    finally:
        for name in ("files.maxPartitionBytes", "files.openCostInBytes", "leafNodeDefaultParallelism"):
            spark.conf.unset(f"spark.sql.{name}")
    assert got == [ordered(brute_bytes(rows, 20)), ordered(brute_words(rows, 8))]


def test_texts_longer_than_a_slice(spark):
    """Each text is worked on in a slice of its own size; what they share is found wherever it is."""
    r = random.Random(6)
    some = lambda n: " ".join(f"{r.getrandbits(40):x}" for _ in range(n))
    shared = some(60)
    rows = [(1, some(60_000) + " " + shared + " " + some(5)), (2, shared), (3, some(90_000) + " " + shared)]
    assert min(len(rows[0][1]), len(rows[2][1])) > tx.SLICE_BYTES
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA)
    assert [(x.doc_id, x.n_removed) for x in dedup_phrases(df).orderBy("doc_id").collect()] == [(1, 0), (2, 60), (3, 60)]
    got = {x.doc_id: x for x in dedup_substrings(df).collect()}
    assert all(shared.encode() not in bytes(x.kept) and len(shared) <= x.n_removed <= len(shared) + 2 for x in got.values())


def test_suffix_order_and_prefixes_by_words_are_those_by_bytes():
    """Eight bytes at a time, on strings that are tied for long or end early; and in few reads of each byte."""
    rng = np.random.default_rng(3)
    for n, letters, depth in ((1, 1, 24), (60, 1, 40), (300, 2, 24), (700, 2, 200), (900, 256, 13), (900, 3, 21)):
        block = rng.integers(0, letters, n).astype(np.uint8)
        data = np.concatenate([block, block, rng.integers(0, letters, 5).astype(np.uint8), block[: n // 2]])
        raw = data.tobytes()
        starts = np.flatnonzero(rng.random(len(data)) < 0.7)
        order = suffixes.two_stage_order(data, starts, depth)
        assert sorted(order.tolist()) == starts.tolist()
        heads = [raw[i : i + depth] for i in order.tolist()]
        assert all(x.ljust(depth, b"\0") <= y.ljust(depth, b"\0") for x, y in zip(heads, heads[1:]))
        alike = [0] + [next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) for x, y in zip(heads, heads[1:])]
        assert suffixes.common_prefixes(data, order, depth).tolist() == alike[: len(order)]
