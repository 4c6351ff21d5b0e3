"""The other corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import io
import itertools
import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, langid, mixing, quality, tokens, topk, warc
from folioscope.llm import queries as q
from folioscope.llm import text as tx

DOC = "doc_id long, text string, n_tokens int, h string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(doc, items, window=10):
    w, hit, names = words(doc), set(), set()
    for name, text in items:
        own = words(text)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(name)
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontaminate(spark, block_bytes):
    r = random.Random(1)
    vocabulary = ["a", "Bé", "c7", "日", "e"]
    text = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(str(i), text(r.choice([0, 1, 3, 12, 20, 25]))) for i in range(20)] + [("x", None)]
    docs = [(i, r.choice([text(40), text(5) + " " + (r.choice(items)[1] or "") + " " + text(9), "", " ", None])) for i in range(60)] + [(None, items[3][1]), (7, items[4][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.decontaminate(spark.createDataFrame([(*d, 1, "y") for d in docs], DOC), bench, block_bytes=block_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.hit_items) for x in got), key=key) == sorted(((d, *brute_hits(t, items)) for d, t in docs), key=key)
    assert all(x.n_hit == sum(s.end - s.start for s in x.hit_spans) for x in got)
    #: repeated words and windows, long texts, an empty table, columns with names of results
    odd = [(1, "a " * 20_000), (2, "z " * 9 + "q w " * 30), (3, "b"), (3, "b")]
    known = [("r", "a " * 400), ("s", "q w " * 12), ("r", "a " * 400), ("t", "b b")]
    clash = spark.createDataFrame([(*d, 7, "mine") for d in odd], "doc_id long, text string, n_hit int, hit_items string")
    got = decontaminate.decontaminate(clash, spark.createDataFrame(known, "item_id string, text string"), block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n_words, x.n_hit, x.hit_items) for x in got] == [(d, *brute_hits(t, known)) for d, t in odd]
    assert decontaminate.decontaminate(clash.limit(0), bench).count() == 0
    none = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0))
    assert {x.n_hit for x in none.collect()} == {0}


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load(q.tokenizer_path("byte_bpe_50k.json"))


def test_token_counts(spark, data, tokenizer):
    odd = [None, "", " ", "a", "a  b", " a b ", "x \ny", "<|endoftext|> b<|endoftext|>", "it 's", "é日本 🙂", "a," * 50, "z" * 3000, "　a b  c"]
    texts = odd + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 5, "h") for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, q.tokenizer_path("byte_bpe_50k.json"), chunk=700, overlap=40).collect()}
    assert got == {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts)}
    again = spark.createDataFrame([(None, "a b", 5, "h"), (None, "a b", 6, "h"), (1, "x" * 90_000 + " y " * 20_000, 5, None)], DOC)
    assert sorted(r.n_tokens for r in tokens.count_tokens(again, q.tokenizer_path("byte_bpe_50k.json")).collect()) == sorted(len(tokenizer.encode(r.text, add_special_tokens=False)) for r in again.collect())
    assert tokens.count_tokens(again.limit(0), q.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_long_texts_are_spliced(tokenizer):
    r = random.Random(2)
    for _ in range(30):
        text = "".join(r.choice([" ", "a", "bc", "\n", "é", "  ", "!!", "aaaa", "<|endoftext|>", "12"]) for _ in range(r.randint(1, 1500)))
        assert tokens.count_long(tokenizer, text, 150, 12) == len(tokenizer.encode(text, add_special_tokens=False))
    for text in ("a" * 4000, " " * 4000, "ab" * 2000 + " x"):
        assert tokens.count_long(tokenizer, text, 300, 20) == len(tokenizer.encode(text, add_special_tokens=False))


def brute_top(rows, k, every):
    out = []
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in {(i, tuple(v)): (i, v) for i, v in ok}.values():
        if i % every == 0:
            found = sorted((-int(v @ w), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(8192, 1024), (30, 3)])
def test_top_k(spark, shard, block):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8).round(1)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, []), (2200, [0.5] * 4), (2201, [0.25] * 4), (None, [1.0] * 8), rows[5], *[(3000, [9.0] * 8)] * 3]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, 5, 50, shard_rows=shard, block_rows=block).collect())
    assert got == brute_top(rows, 5, 50)
    assert topk.top_k(df.limit(0)).count() == 0


def test_cover_tree_covers():
    points = np.random.default_rng(4).normal(size=(500, 5))
    stack = [topk.cover_tree(points, leaf=4)]
    while stack:
        node = stack.pop()
        assert np.sqrt(((points[node.rows] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        assert not node.children or sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        stack += node.children


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "u1", big), (9, "u9", big), (5, None, big), (2, "u2", "x"), (3, "u3", "x"), (4, "u4", None), (6, "u6", ""), (None, "n", big), (9, "u9", big), (7, "r\r\nx", "<p>\r\n\r\n</p>" * 200)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    packages = warc.write_packages(df, str(tmp_path / "out"), package_bytes=400)
    assert packages.count() > 1
    got = warc.read_packages(packages).collect()
    assert len(got) == len(pages)
    text = {r.page_id: bytes(r.payload) for r in got if r.payload is not None}
    for p, _, html in pages:
        raw = (html or "").encode()
        r = next(x for x in got if x.page_id == p)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        expected = ("revisit", 9) if html == big and p != 9 else ("response", None)
        assert (r.record_type, r.refers_to) == expected
        assert (r.payload is None) == (expected[0] == "revisit") and text[r.refers_to or p] == raw
    assert warc.read_packages(packages).rdd.getNumPartitions() == packages.count()
    assert warc.read_packages(warc.write_packages(df.limit(0), str(tmp_path / "none"))).count() == 0
    large = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000), (3, None, "y" * 999)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_packages(warc.write_packages(large), payloads=False).collect())
    assert got == [(1, 3_000_000, "revisit", 2), (2, 3_000_000, "response", None), (3, 999, "response", None)]


@pytest.mark.parametrize("zip64", [True, False])
def test_packages_are_zip_files(zip64):
    w = warc.PackageWriter()
    for i in range(20):
        w.add(i, warc.record(i, "u", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None, False))
    raw = w.package(zip64)
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    source = pa.PythonFile(io.BytesIO(raw), mode="r")
    reader = warc.PackageReader(source)
    assert [r.payload for r in reader.records()] == [b"p" * i for i in range(20)]
    assert reader.record(reader.data_start(warc.DATA), reader.index()[7]).page_id == 7
    with pytest.raises(ValueError):
        warc.PackageReader(pa.PythonFile(io.BytesIO(raw[:-30]), mode="r"))


def test_language_model():
    pieces = {"▁": (0.1,), "▁a": (0.2,), "a": (0.3,), "b": (0.25,), "ab": (0.15,)}
    model = langid.Model(["x"], pieces, [0.0])

    def brute(word):
        marked, total = "▁" + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(marked[at:i])
                    at = i
            parts.append(marked[at:])
            p = 1.0
            for s in parts:
                p *= pieces[s][0] if s in pieces else langid.UNKNOWN if len(s) == 1 else 0.0
            total += p
        return total

    for word in ("a", "ab", "aab", "bab", "zb", "abababa"):
        assert np.isclose(model.score(word)[0], np.log(brute(word)))
    assert np.isfinite(model.score("q" * 500)[0])
    some = ["a", "ab", "zb", "b" * 39, "q" * 30, "q" * 300, "abababa", "é"]
    assert np.allclose(model.score_many(some)[:, 0], [model.score(w)[0] for w in some])
    names = list(pieces)

    def brute_counts(word):
        marked, out, total = "▁" + word, dict.fromkeys(names, 0.0), 0.0
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(marked)]
            parts = [marked[a:b] for a, b in zip(at, at[1:])]
            p = np.prod([pieces[s][0] if s in pieces else langid.UNKNOWN if len(s) == 1 else 0.0 for s in parts])
            total += p
            for s in parts:
                if s in out:
                    out[s] += p
        return np.array([out[n] / total for n in names])

    several = ["ab", "aab", "zb", "abab"]
    assert np.allclose(model.expected(several, [2, 1, 5, 3], 0), sum(n * brute_counts(w) for w, n in zip(several, [2, 1, 5, 3])))
    #: long words, and those of letters that no piece has, are counted in logarithms
    alone = np.zeros(len(model.table))
    model._expected_long("aab", 1, model.table[:, 0], alone)
    assert np.allclose(alone[: len(names)], brute_counts("aab"))
    assert np.isclose(model.expected(["q" * 39 + "ab"], [1], 0)[names.index("▁")], 1.0)
    assert np.isclose(sum(len(p) * c for p, c in zip(names, model.expected(["ab" * 300], [1], 0))), 601)


def test_samples_are_bounded_at_any_size():
    for total in (10, 10**6, 10**11, 10**15):
        limit = tx.hash_limit(8000, total)
        assert -(1 << 63) < limit < 1 << 63
        assert np.isclose((limit + (1 << 63) + 1) / (1 << 64) * total, min(8000, total), rtol=1e-3)
    assert langid.shares({"a": 5, "b": 10**11, "c": 10**12}, 1005) == {"a": 5, "b": 500, "c": 500}


def test_languages_held_out(spark, data):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = q.op7_language(spark, data).collect()
    assert len(got) == len(docs)
    own = [r for r in got if r.held_out and docs[r.doc_id]]
    assert own and sum(r.lang_pred == docs[r.doc_id] for r in own) / len(own) > 0.9
    assert all(0 <= r.score <= 1 for r in got)
    model = langid.Model(["de", "en"], {"▁": (0.5, 0.5), "a": (0.1, 0.2), "b": (0.2, 0.1)}, [0.0, 0.0])
    odd = spark.createDataFrame([(1, None, 1, "x"), (2, "12 !!", 1, "x"), (3, "aaaa", 1, "x"), (4, "bbb", 1, "x"), (5, "ab", 1, "x")], DOC)
    assert [r.lang_pred for r in langid.predict(odd, model).orderBy("doc_id").collect()] == ["und", "und", "en", "de", "de"]
    #: repeated and very long texts, an empty table, columns with names of results
    rows = [(1, "aaaa", "x", 5), (1, "aaaa", None, 6), (None, "bbb " * 200_000, "y", 7), (4, "ab" * 5_000 + " 日本", "z", 8)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score int")
    got = langid.predict(clash, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (1, "en"), (None, "de"), (4, "de")] and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(clash.limit(0), model).count() == 0
    assert langid.fit(clash.select("doc_id", "text", F.lit("x").alias("lang")), ["a", "b", "ab"]).languages == ["x"]
    empty = langid.fit(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")), ["a"])
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_labellers_are_estimated():
    r = np.random.default_rng(5)
    truth = r.random(4000) < 0.2
    right = [0.95, 0.8, 0.7, 0.6]
    votes = np.column_stack([np.where(r.random(4000) < 0.2, -1, np.where(r.random(4000) < a, truth, ~truth)) for a in right]).astype(np.int8)
    p, rates = quality.posteriors(votes)
    assert ((p > 0.5) == truth).mean() > 0.93
    assert rates[0, 1] > rates[2, 1] and rates[0, 0] < rates[2, 0]
    #: one labeller is wrong more often than right, and is found out
    right = [0.95, 0.85, 0.8, 0.3]
    votes = np.column_stack([np.where(r.random(4000) < a, truth, ~truth) for a in right]).astype(np.int8)
    p, rates = quality.posteriors(votes)
    assert ((p > 0.5) == truth).mean() > 0.95
    assert np.allclose(rates[:, 1], right, atol=0.06) and np.allclose(1 - rates[:, 0], right, atol=0.06)


def test_toxic_labellers_vote_both_ways():
    texts = ["the cat is in the house and it is warm", "the idiot is in the house and it is warm", "der Hund und die Katze", "du bist ein Trottel und das ist so", "zzz qqq xxx", "i will kill the man and it is so", ""]
    measures = np.concatenate([m for m, _, _ in quality.describe(pa.array(texts))])
    assert quality.votes(measures, quality.TOXIC).tolist() == [[0, -1, 0], [1, -1, 0], [-1, 0, 0], [-1, 1, 0], [-1, -1, -1], [0, -1, 1], [-1, -1, -1]]


def test_quality(spark, data):
    data = data.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect()]
    clean = [r for r in held if r.quality == 1 and r.toxic == 0]
    assert sum(got[r.doc_id].keep for r in clean) / len(clean) > 0.98
    for bad in ([r for r in held if r.quality == 0], [r for r in held if r.toxic]):
        assert sum(not got[r.doc_id].keep for r in bad) / len(bad) > 0.9
    odd = spark.createDataFrame([(1, None, 1, "x"), (2, "", 1, "x"), (3, "  ", 1, "x"), (None, "a b", 1, "x")], DOC)
    assert [r.keep for r in quality.classify(odd, model).where("doc_id < 4").collect()] == [True] * 3
    #: very long and repeated texts score by themselves, as they do alone and together
    one = "the and of it " * 3
    long = spark.createDataFrame([(1, one, 0.5, "x"), (1, one, 0.5, "y"), (2, one * 60_000, 0.5, "z"), (3, one, 0.5, None)], "doc_id long, text string, junk double, keep string")
    scored = quality.classify(long, model).collect()
    assert [r.doc_id for r in scored] == [1, 1, 2, 3] and scored[0].junk == scored[1].junk == scored[3].junk
    assert all(isinstance(r.keep, bool) and 0 <= r.junk <= 1 for r in scored)
    assert quality.classify(long, quality.fit(long)).count() == 4
    assert quality.classify(odd.limit(0), model).count() == 0
    assert quality.classify(odd, quality.fit(odd)).count() == 4
    assert quality.classify(odd, quality.fit(odd, labels.limit(0))).count() == 4


def test_mix(spark):
    r = random.Random(6)
    rows = [(i if r.random() < 0.95 else None, r.choice([None, "", " ", "w " * r.randint(1, 40), "w"]), r.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(800)] + [(5, "w w", "a", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    weights = dict(zip(sorted(s for s in size if s) + [None], (3, 1, 2, 3)))
    total, level = 1.5 * sum(size.values()), 0.0
    lo, hi = 0.0, total
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * size[s], weights[s] * level) for s in size) < total else (lo, level)
    for s in size:
        own = [x for x in got if x.source == s]
        assert {x.source_size for x in own} == {size[s]}
        assert all(abs(x.target - min(2 * size[s], weights[s] * level)) < 1e-3 for x in own)
        assert abs(sum(x.taken for x in own) - own[0].target) <= 120
    assert all(x.taken == x.size * x.copies and 0 <= x.copies <= 2 for x in got)
    again = mixing.mix_sources(df.repartition(7)).collect()
    order = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, again), key=order)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    #: one very long text, and a source that has nothing but empty ones
    long = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w " * 10, "b"), (3, "", "c"), (4, None, "c")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.size, r.taken) for r in mixing.mix_sources(long).collect()} == {1: (300_000, 300_000), 2: (10, 20), 3: (0, 0), 4: (0, 0)}


def test_mix_takes_no_python(spark, data):
    plan = q.op10_mix_sources(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, data, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    names = [n for n, _ in pipeline.STAGES]
    out = []
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        out.append(docs.collect())
        if n < len(names) - 1:
            assert docs.columns == spark.read.parquet(f"{data}/documents.parquet").columns
    judged, single, cut, clean, mixed = out
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r.doc_id for r in judged}
    assert all(d in kept for d, r in labels.items() if r.quality == 1 and not r.toxic and rows[d].text)
    from tests.llm.test_near_texts import brute_least
    from tests.llm.test_repeats import brute_bytes

    judged = sorted(judged, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in single) == [judged[i].doc_id for i in brute_least([r.text for r in judged])]
    want = {d: raw.decode(errors="ignore") for d, _, _, raw in brute_bytes([(r.doc_id, r.text) for r in single], 200)}
    assert {r.doc_id: r.text for r in cut} == want
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in cut if not brute_hits(r.text, items)[1])
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean}


def test_pipeline_on_odd_rows(spark, data):
    """Nulls, empty and equal texts, repeated and null ids, and columns with the names of results."""
    pipeline = pytest.importorskip("corpus_pipeline")
    line = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, line, "a"), (1, other, "a"), (None, line + " x", "b"), (None, None, "b"), (4, "", None), (5, "  ", "c"), (6, line, "a"), (6, line, "a"), (None, "alone here", "b")]
    kind = "doc_id long, text string, source string, junk string, keep int, n_hit string, n_words long, _t int, root string"
    docs = spark.createDataFrame([(*r, "mine", 7, "own", 8, 9, "r") for r in rows], kind)
    shown = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), data).count() == 0, name
        assert {(r.junk, r.keep, r.n_hit, r.n_words, r["_t"], r.root) for r in out.collect()} == {("mine", 7, "own", 8, 9, "r")}
    single = shown(pipeline.near_dedup(spark, docs, data))
    assert single == sorted([(1, line, "a"), (1, other, "a"), (4, "", None), (None, "alone here", "b")], key=str)
    mixed = pipeline.mixing_sources(spark, docs, data).collect()
    assert mixed and pipeline.mixing_sources(spark, docs.limit(0), data).count() == 0
