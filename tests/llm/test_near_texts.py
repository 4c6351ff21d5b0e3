import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline
from folioscope.llm import simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = grams(a), grams(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def changed(r, text, n):
    """The text with n words changed."""
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"Z{r.random()}"
    return " ".join(w)


def corpus(r):
    line = " ".join(f"common{i}" for i in range(40))
    texts = [None, "", " ", "one", "One", "a b c d", "a b c e"]
    for size in (30, 100, 100, 400, 900):
        base = " ".join(f"w{r.randint(0, 50000)}" for _ in range(size))
        texts += [base, base.upper()] + [changed(r, base, n) for n in (0, 1, 2, 3, 4, 5, 8, 12, 20, 28) if n < size // 4]
    base = texts[-1]
    texts += [changed(r, base, 1) for _ in range(60)]
    texts += [line + " " + " ".join(f"v{r.randint(0, 50000)}" for _ in range(60)) for _ in range(60)]
    r.shuffle(texts)
    return texts


def brute_least(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if a == texts[j] or alike(a, texts[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted({find(i) for i in range(len(texts))})


@pytest.mark.parametrize("placed", [3, 2048])
def test_stage_finds_all_pairs(spark, monkeypatch, placed):
    monkeypatch.setattr(simhash, "PLACED", placed)
    texts = corpus(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute_least(texts)


def test_near_copies_between_0_8_and_0_97(spark):
    r = random.Random(6)
    pairs = []
    while len(pairs) < 30:
        base = " ".join(f"w{r.randint(0, 50000)}" for _ in range(200))
        copy = changed(r, base, r.randint(1, 5))
        x, y = grams(base), grams(copy)
        if 0.8 <= len(x & y) / len(x | y) <= 0.97:
            pairs.append((base, copy))
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [2 * i for i in range(30)]


def test_a_group_of_near_copies_needs_few_comparisons(spark, monkeypatch):
    r = random.Random(7)
    base = " ".join(f"w{r.randint(0, 50000)}" for _ in range(140))
    texts = [changed(r, base, 4) for _ in range(300)]
    texts += [changed(r, t, 1) for t in texts[:20]]
    compared, real = [], DataFrame.mapInArrow

    def counted(df, *args, **kw):
        if df.columns == ["a", "b", "x", "y"]:
            compared.append(df.count())
        return real(df, *args, **kw)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    print("compared", compared)
    assert set(range(300)) & set(kept) == set(kept) and len(kept) >= 290
    assert 0 < sum(compared) < 3000
