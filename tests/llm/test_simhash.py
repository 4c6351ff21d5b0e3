import random
import re

import pytest
import xxhash

from folioscope.llm import simhash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    prints = sorted({fp for _, fp in rows})
    parent = {fp: fp for fp in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for doc, fp in rows:
        if doc is not None:
            least[find(fp)] = min(doc, least.get(find(fp), doc))
    return sorted((doc if doc is not None else -1, fp, least.get(find(fp), -1)) for doc, fp in rows)


def test_fingerprint():
    r = random.Random(3)
    for text in [None, "", "  \n", "One", "One two", "A b C d é x", *(" ".join(r.choice("abcdefg") for _ in range(n)) for n in (3, 4, 50, 9000))]:
        assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("crowded", [1, 64])
def test_components(spark, crowded):
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(5)] + [0, (1 << 64) - 1]
    rows = []
    for i in range(300):
        fp = r.choice(seeds)
        for _ in range(r.randint(0, 4)):
            fp ^= 1 << r.randint(0, 63)
        rows.append((i, fp))
    signed = [(d, fp - (1 << 64) if fp >> 63 else fp) for d, fp in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    roots = {x.node: x.root for x in simhash.components(simhash.links(df.select("fp").distinct(), 2, crowded)).collect()}
    groups = {}
    for d, fp in signed:
        groups.setdefault(roots.get(fp, fp), []).append(d)
    got = sorted((d, dict(rows)[d], min(g)) for g in groups.values() for d in g)
    assert got == brute_components(rows)


def test_whole_table(spark, data):
    from folioscope.llm import queries as q

    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in q.op4_simhash_dedup(spark, data).collect())
    assert got == brute_components(docs)


def test_odd_rows(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None), (None, ""), (8, None), (1, "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, root int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == brute_components([(d, brute_print(t)) for d, t in rows])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
