"""SimHash near-dedup with multi-index hashing.

A fingerprint of 64 bits is the majority vote of the hashes of a text's word shingles. Two
fingerprints that differ in at most DISTANCE bits differ in at most half of those in one of
two segments. So each segment has a table of all fingerprints by its value, and each
fingerprint looks up the small Hamming ball around its own value; what a table returns is
verified over all 64 bits. Only distinct fingerprints are indexed.

A segment value that very many fingerprints share would return a number of pairs that grows
with its square. Such crowded values are left out of the tables, and all fingerprints that
are in one, or that look one up, are linked by the other form of the same condition: two are
within 2r bits when the balls of radius r around them meet. Each goes to the values in its own
ball, which names a link for each of the meeting places instead of one for each pair.

Links become components by stars (see operators/graph.py).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import text as tx
from folioscope.llm.storage import shared_folder
from folioscope.operators.graph import components

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Fingerprints of one segment value that are compared one by one.
CROWDED = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Null and texts without a word: 0."""
    words = _WORD.findall((text or "").encode().translate(_UPPER))
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(lengths + 1) - lengths - 1
    n = max(1, len(words) - shingle + 1)
    end = (start + lengths)[min(shingle, len(words)) - 1 :]
    #: shingles are pieces of the joined line; bits are counted a block at a time
    ones = np.zeros(64, np.int64)
    starts, ends, digest = start[:n].tolist(), end.tolist(), xxhash.xxh64_intdigest
    for at in range(0, n, 4096):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + 4096], ends[at : at + 4096])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "fp"])

    return run


def _masks(bits: range, most: int) -> list[int]:
    """Numbers with up to `most` of the given bits set, as signed 64-bit integers."""
    out = [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(bits, n)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _around(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough of them for all components of
    "differs in at most `distance` bits"; b may be a meeting place that is nobody's own."""
    halves = [(0, range(0, 32), (1 << 32) - 1), (1, range(32, 64), ~((1 << 32) - 1))]
    tables, probes = [], []
    for part, bits, mask in halves:
        own = F.col("fp").bitwiseAND(F.lit(mask))
        tables.append(prints.select(F.lit(part).alias("part"), own.alias("key"), F.col("fp").alias("b")))
        probes.append(prints.select(F.lit(part).alias("part"), F.explode(_around(own, _masks(bits, distance // 2))).alias("key"), F.col("fp").alias("a")))
    table, probe = tables[0].unionAll(tables[1]), probes[0].unionAll(probes[1])
    sizes = table.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("b").alias("one"))
    #: Most values have one fingerprint: it comes with the value's count, without a second look.
    looked = probe.join(sizes, ["part", "key"]).where("n > 1 or a > one")
    lone = looked.where("n = 1").select("a", F.col("one").alias("b"))
    shared = sizes.where(f"n > 1 and n <= {crowded}").select("part", "key")
    some = looked.where(f"n > 1 and n <= {crowded}").select("part", "key", "a").join(table.join(shared, ["part", "key"]), ["part", "key"]).where("a > b").select("a", "b")
    near = lone.unionAll(some).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    many = looked.where(f"n > {crowded}").select("a").distinct()
    met = many.select("a", F.explode(_around(F.col("a"), _masks(range(64), distance // 2))).alias("b"))
    if distance % 2:
        raise ValueError("an even distance is needed: balls of half of it are looked up")
    places = met.groupBy("b").agg(F.min("a").alias("to"), F.count("*").alias("n")).where("n > 1").select("b", "to")
    return near.unionAll(met.join(places, "b").where("a <> to").select("a", F.col("to").alias("b")))


#: The wide form, for texts that are alike by their shingles: words of a shingle, 64-bit words of a
#: fingerprint, the similarity of two sets of shingles, and bits by which two sketches (the first
#: word of a fingerprint) of such sets may differ: 10 are expected at that similarity, 20 is beyond
#: three deviations.
WIDE_SHINGLE, WIDE_WORDS, SIMILARITY, SKETCH_BITS = 5, 12, (4, 5), 20
#: Numbers of texts that go to all tasks at most; more are joined by a shuffle.
SENT_TEXTS = 4_000_000
#: Words of a fingerprint whose places are met first. What they link and the shingles of the texts that
#: meet there say which pairs of the other words need no comparison.
FIRST_WORDS = 1
#: Texts whose places are made at a time, and the orders in which those of a place take the lead.
PLACED = 2048
_ORDERS = np.array([0, 0x5555555555555555, -0x3333333333333334, -0x5A5A5A5A5A5A5A5B], np.int64)


def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Hamming code of 31 bits, of which every value is at most one bit away. For each of the 32
    syndromes: what turns a value into the codewords within two bits of it, and how many they are;
    and the masks whose parities are the bits of the syndrome."""
    flips, count = np.zeros((32, 16), np.int64), np.full(32, 16)
    count[0] = 1
    for s in range(1, 32):
        flips[s] = [1 << s - 1, *(1 << i - 1 | 1 << (i ^ s) - 1 for i in range(1, 32) if i < i ^ s and i != s)]
    return flips, count, np.array([sum(1 << p - 1 for p in range(1, 32) if p >> j & 1) for j in range(5)])


_FLIPS, _FLIP_COUNT, _PARITY = _code()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the shingles of each text; a text of fewer words is one shingle."""
    for a, b in tx.slices(offsets):
        part = tx.LOWER[data[offsets[a] : offsets[b]]]
        start, end, first = tx.word_bounds(part, offsets[a : b + 1] - offsets[a], tx.NOT_SPACE)
        words = tx.word_hashes(part, start, end)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(tx.gram_hash(words[i:j], min(shingle, j - i))) if j > i else np.zeros(0, np.uint64)


def wide_prints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """The fingerprint of each set that isn't empty: a bit is the majority of that bit of all hashes."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), words), np.uint64)
    #: so many sets at a time that their bits stay small
    turn = np.flatnonzero(np.diff(np.cumsum(sizes) >> 17, prepend=0)).tolist() if len(sets) else []
    for a, b in zip([0, *turn], [*turn, len(sets)]):
        if a == b:
            continue
        flat = np.concatenate(sets[a:b])
        base = np.cumsum(sizes[a:b]) - sizes[a:b]
        #: bits are counted in bytes, eight at a time, so blocks of a set have at most 255 hashes
        blocks = -(-sizes[a:b] // 255)
        first = np.cumsum(blocks) - blocks
        block = np.repeat(base - 255 * first, blocks) + 255 * np.arange(blocks.sum())
        for w in range(words):
            bits = np.unpackbits(tx.mix(flat + np.uint64(w)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            some = np.add.reduceat(bits.view(np.uint64), block, axis=0).view(np.uint8)
            ones = np.add.reduceat(some, first, axis=0, dtype=np.int32)
            out[a:b, w] = np.packbits(ones * 2 > sizes[a:b, None], axis=1).view(">u8")[:, 0]
    return out


def places(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): where each fingerprint looks and is found. Each 31 bits are a segment; the codewords
    within two bits of its value are its places. Values that differ in at most two bits have a place
    in common: the codeword next to what is between them."""
    values = (prints.view(np.uint32) & np.uint32(0x7FFFFFFF)).astype(np.int64)
    syndrome = sum((np.bitwise_count(values & m) & 1).astype(np.int64) << j for j, m in enumerate(_PARITY))
    key = (values[:, :, None] ^ _FLIPS[syndrome]) | (np.arange(values.shape[1]) << 31)[None, :, None]
    used = np.arange(16) < _FLIP_COUNT[syndrome][:, :, None]
    return np.nonzero(used)[0], key[used]


def lead(key: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by key and turn: which lead, and the pairs (follower, leader) of the others. In
    each key the first row that follows nobody leads, and all whose sketches are near its own
    follow it; so a key has as many pairs as followers, however many they are."""
    head = np.concatenate([[True], key[1:] != key[:-1]])
    leads, pairs = np.ones(len(key), bool), []
    left = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    while len(left):
        k = key[left]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        near = ~new & (np.bitwise_count(sketch[left] ^ sketch[first]) <= most)
        pairs.append((left[near], first[near]))
        leads[left[near]] = False
        left = left[~near & ~new]
    follower, leader = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    return leads, follower, leader


def _place_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "t", "sketch", "apart", "sizes"])


def _turn() -> Column:
    """The order of the rows of a place (see _ORDERS), as Spark has it."""
    kind = F.col("key").bitwiseAND(F.lit(3))
    return F.col("t").bitwiseXOR(F.element_at(F.array(*[F.lit(int(x)) for x in _ORDERS]), (kind + 1).cast("int")))


def _open_pairs(follower: np.ndarray, leader: np.ndarray, t: np.ndarray, apart: np.ndarray, sizes: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows those that still need a comparison, as texts, each once, the larger first.

    Texts of one group don't, nor do those that can't be alike: two sets have no more in common than
    the smaller one has, and of two texts that met before no more than what either one shares with
    any text that met before."""
    root = t ^ apart
    size, shared = sizes >> 32, (sizes & 0xFFFFFFFF) - 1
    x, y = size[follower], size[leader]
    both = np.minimum(x, y)
    known = (shared[follower] >= 0) & (shared[leader] >= 0)
    both = np.where(known, np.minimum(both, np.minimum(shared[follower], shared[leader])), both)
    use = (root[follower] != root[leader]) & (similarity[1] * both >= similarity[0] * (x + y - both))
    return _different(t[follower[use]], t[leader[use]])


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of different texts once, the larger first."""
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _wide(shingle: int, words: int):
    """The number of shingles of each text that has a word, and its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = tx.buffers(batch.column("text"))
            known = {}
            for t, s in zip(batch.column("t").to_pylist(), shingle_sets(data, offsets, shingle)):
                if len(s):
                    known.setdefault(t, s)
                if len(known) == PLACED:
                    yield _wide_rows(known, words)
                    known = {}
            yield _wide_rows(known, words)

    return run


def _wide_rows(known: dict[int, np.ndarray], words: int) -> pa.RecordBatch:
    prints = [x.tobytes() for x in wide_prints(list(known.values()), words)] if known else []
    columns = pa.array(list(known), pa.int64()), pa.array([len(s) for s in known.values()], pa.int64()), pa.array(prints, pa.binary())
    return pa.RecordBatch.from_arrays(list(columns), names=["t", "size", "print"])


def _place(part: slice, words: int, most: int, similarity: tuple[int, int]):
    """The places that texts have by some words of their fingerprints. Those that meet within a batch
    are pairs already (rows of negative keys, which go by as they are), and only the leaders go on to
    meet those of other batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PLACED):
                batch = whole.slice(at, PLACED)
                t, apart, sizes = (batch.column(c).to_numpy() for c in ("t", "apart", "sizes"))
                prints = tx.buffers(batch.column("print"))[0].view(np.uint64).reshape(-1, words)
                row, key = places(np.ascontiguousarray(prints[:, part]))
                sketch = prints[row, 0].view(np.int64)
                order = np.lexsort((t[row] ^ _ORDERS[key & 3], key))
                leads, follower, leader = lead(key[order], sketch[order].view(np.uint64), most)
                a, b = _open_pairs(row[order[follower]], row[order[leader]], t, apart, sizes, similarity)
                #: text by text, which packs well
                leads = np.sort(order[leads])
                r = row[leads]
                yield _place_rows(key[leads], t[r], sketch[leads], apart[r], sizes[r])
                none = np.zeros(len(a), np.int64)
                yield _place_rows(-1 - (tx.mix(a.view(np.uint64)) >> np.uint64(2)).view(np.int64), a, b, none, none)

    return run


def _meet(most: int, similarity: tuple[int, int]):
    """Candidate pairs (a, b) of a partition of places that is sorted by key and turn; of a key that
    goes on in the next batch only the leaders are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            told = rows[0] < 0
            a, b = rows[1][told], rows[2][told]
            key, t, sketch, apart, sizes = rows = [x[~told] for x in rows]
            if len(key):
                leads, follower, leader = lead(key, sketch.view(np.uint64), most)
                last = leads & (key == key[-1])
                held = [x[last] for x in rows]
                more = _open_pairs(follower, leader, t, apart, sizes, similarity)
                a, b = _different(np.concatenate([a, more[0]]), np.concatenate([b, more[1]]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _shingles(shingle: int):
    """(h, t): the distinct shingles of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = batch.column("t").to_numpy()
                for i, s in enumerate(shingle_sets(*tx.buffers(batch.column("text")), shingle)):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), t[i]))], names=["h", "t"])

    return run


def _alike(shingle: int, similarity: tuple[int, int]):
    """Those of the pairs of texts whose sets of shingles have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (shingle_sets(*tx.buffers(batch.column(c)), shingle) for c in ("x", "y"))
                keep = []
                for m, n in zip(x, y):
                    both = len(np.intersect1d(m, n, assume_unique=True))
                    keep.append(similarity[1] * both >= similarity[0] * (len(m) + len(n) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar(texts: DataFrame, shingle: int = WIDE_SHINGLE, words: int = WIDE_WORDS, similarity: tuple[int, int] = SIMILARITY, most: int = SKETCH_BITS) -> DataFrame:
    """(a, b): pairs of texts (t, a number for each different text; text) whose sets of word shingles
    have at least the Jaccard similarity, which connect what such pairs connect.

    Fingerprints are wide, as two bits of 64 are far too few for that similarity: in one of their
    segments two of them differ in at most two bits, nearly always, and meet. Pairs that meet are
    verified by their whole texts. Texts without a word have no shingle and no pair.

    They meet in two rounds. The first has few places; what it links are groups, and shingles that
    only one of its texts has are counted. In the second, texts of one group and those whose own
    shingles are too many for the similarity make no pair, which takes nothing from the groups."""
    shared_folder(texts.sparkSession)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = texts.mapInArrow(_wide(shingle, words), "t long, size long, print binary").repartition(parts, "t").dropDuplicates(["t"]).checkpoint()

    def met(rows: DataFrame, part: slice) -> DataFrame:
        placed = rows.select("t", "apart", "sizes", "print").mapInArrow(_place(part, words, most, similarity), "key long, t long, sketch long, apart long, sizes long")
        return placed.repartition("key").sortWithinPartitions("key", _turn()).mapInArrow(_meet(most, similarity), "a long, b long").distinct().checkpoint()

    size = F.shiftleft("size", 32)
    pairs = met(prints.select("t", F.lit(0).cast("long").alias("apart"), size.alias("sizes"), "print"), slice(0, FIRST_WORDS))
    some = _texts_of(pairs, texts)
    first = _verified(pairs, some, shingle, similarity)
    own = some.mapInArrow(_shingles(shingle), "h long, t long").groupBy("h").agg(F.count("*").alias("n"), F.min("t").alias("t")).where("n = 1").groupBy("t").agg(F.count("*").alias("own"))
    ends = pairs.select(F.col("a").alias("t")).unionAll(pairs.select(F.col("b").alias("t"))).distinct()
    roots = components(first).select(F.col("node").alias("t"), "root")
    known = ends.join(own, "t", "left").join(roots, "t", "left").select("t", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("root", "t").bitwiseXOR(F.col("t")).alias("apart"))
    rows = prints.repartition(parts, "t").join(known.repartition(parts, "t"), "t", "left")
    #: beside the size: one more than the shingles that other texts of the first round have, or 0
    sizes = size + F.coalesce(F.col("size") - F.col("own") + 1, F.lit(0))
    pairs = met(rows.select("t", F.coalesce("apart", F.lit(0)).alias("apart"), sizes.alias("sizes"), "print"), slice(FIRST_WORDS, words))
    return first.unionAll(_verified(pairs, _texts_of(pairs, texts), shingle, similarity))


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts that the pairs have, each once."""
    needed = pairs.select(F.col("a").alias("t")).unionAll(pairs.select(F.col("b").alias("t"))).distinct().checkpoint()
    if needed.count() <= SENT_TEXTS:
        #: then no text is shuffled that no pair has
        needed = F.broadcast(needed)
    return texts.join(needed, "t", "left_semi").dropDuplicates(["t"])


def _verified(pairs: DataFrame, some: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs whose texts are alike."""
    x, y = some.select(F.col("t").alias("a"), F.col("text").alias("x")), some.select(F.col("t").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_alike(shingle, similarity), "a long, b long").checkpoint()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when of each group of texts that `similar` connects, and of equal
    texts, one row stays: that with the smallest id (null last), then the smallest hash of the text.

    Texts without a word, null or not, are one text. Decided for each row: rows with the same id
    but unlike texts all stay, and so do those with null ids."""
    own = F.col(f"`{text}`").cast("string")
    t = F.when(own.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(own)).otherwise(F.xxhash64(F.lit("")))
    place = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.col("_t"))
    texts = docs.select(t.alias("t"), own.alias("text"))
    roots = components(similar(texts))
    marks = docs.select(t.alias("_t"), F.col(f"`{doc_id}`")).groupBy("_t", F.col(f"`{doc_id}`")).agg(F.count("*").alias("n"))
    first = marks.select("_t", "n", place.alias("p")).groupBy("_t").agg(F.min(F.struct("p", "n")).alias("least"))
    groups = first.join(roots, first["_t"] == roots["node"], "left").groupBy(F.coalesce("root", "_t")).agg(F.min("least").alias("least"))
    chosen = groups.select(F.col("least.p._t").alias("_chosen"), F.col("least.p.id").alias("_id"), F.col("least.n").alias("_n"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("_row"), t.alias("_t"), F.col(f"`{doc_id}`").alias("_own"))
    kept = whole.join(chosen, (whole["_t"] == chosen["_chosen"]) & whole["_own"].eqNullSafe(chosen["_id"]))
    #: rows that are alike in id and text are rare: only they are grouped
    several = kept.where("_n > 1").groupBy("_t", "_own").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return kept.where("_n = 1").select("_row").unionAll(several.select("_row")).select("_row.*")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """One row for each row of docs: doc_id, fp (the fingerprint as a signed integer),
    component_id (the least id of those that links lead to; null ids name no component).

    Texts of fewer words than a shingle are one shingle; null texts and those without words
    have fingerprint 0 and are linked like any other. Repeated rows stay, with the same result.
    """
    shared_folder(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    #: Ids and fingerprints of all documents, once: texts are not needed again.
    marked = rows.mapInArrow(_prints(shingle), "doc_id long, fp long").checkpoint()
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("fp"), distance, crowded))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
