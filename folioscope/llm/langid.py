"""Language identification with segmentation-marginalised unigrams.

Each language gives a probability to every piece of a fixed public vocabulary. The probability
of a word is the sum over all its segmentations into pieces, by the forward algorithm; that of
a text is the product over its words. Piece probabilities come from expectation-maximisation:
expected counts over all segmentations (forward and backward) of the training words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import text as tx
from folioscope.llm.storage import shared_folder

#: Documents that the model is fitted on at most (about: they are chosen by a hash of id and text,
#: and shared out among the languages), rounds of expectation-maximisation, and word scores that a task remembers.
FIT_DOCUMENTS, ROUNDS, REMEMBERED = 20_000, 2, 700_000
#: The probability of a letter that no piece covers, and the counts that smooth each piece.
UNKNOWN, SMOOTH = 1e-7, 0.05
UNDETERMINED = "und"
#: Words scored together, and letters from which a word is scored alone.
BATCH_WORDS, LONG_WORD = 2048, 40
_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are text, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, each marked as a word's start as the vocabulary does."""
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Trie:
    """The pieces as a tree of letters, in arrays: from a node and a letter to the next node. Keys
    hold both whole, so a step is exact. Many places of many words are walked at a time."""

    def __init__(self, pieces: list[str]) -> None:
        steps: dict[int, int] = {}
        ends = {}
        nodes = 1
        for n, piece in enumerate(pieces):
            at = 0
            for letter in piece:
                key = at << 21 | ord(letter)
                if key not in steps:
                    steps[key] = nodes
                    nodes += 1
                at = steps[key]
            ends[at] = n
        self.longest = max(map(len, pieces), default=1)
        #: the piece that ends at a node, or -1
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        bits = max(4, (4 * len(steps)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys = np.fromiter(steps, np.int64, len(steps))
        for key, value, slot in zip(keys.tolist(), steps.values(), self._slot(keys).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.next[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The next node of each key, or 0."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.next[slot], 0)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.next[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def spans(self, marked: list[str]) -> list[np.ndarray]:
        """For words of one length: [length - 1][word, start] is the piece of that span, or -1."""
        size = len(marked[0])
        codes = np.array(marked).view(np.uint32).reshape(len(marked), size).astype(np.int64).ravel()
        out = []
        at = np.arange(len(codes))
        node = np.zeros(len(codes), np.int64)
        for length in range(1, min(size, self.longest) + 1):
            piece = np.full(len(codes), -1, np.int32)
            inside = at % size + length <= size
            at, node = at[inside], node[inside]
            node = self.step(node << 21 | codes[at + length - 1]).astype(np.int64)
            live = node > 0
            at, node = at[live], node[live]
            piece[at] = self.piece[node]
            out.append(piece.reshape(len(marked), size))
        return out


@dataclass
class Model:
    languages: list[str]
    #: piece -> its probability in each language
    pieces: dict[str, tuple[float, ...]]
    prior: list[float]

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        #: the same as a table, with the unknown letter and, last, what is no piece
        self.table = np.array([*self.pieces.values(), (UNKNOWN,) * len(self.languages), (0.0,) * len(self.languages)], float).reshape(len(self.pieces) + 2, len(self.languages))

    @cached_property
    def trie(self) -> Trie:
        return Trie(list(self.pieces))

    def score(self, word: str) -> list[float]:
        """Log probability of a word in each language: the forward algorithm, scaled at each letter."""
        marked = "▁" + word
        size, kinds, longest, pieces = len(marked), range(len(self.languages)), self.longest, self.pieces
        alpha = [[1.0] * len(self.languages)]
        shift = 0.0
        for end in range(1, size + 1):
            total = [0.0] * len(self.languages)
            for start in range(max(0, end - longest), end):
                p = pieces.get(marked[start:end])
                if p is not None:
                    before = alpha[start]
                    for k in kinds:
                        total[k] += before[k] * p[k]
                elif start == end - 1:
                    before = alpha[start]
                    for k in kinds:
                        total[k] += before[k] * UNKNOWN
            alpha.append(total)
            top = max(total)
            if top < 1e-100:
                for row in alpha[max(0, end - longest) :]:
                    for k in kinds:
                        row[k] *= 1e100
                shift -= 100 * math.log(10)
        return [math.log(max(x, 1e-300)) + shift for x in alpha[size]]

    def score_many(self, words: list[str]) -> np.ndarray:
        """`score` of many words (a row each): the same sums, for all words a letter at a time."""
        out = np.empty((len(words), len(self.languages)))
        for size, rows in _by_size(words).items():
            for at in range(0, len(rows), BATCH_WORDS):
                part = rows[at : at + BATCH_WORDS]
                out[part] = [self.score(words[n]) for n in part] if size > LONG_WORD else self._forward(["▁" + words[n] for n in part])
        return out

    def _numbers(self, marked: list[str]) -> list[np.ndarray]:
        """The rows of the table for each span: a letter that is no piece is the unknown one; any
        other span that is none has no probability."""
        spans = self.trie.spans(marked)
        return [np.where(p < 0, len(self.pieces) + (n > 0), p) for n, p in enumerate(spans)]

    def _forward(self, marked: list[str]) -> np.ndarray:
        """For words of one length: the piece of each span, then sums over the spans that end at each letter."""
        size, spans = len(marked[0]), self._numbers(marked)
        alpha = np.zeros((size + 1, len(marked), len(self.languages)))
        alpha[0], shift = 1.0, np.zeros(len(marked))
        for e in range(1, size + 1):
            for length in range(1, min(e, len(spans)) + 1):
                alpha[e] += alpha[e - length] * self.table[spans[length - 1][:, e - length]]
            tiny = alpha[e].max(1) < 1e-100
            if tiny.any():
                alpha[max(0, e - len(spans)) : e + 1, tiny] *= 1e100
                shift[tiny] -= 100 * math.log(10)
        return np.log(np.maximum(alpha[size], 1e-300)) + shift[:, None]

    def expected(self, words: list[str], times: list[int], k: int) -> np.ndarray:
        """Expected counts of each piece over all segmentations of the words in language k."""
        out = np.zeros(len(self.table))
        table = np.ascontiguousarray(self.table[:, k])
        for size, rows in _by_size(words).items():
            for at in range(0, len(rows), BATCH_WORDS):
                part = rows[at : at + BATCH_WORDS]
                left = part if size > LONG_WORD else self._expected([words[n] for n in part], np.array([times[n] for n in part], float), table, out)
                for n in left if size > LONG_WORD else [part[i] for i in left]:
                    self._expected_long(words[n], times[n], table, out)
        return out[: len(self.pieces)]

    def _expected(self, words: list[str], times: np.ndarray, table: np.ndarray, out: np.ndarray) -> list[int]:
        """Adds the counts of words of one length; returns those whose probability is too small for it."""
        spans = self._numbers(["▁" + w for w in words])
        size, chance = len(words[0]) + 1, [table[p] for p in spans]
        alpha, beta = np.zeros((size + 1, len(words))), np.zeros((size + 1, len(words)))
        alpha[0] = beta[size] = 1.0
        for e in range(1, size + 1):
            for length in range(1, min(e, len(spans)) + 1):
                alpha[e] += alpha[e - length] * chance[length - 1][:, e - length]
        for s in range(size - 1, -1, -1):
            for length in range(1, min(size - s, len(spans)) + 1):
                beta[s] += beta[s + length] * chance[length - 1][:, s]
        fine = alpha[size] > 1e-250
        whole = np.where(fine, times / np.where(fine, alpha[size], 1.0), 0.0)
        for length in range(1, len(spans) + 1):
            last = size - length + 1
            share = alpha[:last].T * chance[length - 1][:, :last] * beta[length:].T * whole[:, None]
            out += np.bincount(spans[length - 1][:, :last].ravel(), share.ravel(), len(out))
        return np.flatnonzero(~fine).tolist()

    def _expected_long(self, word: str, times: int, table: np.ndarray, out: np.ndarray) -> None:
        """The same for one word, in logarithms."""
        marked = "▁" + word
        size = len(marked)
        spans = self._numbers([marked])
        with np.errstate(divide="ignore"):
            chance = [np.log(table[p[0]]) for p in spans]
            alpha, beta = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
            alpha[0] = beta[size] = 0.0
            for e in range(1, size + 1):
                alpha[e] = np.logaddexp.reduce([alpha[e - n] + chance[n - 1][e - n] for n in range(1, min(e, len(spans)) + 1)])
            for s in range(size - 1, -1, -1):
                beta[s] = np.logaddexp.reduce([beta[s + n] + chance[n - 1][s] for n in range(1, min(size - s, len(spans)) + 1)])
        for n, (p, c) in enumerate(zip(spans, chance), 1):
            np.add.at(out, p[0][: size - n + 1], times * np.exp(alpha[: size - n + 1] + c[: size - n + 1] + beta[n:] - alpha[size]))


def _by_size(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for n, w in enumerate(words):
        out.setdefault(len(w), []).append(n)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
            held.setdefault(lang, Counter()).update(words_of(value.as_py()))
        if sum(map(len, held.values())) > 500_000:
            yield from flush()
    yield from flush()


def fit(training: DataFrame, pieces: list[str], limit: int = FIT_DOCUMENTS, rounds: int = ROUNDS) -> Model:
    """training: doc_id, text, lang (not null). Only tables of pieces by language reach the driver."""
    session = training.sparkSession
    shared_folder(session)
    training = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = training.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages, total = sorted(r["lang"] for r in rows), sum(r["n"] for r in rows)
    if not languages:
        return Model([], {}, [])
    if total > limit:
        #: a row for each language: rare ones are learnt from whole, frequent ones share what is left
        share = shares({r["lang"]: r["n"] for r in rows}, limit)
        table = session.createDataFrame([(r["lang"], tx.hash_limit(share[r["lang"]], r["n"])) for r in rows], "known string, most long")
        training = training.join(F.broadcast(table), training["lang"] == F.col("known")).where(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("fit")) <= F.col("most"))
    counts = training.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).checkpoint()
    #: At first a piece is as probable as it is short; the data take over in the first round.
    start = {p: 20.0 ** -len(p) for p in pieces}
    whole = sum(start.values())
    model = Model(languages, {p: (x / whole,) * len(languages) for p, x in start.items()}, [math.log(r["n"] / total) for r in sorted(rows, key=lambda r: r["lang"])])
    for _ in range(rounds):
        known = session.sparkContext.broadcast((model.languages, model.pieces, model.prior))
        table = counts.mapInArrow(_expectation(known), "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        #: as many rows as languages times pieces at most
        sums = {lang: 0.0 for lang in languages}
        found: dict[str, list[float]] = {}
        for r in table:
            sums[r["lang"]] += r["n"]
            found.setdefault(r["piece"], [0.0] * len(languages))[languages.index(r["lang"])] = r["n"]
        none = [0.0] * len(languages)
        model = Model(languages, {p: tuple((c + SMOOTH) / (sums[lang] + SMOOTH * len(pieces)) for c, lang in zip(found.get(p, none), languages)) for p in pieces}, model.prior)
        known.unpersist()
    return model


def shares(sizes: dict[str, int], limit: int) -> dict[str, int]:
    """How many documents of each language are learnt from: all of those that have few, and of the
    others as many each, so that the sum is `limit`."""
    out, left = {}, limit
    for n, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        out[lang] = min(size, max(1, left // (len(sizes) - n)))
        left -= out[lang]
    return out


def _expectation(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*known.value)
        names = list(model.pieces)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            held: dict[str, tuple[list[str], list[int]]] = {}
            for lang, word, n in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                words, times = held.setdefault(lang, ([], []))
                words.append(word)
                times.append(n)
            for lang, (words, times) in held.items():
                sums[lang] = sums.get(lang, 0.0) + model.expected(words, times, model.languages.index(lang))
        for lang, counts in sums.items():
            some = np.flatnonzero(counts > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([names[i] for i in some], pa.string()), pa.array(counts[some])], names=["lang", "piece", "n"])

    return run


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.places = model, {}
        self.table = np.zeros((1 << 12, max(1, len(model.languages))))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Languages and their probabilities; the words that some of the texts have first are learnt together."""
        found = [words_of(t) if self.model.languages and has_letter(t) else None for t in texts]
        new = {w for words in found for w in words or () if w not in self.places}
        if len(self.places) + len(new) > REMEMBERED:
            #: those that came first are the frequent ones: they stay
            self.places = dict(islice(self.places.items(), REMEMBERED // 3))
            new = {w for words in found for w in words or () if w not in self.places}
        if new:
            self._learn(sorted(new))
        out = []
        for words in found:
            if words is None:
                out.append((UNDETERMINED, 0.0))
                continue
            total = np.array(self.model.prior)
            for at in range(0, len(words), 1 << 16):
                total += self.table[[self.places[w] for w in words[at : at + (1 << 16)]]].sum(0)
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out

    def _learn(self, words: list[str]) -> None:
        scores = self.model.score_many(words)
        n = len(self.places)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(words)] = scores
        self.places.update(zip(words, range(n, n + len(words))))


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, known) -> Scorer:
    """The scorer of a worker process, which serves all its tasks."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(Model(*known.value))
    return _scorers[name]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (its posterior probability).

    Null texts and those without a letter are `und`, with score 0; so are all where the model
    has no language. Letters beyond the vocabulary cost the same in each language. Ties go to
    the first language in order. A column with a result's name is replaced."""
    known = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.prior))
    name = uuid.uuid4().hex

    def work(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(name, known)
        column, got = batch.column(batch.schema.get_field_index(text)), []
        _, offsets = tx.buffers(column)
        for a, b in tx.slices(offsets):
            got += scorer(column.slice(a, b - a).to_pylist())
        return {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}

    return tx.with_results(docs, work, [("lang_pred", "string"), ("score", "double")])


def held_out(doc_id):
    """Documents that nothing is learnt from. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
