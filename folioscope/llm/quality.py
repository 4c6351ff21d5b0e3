"""Quality classifier from weak labels.

Heuristic labellers look at a text and vote that it is bad, that it is fine, or not at all.
Expectation-maximisation finds how accurate each labeller is from how they agree, without
trusting any of them, and gives each document of a bounded sample a posterior probability.
Those posteriors train a linear scorer over hashed features, which then scores every document.
There are two such models: one for junk, one for toxic texts. Rows of a table of labels, where
given, are one more labeller of each, as fallible as the others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import text as tx

#: Documents that the two models are fitted on at most (about: chosen by a hash of the id).
FIT_DOCUMENTS = 8_000
#: Bits of the hashed feature space, rounds of EM, and passes of the linear scorer.
BITS, ROUNDS, PASSES = 18, 25, 12
#: Different texts of the sample that must have a feature, and by how many standard deviations
#: it must be more, or less, frequent in bad texts.
LEAST_TEXTS, DEVIATIONS = 10, 5.0
#: English insults, insults of three other languages, and threats.
INSULTS = ["clown", "disgusting", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]
ABUSE = ["abruti", "abschaum", "asqueroso", "basura", "blödmann", "connard", "crétin", "dummkopf", "débil", "débile", "escoria", "estúpido", "imbécil", "imbécile", "minable", "ordure", "patético", "stupide", "trottel", "versager", "widerlich", "wertlos"]
THREATS = ["destroy", "hang", "hate", "hurt", "kill", "killed", "murder", "shoot", "töten", "hasse", "haïr", "tuer", "matar", "odio"]
#: Frequent words by which a labeller knows that it can read a text.
ENGLISH = ["a", "and", "are", "in", "is", "it", "of", "that", "the", "to"]
OTHERS = ["das", "de", "der", "die", "ein", "el", "en", "est", "et", "la", "le", "les", "los", "que", "un", "una", "und", "une", "y"]
#: Labellers of junk: a measure, the value from which it votes bad, and that up to which fine
#: (or the other way round, where fine is above bad).
JUNK = [("symbols", 0.10, 0.05), ("capitals", 0.25, 0.06), ("fresh", 0.35, 0.5), ("bare", 0.03, 0.005), ("same_lines", 0.3, 0.05), ("word_size", 9.0, 7.0)]
#: Labellers of toxic texts, each by words of its own: English insults, those of other languages,
#: and threats. A list says nothing of texts in a language that it isn't of: its labeller votes
#: fine only where it finds none and frequent words of its language are KNOWN of all words.
TOXIC = [("insults", 1, 0), ("abuse", 1, 0), ("threats", 1, 0)]
READS = {"insults": ("english",), "abuse": ("others",), "threats": ("english", "others")}
KNOWN = 0.1
#: Steps in one unit of each measure of junk; a text has a feature for each step it reaches.
STEPS = (40, 20, 12, 40, 10, 1)
MEASURES = ["words", *(m for m, _, _ in JUNK), *(m for m, _, _ in TOXIC), "english", "others"]


def _list_hashes(words: list[str]) -> np.ndarray:
    data, offsets = tx.buffers(pa.array(words))
    start, end, _ = tx.word_bounds(data, offsets, tx.ALNUM)
    return np.sort(tx.word_hashes(data, start, end))


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    symbol, upper, letter = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    for b in range(0x21, 0x7F):
        c = chr(b)
        symbol[b], upper[b], letter[b] = not c.isalnum(), c.isupper(), c.isalpha()
    letter[0x80:] = True
    return symbol, upper, letter


_SYMBOL, _UPPER, _LETTER = _kinds()


#: Bytes of the word beginnings that are features of what a text says.
STEMS = (4, 6, 7)
Features = tuple[list[np.ndarray], list[np.ndarray]]


def describe(column: pa.Array) -> Iterator[tuple[np.ndarray, Features, Features]]:
    """For the texts of a slice at a time, in order, their measures and two sets of hashed features
    with their weights. Only one slice is held, however many texts the column has.

    Its shape: pairs of neighbouring bytes by their share of the text, and the measures by
    steps. What it says: every different word (lower case) and word beginning. Null is empty."""
    data, offsets = tx.buffers(column)
    lists = [_list_hashes(x) for x in (INSULTS, ABUSE, THREATS, ENGLISH, OTHERS)]
    for a, b in tx.slices(offsets):
        measures = np.zeros((b - a, len(MEASURES)))
        shape: Features = ([], [])
        said: Features = ([], [])
        raw = data[offsets[a] : offsets[b]]
        own = offsets[a : b + 1] - offsets[a]
        low = tx.LOWER[raw]
        start, end, first = tx.word_bounds(low, own, tx.ALNUM)
        prefix = tx.prefix_hash(tx.byte_values(low))
        hashed = tx.span_hash(prefix, start, end)
        stems = [tx.mix(tx.span_hash(prefix, start, np.minimum(end, start + k)) + np.uint64(k)) for k in STEMS]
        longer = [end - start > k for k in STEMS]
        marks, mark_end, mark_first = tx.word_bounds(raw, own, tx.NOT_SPACE)
        whole = tx.span_hash(prefix, marks, mark_end)
        letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
        bare = letters[mark_end] == letters[marks]
        symbol, upper = np.concatenate([[0], np.cumsum(_SYMBOL[raw])]), np.concatenate([[0], np.cumsum(_UPPER[raw])])
        found = [np.concatenate([[0], np.cumsum(x[np.minimum(np.searchsorted(x, hashed), len(x) - 1)] == hashed)]) for x in lists]
        line_ends = raw == 10
        for row in range(b - a):
            s, e = own[row], own[row + 1]
            n = max(1, e - s)
            w0, w1, f0, f1 = mark_first[row], mark_first[row + 1], first[row], first[row + 1]
            words = max(1, w1 - w0)
            different, at = np.unique(hashed[f0:f1], return_index=True)
            #: different words with the same beginning
            begin = [np.unique(x[f0:f1][at][y[f0:f1][at]], return_counts=True) for x, y in zip(stems, longer)]
            lines = 1 + int(line_ends[s:e].sum())
            same = 0.0
            if lines > 3:
                parts = raw[s:e].tobytes().split(b"\n")
                same = 1 - len(set(parts)) / len(parts)
            listed = [int(x[f1] - x[f0]) for x in found]
            m = [w1 - w0, (symbol[e] - symbol[s]) / n, (upper[e] - upper[s]) / max(1, letters[e] - letters[s]), len(np.unique(whole[w0:w1])) / words ** 0.93 if w1 - w0 > 8 else 1.0, bare[w0:w1].sum() / words, same, (letters[e] - letters[s]) / words, *listed[:3], listed[3] / words, listed[4] / words]
            measures[row] = m
            pair = low[s : e - 1].astype(np.int64) << 8 | low[s + 1 : e] if e - s > 1 else np.zeros(0, np.int64)
            pairs, times = np.unique(pair, return_counts=True)
            steps = np.array([i * 64 + j for i, (x, k) in enumerate(zip(m[1:7], STEPS)) for j in range(min(12, int(x * k)) + 1)])
            for out, ids, share in (
                (shape, [tx.mix(pairs.astype(np.uint64) + np.uint64(1 << 40)), tx.mix(steps.astype(np.uint64) + np.uint64(1 << 41))], [times * (20.0 / n), np.full(len(steps), 2.0)]),
                (said, [different, *(x for x, _ in begin)], [np.ones(len(different)), *(np.minimum(c, 4) for _, c in begin)]),
            ):
                places = np.concatenate(ids) >> np.uint64(64 - BITS)
                out[0].append(places.astype(np.int32))
                out[1].append(np.concatenate(share).astype(np.float32))
        yield measures, shape, said


def votes(measures: np.ndarray, labellers: list[tuple[str, float, float]]) -> np.ndarray:
    """1 for bad, 0 for fine, -1 for no vote: a column for each labeller. Texts of fewer than 5
    words are only judged by what they say, not by their shape."""
    out = np.full((len(measures), len(labellers)), -1, np.int8)
    short = measures[:, 0] < 5
    for k, (name, bad, fine) in enumerate(labellers):
        x = measures[:, MEASURES.index(name)]
        up = bad > fine
        out[(x >= bad) if up else (x <= bad), k] = 1
        calm = (x <= fine) if up else (x >= fine)
        if name in READS:
            calm &= sum(measures[:, MEASURES.index(m)] for m in READS[name]) >= KNOWN
        out[calm, k] = 0
        if labellers is JUNK:
            out[short, k] = -1
    return out


def posteriors(votes_: np.ndarray, rounds: int = ROUNDS, prior: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: P(bad) of each row, and for each labeller its rates
    [P(votes bad | fine), P(votes bad | bad)] among its votes.

    It starts from labellers that are right in most votes and finds those that are not: a rate may
    end anywhere. What all labellers say together decides which class is the bad one."""
    rates = np.tile([[0.1], [0.8]], (1, votes_.shape[1])).T.astype(float)
    bad, fine = votes_ == 1, votes_ == 0
    q = np.full(len(votes_), prior)
    for _ in range(rounds):
        log_bad = np.log(prior) + bad @ np.log(rates[:, 1]) + fine @ np.log(1 - rates[:, 1])
        log_fine = np.log(1 - prior) + bad @ np.log(rates[:, 0]) + fine @ np.log(1 - rates[:, 0])
        q = 1 / (1 + np.exp(np.clip(log_fine - log_bad, -50, 50)))
        prior = float(np.clip(q.mean() if len(q) else prior, 0.005, 0.6))
        for side, w in ((0, 1 - q), (1, q)):
            yes, no = w @ bad, w @ fine
            rates[:, side] = (yes + (0.2, 1.6)[side]) / (yes + no + 2)
        rates = np.clip(rates, 0.002, 0.998)
    #: by how much each labeller's votes speak for the class that is called bad
    if len(votes_) and ((bad | fine).sum(0) * (rates[:, 1] - rates[:, 0])).sum() < 0:
        return 1 - q, rates[:, ::-1]
    return q, rates


def train(index: list[np.ndarray], weight: list[np.ndarray], target: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by adaptive gradient steps over mini-batches."""
    w, g, bias, bias_g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3), 0.0, 1e-3
    #: What only a few texts have, or what bad and fine ones have alike, says nothing of others.
    share = np.clip(target.mean() if len(target) else 0.5, 0.02, 0.98)
    times, bad = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS)
    for own, p in zip(index, target):
        np.add.at(times, own, 1)
        np.add.at(bad, own, p)
    seen = (times >= LEAST_TEXTS) & (np.abs(bad - times * share) >= DEVIATIONS * np.sqrt(np.maximum(times, 1) * share * (1 - share)))
    weight = [np.asarray(v)[seen[own]] for own, v in zip(index, weight)]
    index = [own[seen[own]] for own in index]
    sizes = np.array([len(i) for i in index], np.int64)
    flat, value = (np.concatenate(index), np.concatenate(weight).astype(np.float64)) if len(index) else (np.zeros(0, np.int32), np.zeros(0))
    base = np.cumsum(sizes) - sizes
    weigh = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    dice = np.random.default_rng(7)
    for _ in range(passes):
        order = dice.permutation(len(index))
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            span = np.concatenate([np.arange(base[r], base[r] + sizes[r]) for r in rows])
            row = np.repeat(np.arange(len(rows)), sizes[rows])
            x, v = flat[span], value[span]
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[x] * v, len(rows)), -30, 30)))
            err = (p - target[rows]) * weigh[rows]
            step = np.bincount(x, err[row] * v, 1 << BITS) if len(x) > 1 << 16 else None
            if step is None:
                touched, where = np.unique(x, return_inverse=True)
                d = np.bincount(where, err[row] * v, len(touched))
            else:
                touched = np.flatnonzero(step)
                d = step[touched]
            d = d + 1e-4 * w[touched]
            g[touched] += d * d
            w[touched] -= 0.15 * d / np.sqrt(g[touched])
            bias_g += err.sum() ** 2
            bias -= 0.15 * err.sum() / np.sqrt(bias_g)
    return w, bias


@dataclass
class Classifier:
    """Weights and bias of the two scorers, and the rates of the labellers."""

    junk: tuple[np.ndarray, float]
    toxic: tuple[np.ndarray, float]
    rates: dict[str, np.ndarray]

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = ([np.zeros(0)], [np.zeros(0)])
        for _, shape, said in describe(column):
            for k, ((w, bias), (index, weight)) in enumerate(((self.junk, shape), (self.toxic, said))):
                out[k].append(np.array([1 / (1 + np.exp(-np.clip(bias + (w[i] * v).sum(), -30, 30))) for i, v in zip(index, weight)]))
        return np.concatenate(out[0]), np.concatenate(out[1])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for measures, shape, said in describe(batch.column("text")):
            lists = [pa.array(x, pa.list_(t)) for x, t in ((list(measures), pa.float64()), (shape[0], pa.int32()), (shape[1], pa.float32()), (said[0], pa.int32()), ([x.astype(np.int8) for x in said[1]], pa.int8()))]
            yield pa.RecordBatch.from_arrays([*lists, *(batch.column(c).slice(at, len(measures)) for c in ("quality", "toxic"))], names=["measures", "si", "sw", "wi", "ww", "quality", "toxic"])
            at += len(measures)


def fit(docs: DataFrame, labels: DataFrame | None = None, limit: int = FIT_DOCUMENTS, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """Fits on a sample of about `limit` rows that have a text: labelled ones where labels
    (doc_id, quality, toxic) are given, else any. The sample's features meet in one task, which
    returns the model."""
    rows = tx.doc_input(docs, doc_id, text).where(F.col("text").isNotNull())
    none = F.lit(None).cast("int")
    chosen = lambda total: F.xxhash64("doc_id", F.lit("fit")) <= F.lit(tx.hash_limit(limit, total))
    total = 0
    if labels is not None:
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        total = known.count()
    if total:
        #: a table of about `limit` ids and two small numbers
        sample = rows.join(F.broadcast(known.where(chosen(total))), "doc_id")
    else:
        sample = rows.where(chosen(max(1, rows.select("doc_id").distinct().count()))).select("*", none.alias("quality"), none.alias("toxic"))
    #: one text for each id, so that a repeated id can't multiply what reaches the driver
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "quality", "toxic")).alias("one")).select("one.*")
    features = sample.mapInArrow(_sampled, "measures array<double>, si array<int>, sw array<float>, wi array<int>, ww array<tinyint>, quality int, toxic int")
    #: one task, for a bounded number of rows; only the model comes to the driver
    row = features.repartition(1).mapInArrow(_fitted, "model binary").first()
    return pickle.loads(row["model"]) if row else _nothing_known()


def _nothing_known() -> Classifier:
    """The classifier of an empty sample, for which no text is surely bad."""
    none = np.zeros(1 << BITS), -1.0
    return Classifier(none, none, {name: np.zeros((0, 2)) for name in ("junk", "toxic")})


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classifier of the features of a sample, whatever the order that they arrive in."""
    held = [b for b in batches if b.num_rows]
    if not held:
        model = _nothing_known()
    else:
        got = pa.Table.from_batches(held)
        measures = np.array(got["measures"].to_pylist()).reshape(-1, len(MEASURES))
        label = {c: got[c].fill_null(-1).to_numpy() for c in ("quality", "toxic")}
        #: exact copies count once; rows are taken in order of their measures
        _, once = np.unique(np.column_stack([measures, label["quality"], label["toxic"]]), axis=0, return_index=True)
        got, measures = got.take(once), measures[once]
        models, rates = {}, {}
        for name, labellers, column, flip, part in (("junk", JUNK, "quality", True, "s"), ("toxic", TOXIC, "toxic", False, "w")):
            index, weight = ([np.asarray(x.values) for x in got[part + kind]] for kind in ("i", "w"))
            own = label[column][once]
            own = np.where(own < 0, -1, 1 - own if flip else own).astype(np.int8)
            target, rates[name] = posteriors(np.column_stack([votes(measures, labellers), own]))
            models[name] = train(index, weight, target)
        model = Classifier(models["junk"], models["toxic"], rates)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


RESULT = [("junk", "double"), ("toxic", "double"), ("keep", "boolean")]


def classify(docs: DataFrame, model: Classifier, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with junk and toxic (probabilities) and keep: whether both are below the threshold.

    Null texts, and texts without a word, are empty: they are no junk and not toxic by definition
    (probability 0) and are kept, as nothing speaks against them. Repeated rows score alike. A
    column of docs with a result's name is replaced."""
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(text))
        junk, toxic = packed.value.score(column)
        data, offsets = tx.buffers(column)
        _, _, first = tx.word_bounds(data, offsets, tx.NOT_SPACE)
        empty = np.diff(first) == 0
        junk, toxic = np.where(empty, 0.0, junk), np.where(empty, 0.0, toxic)
        return {"junk": pa.array(junk), "toxic": pa.array(toxic), "keep": pa.array((junk < threshold) & (toxic < threshold))}

    return tx.with_results(docs, work, RESULT)
