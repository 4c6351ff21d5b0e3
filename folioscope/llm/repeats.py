"""Candidate search for repeated runs of W units (words or bytes), shared by two operators.

In every run of W units the k-gram of least hash is its anchor (winnowing), so equal runs have
equal anchors at the same place. An anchor owns a stretch of consecutive run starts; the
units that those runs cover are the anchor's area. Anchors of one hash form a family; a family
of which only one area exists can't hold a repeat. Equal areas of a family are one class,
which is examined once, however many copies it has.

- families with one class: its runs are repeated as often as the class;
- families of at most CROWDED classes: one area of each class is sent to the family's task,
  where the calling operator works on the texts (a suffix array, or an automaton);
- larger families are dealt to as many parts as their size asks for. Each part counts the runs
  of its classes by hash; the counts, not the classes, meet in as many buckets of hashes; and
  what other parts know of a run goes back to those that have it. No task gets a whole family.

No text is shuffled more than once for each of the two places that need it, and what each
stage gathers is bounded by the crowd limit or by one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import text as tx
from folioscope.llm.storage import shared_folder

#: Classes of a family that are examined together in one task.
CROWDED = 2048
#: Bytes of areas that a task examines at a time.
BUNDLE_BYTES = 1 << 21


@dataclass(frozen=True)
class Units:
    """How texts are read: the hash of each unit, and its place in the UTF-8 bytes."""

    window: int
    gram: int
    words: bool

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values, first unit of each row and the end, start byte, end byte)"""
        if self.words:
            start, end, first = tx.word_bounds(data, offsets, tx.NOT_SPACE)
            return tx.word_hashes(data, start, end), first, start, end
        at = np.arange(len(data))
        return tx.byte_values(data), offsets, at, at + 1


def anchors(values: np.ndarray, first: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """For each anchor: its row, family hash, class hash, first owned run start (from the
    row's first unit), units from there to the anchor, and number of owned runs."""
    empty = np.zeros(0, np.int64)
    lengths = np.diff(first)
    if not len(lengths) or lengths.max() < window:
        return {"row": empty, "h": empty, "c": empty, "s": empty, "left": empty, "n": empty}
    grams = tx.gram_hash(values, k)
    least = tx.sliding_least(tx.placed(grams), window - k + 1)
    long = lengths >= window
    marks = np.zeros(len(values) + 1, np.int8)
    marks[first[:-1][long]] += 1
    marks[first[1:][long] - window + 1] -= 1
    runs = np.flatnonzero(np.cumsum(marks, dtype=np.int8)[: len(least)])
    winner = (least[runs] & tx.PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], winner[1:] != winner[:-1]]))
    tail = np.concatenate([head[1:], [len(runs)]]) - 1
    p, s, e = winner[head], runs[head], runs[tail]
    prefix = tx.prefix_hash(values)
    shape = ((p - s) << 32 | (e - s)).astype(np.uint64)
    area = tx.mix(tx.span_hash(prefix, s, e + window) ^ tx.mix(shape))
    row = np.searchsorted(first, s, "right") - 1
    return {"row": row, "h": grams[p].view(np.int64), "c": area.view(np.int64), "s": s - first[row], "left": p - s, "n": e - s + 1}


def _anchor_rows(units: Units) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, did = batch.column("rid"), batch.column("did")
            data, offsets = tx.buffers(batch.column("text"))
            for a, b in tx.slices(offsets):
                values, first, _, _ = units.read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got = anchors(values, first, units.window, units.gram)
                take = pa.array(got["row"] + a)
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(got["h"]), pa.array(got["c"]), rid.take(take), did.take(take), *(pa.array(got[x].astype(np.int32)) for x in ("s", "left", "n"))], names=["h", "c", "rid", "did", "s", "left", "n"])

    return run


def _areas(units: Units, hashes: bool) -> Callable:
    """For documents with the classes that they stand for: each class's area as text, or the
    hashes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            wanted = batch.column("classes")
            for row in range(batch.num_rows):
                values, _, start, end = units.read(data[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]))
                classes = wanted[row].values.flatten() if hasattr(wanted[row].values, "flatten") else None
                h, c, first, copies, s, left, n, parts = (classes[i] for i in range(8))
                s_, n_ = s.to_numpy(), n.to_numpy()
                if hashes:
                    #: the hash of each run, with its place beside the anchor
                    prefix = tx.prefix_hash(values)
                    which = np.repeat(np.arange(len(s_)), n_)
                    step = np.arange(len(which)) - np.repeat(np.cumsum(n_) - n_, n_)
                    at = s_[which] + step
                    rel = (left.to_numpy()[which] - step).astype(np.uint64)
                    keys = tx.mix(tx.span_hash(prefix, at, at + units.window) ^ tx.mix(rel)).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_)]).astype(np.int32)), pa.array(keys))
                    yield pa.RecordBatch.from_arrays([h, c, first, copies, parts, lists], names=["h", "c", "first", "copies", "parts", "keys"])
                else:
                    raw = data[offsets[row] : offsets[row + 1]].tobytes()
                    texts = [raw[start[i] : end[i + m + units.window - 2]] for i, m in zip(s_.tolist(), n_.tolist())]
                    yield pa.RecordBatch.from_arrays([h, c, first, copies, left, n, pa.array(texts, pa.binary())], names=["h", "c", "first", "copies", "left", "n", "area"])

    return run


#: What an examination returns for a class: ranges of its run starts, each with the least
#: document that has them and whether they occur more than once.
FOUND = "h long, c long, runs array<struct<a:int,b:int,first:long,again:boolean>>"


def _examine(work: Callable[[list[dict]], list[list[dict]]]) -> Callable:
    """Feeds whole families, in bundles, of a partition that is sorted by family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64()), ("again", pa.bool_())]))
        held: list[dict] = []
        size = 0

        def flush(rows: list[dict]) -> pa.RecordBatch:
            found = work(rows)
            return pa.RecordBatch.from_arrays([pa.array([r["h"] for r in rows], pa.int64()), pa.array([r["c"] for r in rows], pa.int64()), pa.array(found, kind)], names=["h", "c", "runs"])

        for batch in batches:
            for row in batch.to_pylist():
                if size > BUNDLE_BYTES and row["h"] != held[-1]["h"]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["area"])
        if held:
            yield flush(held)

    return run


#: Runs by hash: least document and number of copies, as a part of a family knows them.
_COUNTS = "h long, part int, bucket int, keys array<long>, first array<long>, times array<long>"


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has."""
    column = table[name].combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _combined(keys: np.ndarray, first: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys with their least first and sum of times, and the number of each key."""
    different, number = np.unique(keys, return_inverse=True)
    least = np.full(len(different), np.iinfo(np.int64).max)
    np.minimum.at(least, number, first)
    return different, least, np.bincount(number, times, len(different)).astype(np.int64), number


def _counts(h: int, rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (2, 3, 4)]
    return pa.table([pa.array([h] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *lists], names=["h", "part", "bucket", "keys", "first", "times"])


def _count_part(table: pa.Table) -> pa.Table:
    """What a part knows: a row for each bucket of hashes."""
    keys, sizes = _flat(table, "keys")
    different, least, times, _ = _combined(keys, np.repeat(table["first"].to_numpy(), sizes), np.repeat(table["copies"].to_numpy(), sizes))
    bucket = np.mod(different, table["parts"][0].as_py())
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    part = table["part"][0].as_py()
    return _counts(table["h"][0].as_py(), [(part, int(bucket[at[0]]), different[at], least[at], times[at]) for at in np.split(order, cuts) if len(at)])


def _meet(table: pa.Table) -> pa.Table:
    """All that is known of a bucket's runs, given back to each part that has them and knows less."""
    keys, sizes = _flat(table, "keys")
    first, times = _flat(table, "first")[0], _flat(table, "times")[0]
    different, least, total, number = _combined(keys, first, times)
    news = (least[number] < first) | (total[number] > times)
    ends = np.cumsum(sizes)
    parts = table["part"].to_pylist()
    rows = [(part, 0, keys[at], least[number[at]], total[number[at]]) for part, end, size in zip(parts, ends.tolist(), sizes.tolist()) for at in [end - size + np.flatnonzero(news[end - size : end])] if len(at)]
    return _counts(table["h"][0].as_py(), rows)


def _tell(own: pa.Table, met: pa.Table) -> pa.Table:
    """Each class's runs, with what its part and the others know."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64()), ("again", pa.bool_())]))
    if not own.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], names=["h", "c", "runs"])
    keys, sizes = _flat(own, "keys")
    different, least, times, number = _combined(keys, np.repeat(own["first"].to_numpy(), sizes), np.repeat(own["copies"].to_numpy(), sizes))
    if met.num_rows:
        at = np.searchsorted(different, _flat(met, "keys")[0])
        least[at], times[at] = _flat(met, "first")[0], _flat(met, "times")[0]
    out, end = [], 0
    for size in sizes.tolist():
        n = number[end : end + size]
        end += size
        first, again = least[n], times[n] > 1
        turn = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (again[1:] != again[:-1])])).tolist()
        out.append([{"a": a, "b": b - 1, "first": int(first[a]), "again": bool(again[a])} for a, b in zip(turn, [*turn[1:], size])])
    return pa.table([own["h"], own["c"], pa.array(out, kind)], names=["h", "c", "runs"])


def number_rows(docs: DataFrame, doc_id: str, text: str, carry: bool) -> DataFrame:
    """rid: a hash of id and text, which is the same however the input is split when it is read again;
    rows with the same id and text have the same rid and the same repeats. did: the order of
    documents, null ids after all others. row: all columns but the text, if they are to be carried."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text] if carry else []
    return docs.select(F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).alias("rid"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)).alias("did"), F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *([F.struct(*rest).alias("rest")] if rest else [])).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))


def repeated_runs(rows: DataFrame, units: Units, across: bool, work: Callable[[list[dict]], list[list[dict]]], crowded: int = CROWDED) -> DataFrame:
    """(rid, did, spans): for the rows of `number_rows` the ranges of units that are to go: those of
    runs that also start in an earlier document (across), or anywhere else (not across)."""
    shared_folder(rows.sparkSession)
    found = rows.select("rid", "did", "text").mapInArrow(_anchor_rows(units), "h long, c long, rid long, did long, s int, left int, n int")
    if across:
        families = found.groupBy("h").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("h")
    else:
        families = found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    #: Written once to the shared folder: all that follows reads these few rows instead of texts.
    held = found.join(tx.splittable(families), "h").checkpoint()
    classes = held.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min("did").alias("first"), F.min(F.struct("rid", "did", "s", "left", "n")).alias("at"))
    sizes = classes.groupBy("h").agg(F.count("*").alias("members"))
    classes = classes.join(tx.splittable(sizes), "h")
    alone = classes.where("members = 1").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), (F.col("at.n") - 1).alias("b"), F.col("first"), (F.col("copies") > 1).alias("again"))).alias("runs"))
    several = classes.where("members > 1").select(F.col("at.rid").alias("rid"), F.col("at.did").alias("did"), F.struct("h", "c", "first", "copies", F.col("at.s").alias("s"), F.col("at.left").alias("left"), F.col("at.n").alias("n"), F.ceil(F.col("members") / crowded).cast("int").alias("parts")).alias("class"), (F.col("members") > crowded).alias("crowd"))
    #: These joins with texts and the caller's have all columns of rows, and so one exchange. Of rows
    #: with one rid one stands for the class.
    some = several.where("not crowd").groupBy("rid", "did").agg(F.collect_list("class").alias("classes")).join(rows, ["rid", "did"]).dropDuplicates(["rid", "did"]).select("classes", "text", "did", "row")
    areas = some.mapInArrow(_areas(units, False), "h long, c long, first long, copies long, left int, n int, area binary")
    examined = areas.repartition("h").sortWithinPartitions("h").mapInArrow(_examine(work), FOUND)
    many = several.where("crowd").groupBy("rid", "did").agg(F.collect_list("class").alias("classes")).join(rows, ["rid", "did"]).dropDuplicates(["rid", "did"]).select("classes", "text", "did", "row")
    each = many.mapInArrow(_areas(units, True), "h long, c long, first long, copies long, parts int, keys array<long>").withColumn("part", F.pmod("c", F.col("parts")).cast("int"))
    known = each.groupBy("h", "part").applyInArrow(_count_part, _COUNTS)
    met = known.groupBy("h", "bucket").applyInArrow(_meet, _COUNTS).select(F.col("h").alias("met_h"), F.col("part").alias("met_part"), "keys", "first", "times")
    counted = each.groupBy("h", "part").cogroup(met.groupBy("met_h", "met_part")).applyInArrow(_tell, FOUND)
    results = alone.unionByName(examined).unionByName(counted)
    goes: Column = F.filter("runs", lambda r: r["first"] < F.col("did")) if across else F.filter("runs", lambda r: r["again"])
    hits = held.select("h", "c", "rid", "did", "s").join(results, ["h", "c"]).select("rid", "did", F.transform(goes, lambda r: F.struct((F.col("s") + r["a"]).alias("start"), (F.col("s") + r["b"] + F.lit(units.window)).alias("end"))).alias("spans"))
    return hits.where(F.size("spans") > 0).groupBy("rid", "did").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merge_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def finish(rows: DataFrame, spans: DataFrame, cut: Callable, fields: list[tuple[str, str]]) -> DataFrame:
    """Gives each row its spans and cuts them out; the columns of `row` come first."""
    whole = rows.join(spans, ["rid", "did"], "left").select("row", "text", "spans", "did")
    return whole.mapInArrow(cut, T.StructType([rows.schema["row"], *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])).select("row.*", *[name for name, _ in fields])
