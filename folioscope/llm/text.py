"""Vectorised text handling shared by the corpus operators.

Texts arrive as Arrow string columns. Their UTF-8 buffers are viewed as numpy arrays and
worked on a slice of documents at a time, so that the temporary arrays stay small however
large a batch is; a single document longer than a slice gets a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are held in temporary arrays at a time.
SLICE_BYTES = 1 << 19

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: An odd base: it has an inverse modulo 2**64, which prefix hashes need.
BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(BASE, -1, 1 << 64)

#: ASCII A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes inside words [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes inside words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z and everything beyond ASCII).
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES * 5 // 4)
        out = []
        for b in (BASE, _INVERSE):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` reads the hash of any span in constant time."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that doesn't depend on where the span lies."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k values, by binary composition of a rolling polynomial."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, length, out, done, rest = values, 1, None, 0, k
    while True:
        if rest & 1:
            part = block[done : done + n]
            out = part if out is None else out * np.uint64(pow(BASE, length, 1 << 64)) + part
            done += length
        rest >>= 1
        if not rest:
            return mix(out)
        block = block[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + block[length:]
        length *= 2


#: Bits of a place in a number that holds a hash above it; the same for all slices and texts, so
#: that equal runs have their least hash at the same place wherever they are.
PLACE = np.uint64((1 << 32) - 1)


def placed(hashes: np.ndarray) -> np.ndarray:
    """Hashes, by their upper half, with their places: of equal ones the first is the least."""
    return (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` keys."""
    n, length = len(keys) - width + 1, 1
    if n <= 0:
        return keys[:0]
    while length * 2 <= width:
        keys = np.minimum(keys[:-length], keys[length:])
        length *= 2
    return np.minimum(keys[:n], keys[width - length : width - length + n])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (one more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes each; every row is in one."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of `inside` bytes that stays in one row, and the
    first word of each row (one more entry than rows)."""
    kept = inside[data]
    first, last = kept.copy(), kept.copy()
    first[1:] &= ~kept[:-1]
    last[:-1] &= ~kept[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = kept[edges]
    last[edges - 1] = kept[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return span_hash(prefix_hash(byte_values(data)), start, end)


def hash_limit(wanted: int, total: int) -> int:
    """The largest 64-bit hash that a sample of about `wanted` of `total` rows takes."""
    return (1 << 63) - 1 if wanted >= total else max(0, wanted) * (1 << 64) // max(1, total) - (1 << 63)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """For each item the row that holds it, of offsets as `word_bounds` gives them."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def with_results(df: DataFrame, work: Callable[[pa.RecordBatch], dict], fields: list[tuple[str, str]]) -> DataFrame:
    """All columns of df and those that `work` returns for a batch, by name; a column of df
    with the name of a result is replaced by it."""
    names = {f for f, _ in fields}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = work(batch)
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n]) for n, _ in fields]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + [n for n, _ in fields])

    return df.mapInArrow(run, schema)


def doc_input(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id (as a 64-bit integer) and the text, under fixed names: other columns, whatever
    they are called, can't get in the way."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def splittable(sums: DataFrame) -> DataFrame:
    """Sums by a key, dealt out anew, for a join on that key. Right after its aggregation this side
    would already be dealt by the key, and the tasks of the join, bound to it, would each have to
    take all rows that the other side has for a hot key. So the join deals both sides itself, and
    adaptive execution may split what is skewed. Only the sums are shuffled once more."""
    return sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")))
