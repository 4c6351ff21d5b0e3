"""Token counts of whole texts with a fixed public vocabulary.

Documents longer than a chunk are encoded in overlapping chunks, with offsets. Two chunks are
spliced where both begin a piece of the pre-tokenizer at the same place, away from the cuts: from
there on the left-to-right pre-tokenizer and the merges inside its pieces can't differ. Where
the overlap shows no such place, it is widened and the next chunk encoded again, up to the last
splice.

Texts of one chunk are cut at single spaces between two characters that are no white space, where the
pre-tokenizer always begins a new piece, and the library's count of a segment is remembered.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm import text as tx

#: Characters of a chunk, of the overlap of two, and from the end of a chunk that no splice is made
#: in (no rule of the pre-tokenizer looks more than three ahead).
CHUNK, OVERLAP, MARGIN = 1 << 15, 256, 16
#: Segments whose counts a task remembers, the longest of them, and texts handled at a time.
REMEMBERED, LONGEST, TEXTS = 1_200_000, 64, 256

_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")
RESULT = [("n_bytes", "long"), ("n_tokens", "long")]


def load(path: str):
    """The tokenizer of a .json file, without truncation or padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _bounds(tokenizer, text: str, base: int) -> tuple[list[int], list[tuple[int, int]], list[bool]]:
    """Ids, offsets, and whether each token begins a piece of the pre-tokenizer."""
    got = tokenizer.encode(text, add_special_tokens=False)
    word = got.word_ids
    return got.ids, [(a + base, b + base) for a, b in got.offsets], [w is None or not n or w != word[n - 1] for n, w in enumerate(word)]


def _meeting(left: tuple, right: tuple, low: int, high: int) -> tuple[int, int] | None:
    """Indexes into both chunks' tokens of the last boundary that is proven to be one of the whole text:
    both chunks begin a piece there, after the place `low`, where the right one was cut, and before
    `high`, so far from the end of the left one that no rule of the pre-tokenizer looks across it.

    Up to that place the left chunk reads the whole text from the left, as its pieces don't depend on
    what comes later; and from the beginning of a piece on all that follows depends only on what
    comes after it. So the right chunk, too, reads the whole text from there on."""
    there = {span[0]: j for j, (span, begins) in enumerate(zip(right[1], right[2])) if begins and span[0] > low}
    for i in range(len(left[0]) - 1, -1, -1):
        at = left[1][i][0]
        if at <= low:
            break
        if left[2][i] and at < high and at in there:
            return i, there[at]
    return None


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of a text, encoded chunk by chunk."""
    margin = max([margin, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
    left = _bounds(tokenizer, text[:chunk], 0)
    end, total, begin = min(chunk, len(text)), 0, 0
    while end < len(text):
        width, met, reach = max(overlap, 2 * margin), None, end
        while met is None:
            start = max(begin, end - width)
            #: the new chunk reaches beyond the old one, however wide the overlap is
            reach = min(len(text), end + chunk)
            right = _bounds(tokenizer, text[start:reach], start)
            met = _meeting(left, right, start + 1, end - margin)
            if met is None:
                if start == begin:
                    #: no boundary as far back as the last one: all since then is encoded anew
                    met = (0, 0)
                width *= 4
        total += met[0]
        left = tuple(x[met[1] :] for x in right)
        begin, end = left[1][0][0] if left[1] else begin, reach
    return total + len(left[0])


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes (of UTF-8) and n_tokens.

    path: a tokenizer file that every executor has. No begin, end or padding tokens are added;
    the strings of special tokens inside texts are read as the library does by default. Null
    and empty texts have 0 bytes and 0 tokens. A column with a result's name is replaced.
    """

    key = (path, chunk, overlap)

    def work(batch: pa.RecordBatch) -> dict:
        return _counter(*key).batch(batch.column(batch.schema.get_field_index(text)))

    return tx.with_results(docs, work, RESULT)


_counters: dict[tuple, "SegmentCounter"] = {}


def _counter(*key) -> "SegmentCounter":
    """The counter of a worker process, which serves all its tasks."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = SegmentCounter(load(key[0]), *key[1:])
    return _counters[key]


def _byte_letters() -> dict[str, str]:
    """The printable letter that byte-level vocabularies have in place of each byte: itself
    where it is printable Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): chr(0x100 + n) for n, b in enumerate(odd)}


class SegmentCounter:
    """Counts tokens of texts, with the counts of frequent segments at hand."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        #: strings that the library takes out of a text before anything else
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        #: With the byte-level pre-tokenizer alone, " letters" is one piece, which the model can
        #: be given at once, and a mark after it is another that no merge can reach across.
        self.pieces = type(tokenizer.pre_tokenizer).__name__ == "ByteLevel" and tokenizer.normalizer is None
        self.shown = str.maketrans(_byte_letters())

    def segments(self, asked: list[str]) -> list[int]:
        """The library's counts of segments."""
        out, hard = [0] * len(asked), []
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        for n, s in enumerate(asked):
            core, mark = (s[:-1], 1) if s[-1] in ".,;:!?" else (s, 0)
            if self.pieces and core[:1] == " " and core[1:].isalpha():
                out[n] = mark + len(tokenize(core.encode().decode("latin-1").translate(shown)))
            else:
                hard.append(n)
        for n, e in zip(hard, self.encode([asked[n] for n in hard], add_special_tokens=False)):
            out[n] = len(e)
        return out

    def batch(self, column: pa.Array) -> dict:
        counts: list[int] = []
        for at in range(0, len(column), TEXTS):
            counts += self.texts(column.slice(at, TEXTS).to_pylist())
        _, offsets = tx.buffers(column)
        return {"n_bytes": pa.array(offsets[1:] - offsets[:-1], pa.int64()), "n_tokens": pa.array(counts, pa.int64())}

    def texts(self, values: list[str | None]) -> list[int]:
        parts: list[list[str] | int] = []
        new: set[str] = set()
        known = self.known
        for value in values:
            if not value:
                parts.append(0)
            elif len(value) > self.chunk:
                parts.append(count_long(self.tokenizer, value, self.chunk, self.overlap))
            elif any(t in value for t in self.special):
                parts.append(len(self.tokenizer.encode(value, add_special_tokens=False)))
            else:
                first, *rest = _SINGLE.split(value) if _DOUBLE.search(value) or value[0] == " " or value[-1] == " " else value.split(" ")
                rest = [" " + x for x in rest]
                rest.append(first)
                parts.append(rest)
                new.update(x for x in rest if x not in known)
        if new:
            if len(known) > REMEMBERED:
                #: those that came first are the frequent ones: they stay
                self.known = known = dict(islice(known.items(), REMEMBERED // 3))
                new = {x for p in parts if isinstance(p, list) for x in p if x not in known}
            ask = list(new)
            known.update(zip(ask, self.segments(ask)))
        out = [p if isinstance(p, int) else sum(map(known.__getitem__, p)) for p in parts]
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        return out
