"""Ranked search: local full text with BM25, and reranking of results of several sources."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scalars as S

#: The order in which sources are tried, and the score of a first row that ends the search.
CASCADE, THRESHOLD = ("ss", "oa", "cr", "book", "clio"), 0.3
K1, B = 1.2, 0.75


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters they are made of, by decomposition."""
    marked = [chr(c) for c in range(0xC0, 0x250) if chr(c) == chr(c).lower() and len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def fts_tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits, accents folded."""
    return F.filter(F.split(F.translate(F.lower(x), *_folding()), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fold(word: str) -> str:
    return word.lower().translate(str.maketrans(*_folding()))


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(doc, part, place, term): every token, with the column it is in and its place there."""
    parts = F.array(*[F.struct(F.lit(c).alias("part"), fts_tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("terms")) for c in columns])
    each = docs.select(F.col(key).alias("doc"), F.explode(parts).alias("p"))
    return each.select("doc", F.col("p.part").alias("part"), F.posexplode("p.terms").alias("place", "term"))


def maintain_postings(index: DataFrame, changed: DataFrame, gone: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The index after documents were added, changed (whole rows) or removed (keys): only theirs
    is made anew."""
    touched = changed.select(F.col(key).alias("doc")).unionAll(gone.select(F.col(key).alias("doc"))).distinct()
    return index.join(touched, "doc", "left_anti").unionByName(postings(changed, key, columns))


@dataclass
class Query:
    """A node of a parsed query: phrase (terms, the last perhaps a prefix, perhaps in one column),
    and / or / not, or near."""

    kind: str
    terms: list[str] = field(default_factory=list)
    prefix: bool = False
    part: str | None = None
    args: list["Query"] = field(default_factory=list)
    within: int = 10


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*)?|(NEAR)\(|([\w\u0080-\U0010ffff]+)(\s*:)?(\*)?|([(),:*]))')


def parse_query(text: str) -> Query:
    """Words are ANDed; AND, OR, NOT, "phrases", prefix*, column: and NEAR(a b, n). Raises ValueError on
    other punctuation."""
    found, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"syntax error near {text[at:at + 10]!r}")
        found.append(m)
        at = m.end()
    place = 0

    def peek():
        return found[place] if place < len(found) else None

    def word(m) -> str | None:
        return m[4] if m and m[4] and not m[5] else None

    def either() -> Query:
        nonlocal place
        args = [both()]
        while word(peek()) == "OR":
            place += 1
            args.append(both())
        return args[0] if len(args) == 1 else Query("or", args=args)

    def both() -> Query:
        nonlocal place
        args = [without()]
        while (m := peek()) and m[7] != ")" and word(m) != "OR":
            if word(m) == "AND":
                place += 1
            args.append(without())
        return args[0] if len(args) == 1 else Query("and", args=args)

    def without() -> Query:
        nonlocal place
        out = single()
        while word(peek()) == "NOT":
            place += 1
            out = Query("not", args=[out, single()])
        return out

    def single(part: str | None = None) -> Query:
        nonlocal place
        m = peek()
        if m is None:
            raise ValueError("the query ends early")
        place += 1
        if m[7] == "(":
            out = either()
            if not peek() or peek()[7] != ")":
                raise ValueError("a bracket is not closed")
            place += 1
            return out
        if m[3]:
            args, within = [], 10
            while peek() and peek()[7] not in (")", ","):
                args.append(single(part))
            if peek() and peek()[7] == ",":
                place += 1
                within = int(peek()[4])
                place += 1
            if not peek() or peek()[7] != ")":
                raise ValueError("a bracket is not closed")
            place += 1
            return Query("near", args=args, within=within)
        if m[1] is not None:
            return Query("phrase", [fold(t) for t in re.findall(r"[^\W_]+", m[1])], bool(m[2]), part)
        if m[4] and m[5]:
            return single(m[4])
        if m[4] and m[4] not in ("AND", "OR", "NOT"):
            return Query("phrase", [fold(t) for t in re.findall(r"[^\W_]+", m[4])], bool(m[6]), part)
        raise ValueError(f"syntax error near {m[0].strip()!r}")

    out = either()
    if place != len(found):
        raise ValueError("syntax error")
    return out


def _tokens(columns: list[str]) -> Column:
    """The tokens of each column, in one struct."""
    return F.struct(*[fts_tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])


def _places(tokens: Column, phrase: Query) -> Column:
    """Where a phrase begins among the tokens of one column, as an array."""
    n = len(phrase.terms)
    none = F.array().cast("array<int>")
    if not n:
        return none

    def here(at: Column) -> Column:
        out = F.lit(True)
        for j, term in enumerate(phrase.terms):
            token = F.get(tokens, at + j)
            out = out & (token.startswith(term) if phrase.prefix and j == n - 1 else token == term)
        return out

    return F.when(F.size(tokens) >= n, F.filter(F.sequence(F.lit(0), F.size(tokens) - n), here)).otherwise(none)


def _parts_of(phrase: Query, columns: list[str]) -> list[str]:
    return [c for c in columns if phrase.part is None or c == phrase.part]


def _anywhere(toks: Column, phrase: Query, columns: list[str]) -> Column:
    out = F.lit(False)
    for c in _parts_of(phrase, columns):
        out = out | (F.size(_places(toks[c], phrase)) > 0)
    return out


def _beside(toks: Column, q: Query, i: int, column: str) -> Column:
    """Places of the i-th phrase of a NEAR in a column that have places of all others so close that at
    most `within` tokens lie between the end of the first and the start of the last."""
    others = [j for j in range(len(q.args)) if j != i]
    if any(column not in _parts_of(a, [column]) for a in q.args):
        return F.array().cast("array<int>")

    def close(left: list[int], starts: list[Column], ends: list[Column]) -> Column:
        if not left:
            return (F.greatest(*starts) - F.least(*ends) if len(starts) > 1 else F.lit(0)) <= q.within
        size = len(q.args[left[0]].terms)
        return F.exists(_places(toks[column], q.args[left[0]]), lambda p: close(left[1:], [*starts, p], [*ends, p + size]))

    return F.filter(_places(toks[column], q.args[i]), lambda p: close(others, [p], [p + len(q.args[i].terms)]))


def _matches(toks: Column, q: Query, columns: list[str]) -> Column:
    """Whether a document matches, from its own tokens."""
    if q.kind == "phrase":
        return _anywhere(toks, q, columns)
    if q.kind == "near":
        out = F.lit(False)
        for c in columns:
            out = out | (F.size(_beside(toks, q, 0, c)) > 0)
        return out
    first, *rest = [_matches(toks, a, columns) for a in q.args]
    for r in rest:
        first = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a, b: a & ~b}[q.kind](first, r)
    return first


def _counted(toks: Column, q: Query, columns: list[str]) -> list[tuple[Column, Column]]:
    """For each phrase that counts for the score (not what a NOT excludes) whether it is anywhere, and
    how often it counts: in a NEAR only beside the others."""
    if q.kind == "phrase":
        return [(_anywhere(toks, q, columns), sum((F.size(_places(toks[c], q)) for c in _parts_of(q, columns)), F.lit(0)))]
    if q.kind == "near":
        return [(_anywhere(toks, p, columns), sum((F.size(_beside(toks, q, i, c)) for c in columns), F.lit(0))) for i, p in enumerate(q.args)]
    return [p for a in (q.args[:1] if q.kind == "not" else q.args) for p in _counted(toks, a, columns)]


def matching(docs: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """The documents that match, decided row by row; nothing is shuffled. ValueError for a query that
    can't be parsed."""
    parsed = parse_query(query)
    #: bound by a function over one element, so that they are made once for a row, not for each use
    return docs.where(F.transform(F.array(_tokens(columns)), lambda toks: _matches(toks, parsed, columns))[0])


def bm25(docs: DataFrame, query: str, key: str, columns: list[str]) -> DataFrame:
    """(doc, score) of the documents that match; smaller is better, as the usual table
    function of SQLite has it. All documents count for the statistics.

    A phrase is one unit, with its own count and document frequency. Each document's counts come from
    its own tokens; they are written once to the shared folder, the sums of them are one row, and
    no text and no posting is shuffled."""
    from folioscope.operators.graph import checkpoint_folder

    checkpoint_folder(docs.sparkSession)
    parsed = parse_query(query)
    rows = docs.select(F.col(key).alias("doc"), _tokens(columns).alias("toks"))
    toks = F.col("toks")
    phrases = _counted(toks, parsed, columns)
    size = sum((F.size(toks[c]) for c in columns), F.lit(0))
    counts = rows.select("doc", size.alias("dl"), _matches(toks, parsed, columns).alias("hit"), F.array(*[a for a, _ in phrases]).alias("has"), F.array(*[t for _, t in phrases]).alias("tf")).checkpoint()
    whole = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col("has")[i]).alias(f"df{i}") for i in range(len(phrases))])
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col("tf")[i]
        score = score + F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return counts.where("hit").crossJoin(F.broadcast(whole)).select("doc", (-score).alias("score"))


def search_local(docs: DataFrame, query: str, key: str, columns: list[str], limit: int, live: Column | None = None) -> DataFrame:
    """The best documents of a query; deleted ones count, but don't show. Ties by key."""
    found = bm25(docs, query, key, columns).join(docs.where(live) if live is not None else docs, F.col("doc") == F.col(key))
    return found.drop("doc").orderBy("score", key).limit(limit)


def search_catalog(docs: DataFrame, query: str, key: str, columns: list[str], like: list[str], limit: int) -> DataFrame:
    """Full-text matches in key order; a query that can't be parsed is looked for as a
    part of the `like` columns instead. No hits are no hits."""
    try:
        hit = matching(docs, query, columns)
    except ValueError:
        hit = docs.where(contains_ascii(like, query))
    return hit.orderBy(key).limit(limit)


def contains_any(columns: list[str], text: str) -> Column:
    """Any column is like %text%, case-insensitively; wildcards in the text keep their meaning."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def contains_ascii(columns: list[str], text: str) -> Column:
    """P5: any column is like %text%, where only ASCII letters have no case; wildcards keep their meaning."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    own = "%" + text.translate(str.maketrans(upper, lower)) + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.translate(F.col(c), upper, lower).like(own), F.lit(False))
    return out


# -- results of several sources: (source_ord, pos, title, authors, doi, citations, ...) --------------


def merge_sources(results: list[DataFrame]) -> DataFrame:
    """Result lists in a fixed order, with source_ord."""
    out = None
    for n, r in enumerate(results):
        r = r.withColumn("source_ord", F.lit(n))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    return out


def dedup_by_doi(results: DataFrame, order: list[str]) -> DataFrame:
    """A10: of rows with a DOI, whatever its case, the first; rows without one all stay."""
    first = Window.partitionBy(F.lower("doi")).orderBy(*order)
    named = results.where("doi is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return named.unionByName(results.where("doi is null"))


def rerank(results: DataFrame, query: str, order: tuple[str, ...] = ("source_ord", "pos"), limit: int | None = None) -> DataFrame:
    """First by DOI, then relevance, then citations (null is 0), then arrival."""
    score = S.relevance(S.tokens(F.lit(query)), F.col("title"), F.col("authors"))
    out = dedup_by_doi(results, list(order)).withColumn("relevance", score).orderBy(F.desc("relevance"), F.desc(F.coalesce("citations", F.lit(0))), *order)
    return out.limit(limit) if limit is not None else out


def cascade(results: DataFrame, query: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of the first source whose first row is relevant enough (a book review is not); if
    none is, all rows. One aggregation over first rows decides; the rows are filtered by it."""
    score = F.when(S.is_book_review(F.col("title")), 0.0).otherwise(S.relevance(S.tokens(F.lit(query)), F.col("title"), F.col("authors")))
    tops = results.groupBy("source_ord").agg(F.min_by(F.struct("title", "authors"), "pos").alias("top")).select("source_ord", "top.*")
    chosen = tops.where(score >= threshold).agg(F.min("source_ord").alias("chosen"))
    return results.crossJoin(F.broadcast(chosen)).where("chosen is null or source_ord = chosen").drop("chosen")


def resolve_top(results: DataFrame, query: str) -> DataFrame:
    """The best row of the cascade."""
    return rerank(cascade(results, query), query, limit=1)
