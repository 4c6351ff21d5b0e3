"""JSON payloads of bibliographic services, parsed to one record shape with explicit schemas.

Every parser takes a table with a column `body` and returns one row for each record of each body,
with all other columns, pos (from 0) and the fields of RECORD. Bodies that aren't what the
service sends give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import scalars as S

#: The record shape: fields and types, in order. A year that isn't known is "?".
RECORD = {"title": "string", "authors": "array<string>", "year": "string", "doi": "string", "arxiv_id": "string", "citations": "bigint", "venue": "string", "pdf_url": "string", "abstract": "string", "isbn": "string", "s2_id": "string", "published_date": "string", "categories": "array<string>"}

PERSON, NAMED = "struct<name:string>", "array<struct<name:string>>"
_S2 = f"struct<paperId:string,title:string,year:int,authors:{NAMED},citationCount:bigint,venue:string,externalIds:struct<ArXiv:string,DOI:string>,openAccessPdf:struct<url:string>>"
_CR = "struct<title:array<string>,author:array<struct<given:string,family:string>>,published:struct<`date-parts`:array<array<int>>>,DOI:string,`is-referenced-by-count`:bigint,`container-title`:array<string>>"
_OL_BOOK = f"struct<title:string,subtitle:string,authors:{NAMED},publishers:{NAMED},publish_date:string,identifiers:struct<isbn_13:array<string>,isbn_10:array<string>>>"


def _record(**given: Column) -> list[Column]:
    return [given.get(name, F.lit(None)).cast(kind).alias(name) if name not in ("authors", "categories") else F.coalesce(given.get(name, F.lit(None)).cast(kind), F.array().cast(kind)).alias(name) for name, kind in RECORD.items()]


def _each(df: DataFrame, items: Column, fields: Callable[[Column], dict[str, Column]], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row for each item of a parsed array column."""
    rest = [c for c in df.columns if c != "body"]
    rows = df.select(*rest, F.posexplode(items).alias("pos", "item"))
    if keep is not None:
        rows = rows.where(keep(F.col("item")))
    return rows.select(*rest, "pos", *_record(**fields(F.col("item"))))


def _one(df: DataFrame, item: Column, fields: Callable[[Column], dict[str, Column]]) -> DataFrame:
    return _each(df, F.when(item.isNotNull(), F.array(item)), fields)


def _at(df: DataFrame, path: str, kind: str) -> Column:
    return F.from_json(F.get_json_object("body", path), kind)


def _first(x: Column) -> Column:
    return F.try_element_at(x, F.lit(1))


def _names(people: Column, rule: Callable[[Column], Column] | None = None) -> Column:
    named = F.filter(people, lambda p: p["name"].isNotNull())
    return F.transform(named, lambda p: rule(p["name"]) if rule else p["name"])


def _or(x: Column, other: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit(other))


def openalex_search(df: DataFrame) -> DataFrame:
    """S1"""
    kind = "array<struct<title:string,publication_year:int,authorships:array<struct<author:struct<display_name:string>>>,cited_by_count:bigint,doi:string>>"

    def fields(w: Column) -> dict[str, Column]:
        names = F.array_compact(F.transform(w["authorships"], lambda a: S.last_name(a["author"]["display_name"])))
        return {"title": S.plain_text(_or(w["title"], "N/A")), "year": _or(w["publication_year"], "?"), "authors": names, "doi": F.nullif(F.regexp_replace(w["doi"], r"^(https://doi\.org/)+", ""), F.lit("")), "citations": w["cited_by_count"]}

    return _each(df, _at(df, "$.results", kind), fields)


def openalex_work(df: DataFrame) -> DataFrame:
    """openalex_id, cited_by_count, oa_url of each body."""
    w = F.from_json("body", "struct<id:string,cited_by_count:bigint,open_access:struct<oa_url:string>>")
    return df.withColumn("w", w).select(*[c for c in df.columns if c != "body"], F.col("w.id").alias("openalex_id"), F.col("w.cited_by_count"), F.col("w.open_access.oa_url").alias("oa_url"))


def scholar_search(df: DataFrame) -> DataFrame:
    """S3"""
    return _each(df, _at(df, "$.data", f"array<{_S2}>"), lambda p: {"title": _or(p["title"], "N/A"), "year": _or(p["year"], "?"), "authors": _names(p["authors"], S.last_name), "doi": p["externalIds"]["DOI"], "arxiv_id": p["externalIds"]["ArXiv"], "citations": p["citationCount"]})


def scholar_paper(df: DataFrame) -> DataFrame:
    """Identifiers, venue (empty is none), citations and PDF of one paper."""
    return _one(df, F.from_json("body", _S2), lambda p: {"s2_id": p["paperId"], "doi": p["externalIds"]["DOI"], "arxiv_id": p["externalIds"]["ArXiv"], "venue": F.nullif(p["venue"], F.lit("")), "citations": p["citationCount"], "pdf_url": p["openAccessPdf"]["url"]})


def scholar_related(df: DataFrame, key: str) -> DataFrame:
    """Key is citedPaper or citingPaper; full names are kept."""
    p = lambda item: item[key]
    return _each(df, _at(df, "$.data", f"array<struct<{key}:{_S2}>>"), lambda i: {"title": _or(p(i)["title"], "N/A"), "year": _or(p(i)["year"], "?"), "authors": _names(p(i)["authors"]), "doi": p(i)["externalIds"]["DOI"], "arxiv_id": p(i)["externalIds"]["ArXiv"], "s2_id": p(i)["paperId"]}, lambda i: i[key].isNotNull())


def _crossref(w: Column) -> dict[str, Column]:
    people = F.filter(w["author"], lambda a: F.coalesce(a["family"], F.lit("")) != "")
    return {"title": _or(_first(w["title"]), "N/A"), "year": _or(_first(_first(w["published"]["date-parts"])), "?"), "authors": F.transform(people, lambda a: F.trim(F.concat(_or(a["given"], ""), F.lit(" "), a["family"]))), "doi": w["DOI"]}


def crossref_search(df: DataFrame) -> DataFrame:
    """S6"""
    return _each(df, _at(df, "$.message.items", f"array<{_CR}>"), lambda w: _crossref(w) | {"citations": w["is-referenced-by-count"]})


def crossref_doi(df: DataFrame) -> DataFrame:
    """Venue, but no citation count."""
    return _one(df, _at(df, "$.message", _CR), lambda w: _crossref(w) | {"venue": _first(w["container-title"])})


def dblp_search(df: DataFrame) -> DataFrame:
    """The author is an object, an array of objects or strings, or a string. Read as text, a
    field keeps its JSON, which the first character tells apart."""
    kind = "array<struct<info:struct<title:string,year:string,venue:string,url:string,authors:struct<author:string>>>>"

    def name(raw: Column) -> Column:
        return F.when(raw.startswith("{"), F.get_json_object(raw, "$.text")).otherwise(raw)

    def fields(h: Column) -> dict[str, Column]:
        i = h["info"]
        raw = i["authors"]["author"]
        several = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))
        return {"title": _or(i["title"], "N/A"), "year": _or(i["year"], "?"), "authors": F.array_compact(F.transform(several, lambda r: S.last_name(name(r)))), "venue": i["venue"], "pdf_url": i["url"]}

    return _each(df, _at(df, "$.result.hits.hit", kind), fields)


def _isbn_book(entry: Column) -> dict[str, Column]:
    b, key = entry["value"], entry["key"]
    title = _or(b["title"], "N/A")
    full = F.when(_or(b["subtitle"], "") != "", F.concat(title, F.lit(": "), b["subtitle"])).otherwise(title)
    isbn = F.coalesce(_first(b["identifiers"]["isbn_13"]), _first(b["identifiers"]["isbn_10"]), F.when(key.startswith("ISBN:"), F.expr("substring(item.key, 6)")))
    return {"title": full, "authors": _names(b["authors"]), "venue": _first(b["publishers"])["name"], "year": F.coalesce(S.year_from_date(b["publish_date"]), F.lit("?")), "isbn": isbn}


def openlibrary_isbn(df: DataFrame) -> DataFrame:
    """The one entry of an object keyed by ISBN."""
    return _each(df, F.slice(F.map_entries(F.from_json("body", f"map<string,{_OL_BOOK}>")), 1, 1), _isbn_book)


def openlibrary_isbn_detail(df: DataFrame) -> DataFrame:
    """Like S10, with subtitle, publisher and date as they are."""
    entries = F.slice(F.map_entries(F.from_json("body", f"map<string,{_OL_BOOK}>")), 1, 1)
    rest = [c for c in df.columns if c != "body"]
    b = F.col("item.value")
    return df.select(*rest, F.explode(entries).alias("item")).select(*rest, _or(b["title"], "N/A").alias("title"), b["subtitle"].alias("subtitle"), _names(b["authors"]).alias("authors"), _first(b["publishers"])["name"].alias("publisher"), b["publish_date"].alias("publish_date"), S.year_from_date(b["publish_date"]).alias("year"))


def openlibrary_search(df: DataFrame) -> DataFrame:
    """S12"""
    kind = "array<struct<title:string,first_publish_year:int,author_name:array<string>,isbn:array<string>>>"
    return _each(df, _at(df, "$.docs", kind), lambda b: {"title": _or(b["title"], "N/A"), "year": _or(b["first_publish_year"], "?"), "authors": F.transform(b["author_name"], S.last_name), "isbn": _first(b["isbn"])})


def openlibrary_work(df: DataFrame) -> DataFrame:
    """Title and keys of the authors."""
    w = F.from_json("body", "struct<title:string,authors:array<struct<author:struct<key:string>>>>")
    return df.withColumn("w", w).select(*[c for c in df.columns if c != "body"], F.col("w.title").alias("title"), F.array_compact(F.transform("w.authors", lambda a: a["author"]["key"])).alias("author_keys"))


_EDITION = "struct<title:string,publishers:array<string>,publish_date:string,authors:array<struct<key:string>>>"


def _edition(e: Column) -> list[Column]:
    return [e["title"].alias("title"), _first(e["publishers"]).alias("publisher"), F.coalesce(S.year_from_date(e["publish_date"]), F.lit("?")).alias("year"), F.array_compact(F.transform(e["authors"], lambda a: a["key"])).alias("author_keys")]


def openlibrary_edition(df: DataFrame) -> DataFrame:
    """S13"""
    return df.withColumn("e", F.from_json("body", _EDITION)).select(*[c for c in df.columns if c != "body"], *_edition(F.col("e")))


def openlibrary_editions(df: DataFrame) -> DataFrame:
    """All editions, place by year as text, so "?" comes after digits."""
    rest = [c for c in df.columns if c != "body"]
    rows = df.select(*rest, F.posexplode(F.from_json(F.get_json_object("body", "$.entries"), f"array<{_EDITION}>")).alias("pos", "e")).select(*rest, "pos", *_edition(F.col("e")))
    return rows.orderBy(*rest, "year", "pos")


def openlibrary_author(df: DataFrame) -> DataFrame:
    """S13"""
    return df.select(*[c for c in df.columns if c != "body"], F.coalesce(F.get_json_object("body", "$.name"), F.get_json_object("body", "$.personal_name")).alias("name"))


def philpapers_search(df: DataFrame) -> DataFrame:
    """An array, or an object with entries."""
    kind = f"array<struct<eId:string,title:string,pubYear:string,year:string,pub:string,journal:string,doi:string,authorsStr:string,authors:{NAMED}>>"
    root = F.when(F.ltrim("body").startswith("["), F.col("body")).otherwise(F.get_json_object("body", "$.entries"))

    def fields(e: Column) -> dict[str, Column]:
        listed = F.filter(F.transform(F.split(e["authorsStr"], ", "), S.trimmed), lambda a: a != "")
        url = F.when(_or(e["eId"], "") != "", F.concat(F.lit("https://philpapers.org/rec/"), e["eId"]))
        return {"title": _or(e["title"], "N/A"), "year": F.coalesce(e["pubYear"], e["year"], F.lit("?")), "authors": F.coalesce(_names(e["authors"], S.invert_name), listed), "venue": F.coalesce(e["pub"], e["journal"]), "doi": e["doi"], "pdf_url": url}

    return _each(df, F.from_json(root, kind), fields)


def unpaywall(df: DataFrame) -> DataFrame:
    """Title and the best open PDF of each body."""
    best = lambda f: F.get_json_object("body", f"$.best_oa_location.{f}")
    return df.select(*[c for c in df.columns if c != "body"], F.get_json_object("body", "$.title").alias("title"), F.coalesce(best("url_for_pdf"), best("url")).alias("pdf_url"))


def catalog_search(df: DataFrame) -> DataFrame:
    """Rows without a title are left out; URLs are the first http field of a piped list, DOIs apart."""
    kind = "array<struct<title_display:array<string>,author_facet:array<string>,pub_year_display:array<string>,url_munged_display:array<string>,pub_name_display:array<string>,isbn_display:array<string>>>"

    def fields(d: Column) -> dict[str, Column]:
        urls = F.array_compact(F.transform(d["url_munged_display"], lambda u: _first(F.filter(F.split(u, r"\|"), lambda p: p.startswith("http")))))
        doi = _first(F.array_compact(F.transform(F.filter(urls, lambda u: u.contains("doi.org/")), S.doi_from_url)))
        return {"title": _first(d["title_display"]), "authors": d["author_facet"], "year": _or(_first(d["pub_year_display"]), ""), "doi": doi, "pdf_url": _first(F.filter(urls, lambda u: ~u.contains("doi.org/"))), "venue": _first(d["pub_name_display"]), "isbn": F.split(F.ltrim(_first(d["isbn_display"])), r"\s+")[0]}

    return _each(df, _at(df, "$.response.docs", kind), fields, lambda d: _or(_first(d["title_display"]), "") != "")


#: Source names and their parsers of search results.
SEARCH: dict[str, Callable[[DataFrame], DataFrame]] = {"oa": openalex_search, "ss": scholar_search, "cr": crossref_search, "dblp": dblp_search, "book": openlibrary_search, "pp": philpapers_search, "clio": catalog_search}


def extract_conflict_fields(df: DataFrame) -> DataFrame:
    """(title, year, authors_text) of a body by its `source`, JSON or Atom. Names are given as the
    service writes them, joined by commas."""
    pick = lambda paths: F.coalesce(*[F.get_json_object("body", p) for p in paths])
    listed = lambda path, kind: F.from_json(F.get_json_object("body", path), f"array<{kind}>")
    atom = F.nullif(F.regexp_extract("body", r"(?s)<entry[ >].*?</entry>", 0), F.lit(""))
    title = F.coalesce(pick(["$.title", "$.message.title[0]"]), F.trim(F.regexp_extract(atom, r"(?s)<title[^>]*>(.*?)</title>", 1)))
    year = F.coalesce(pick(["$.publication_year", "$.year", "$.message.published.date-parts[0][0]"]), F.nullif(F.regexp_extract(atom, r"(?s)<published>([0-9]{4})", 1), F.lit("")))
    openalex = F.transform(listed("$.authorships", "struct<author:struct<display_name:string>>"), lambda a: a["author"]["display_name"])
    scholar = F.transform(listed("$.authors", "struct<name:string>"), lambda a: a["name"])
    crossref = F.transform(listed("$.message.author", "struct<given:string,family:string>"), lambda a: F.when(a["family"].isNotNull(), F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), a["family"]))))
    feed = F.when(atom.isNotNull(), F.transform(F.regexp_extract_all(atom, F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), lambda n: F.trim(n)))
    names = F.array_compact(F.coalesce(openalex, scholar, crossref, feed))
    return df.select(*[c for c in df.columns if c != "body"], F.nullif(title, F.lit("")).alias("title"), year.alias("year"), F.nullif(F.array_join(names, ", "), F.lit("")).alias("authors_text"))
