"""XML and text sources: Atom entries, MARC records, BibTeX, key-value files, LaTeX, HTML indexes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from folioscope.functions import scalars as S
from folioscope.sources.payloads import _record

_ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, link array<struct<_title:string,_href:string>>, category array<struct<_term:string>>"
#: Never inferred: inference makes numbers of tags like 008 and a struct of a lone field.
MARC = "controlfield array<struct<_VALUE:string,_tag:string>>, datafield array<struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_VALUE:string,_code:string>>>>"


def _collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def atom_entry(df: DataFrame) -> DataFrame:
    """The record of the first entry of each Atom body; bodies without one give no row."""
    xml = F.nullif(F.regexp_extract("body", r"(?s)<entry[ >].*?</entry>|<entry>.*?</entry>", 0), F.lit(""))
    plain = F.regexp_replace(xml, r"(</?)[A-Za-z]+:", "$1")
    e = F.from_xml(plain, _ENTRY, {"mode": "PERMISSIVE"})
    rest = [c for c in df.columns if c != "body"]
    rows = df.where(xml.isNotNull()).select(*rest, e.alias("e"))
    c = F.col("e")
    summary = _collapsed(c["summary"])
    pdf = F.try_element_at(F.filter(c["link"], lambda k: k["_title"] == "pdf"), F.lit(1))["_href"]
    date = F.left(F.trim(c["published"]), F.lit(10))
    return rows.select(*rest, F.lit(0).alias("pos"), *_record(title=_collapsed(c["title"]), authors=F.transform(c["author"], lambda a: F.trim(a["name"])), year=F.coalesce(F.left(date, F.lit(4)), F.lit("?")), arxiv_id=S.arxiv_id_of_url(F.trim(c["id"])), pdf_url=pdf, abstract=S.truncate_bytes(summary, 200), published_date=date, categories=F.array_distinct(F.transform(c["category"], lambda k: k["_term"]))))


def _data(tag: str | tuple[str, ...], code: str) -> Column:
    """All subfields of a code in the data fields of a tag, in order."""
    tags = (tag,) if isinstance(tag, str) else tag
    fields = F.filter("datafield", lambda f: f["_tag"].isin(*tags))
    return F.flatten(F.transform(fields, lambda f: F.transform(F.filter(f["subfield"], lambda s: s["_code"] == code), lambda s: s["_VALUE"])))


def marc_records(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue records of MARCXML files, also gzipped; those without a title are left out."""
    return marc_fields(spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(MARC).load(path))


def marc_fields(raw: DataFrame) -> DataFrame:
    first = lambda x: F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(""))
    strip = lambda x, chars: F.regexp_replace(x, f"[{chars}]+\\z", "")
    a, b = first(_data("245", "a")), first(_data("245", "b"))
    title = F.when(b == "", strip(a, "/ ")).otherwise(F.trim(F.concat(strip(a, "/ :"), F.lit(" "), strip(b, "/ "))))
    authors = F.transform(F.concat(_data("100", "a"), _data("700", "a")), lambda x: strip(x, ",. "))
    fixed = F.try_element_at(F.filter("controlfield", lambda c: c["_tag"] == "008"), F.lit(1))["_VALUE"]
    coded = F.substring(fixed, 8, 4)
    year = F.coalesce(F.when(coded.rlike(r"^[0-9]{4}\z"), coded), S.four_digits(first(_data(("260", "264"), "c"))), F.lit(""))
    urls = _data("856", "u")
    doi = F.try_element_at(F.filter(urls, lambda u: u.contains("doi.org/")), F.lit(1))
    out = raw.select(title.alias("title"), F.array_join(authors, ", ").alias("authors"), year.alias("year"), F.split(F.trim(first(_data("020", "a"))), r"\s+")[0].alias("isbn"), F.trim(first(_data("022", "a"))).alias("issn"), F.coalesce(S.doi_from_url(doi), F.lit("")).alias("doi"), first(urls).alias("url"), (F.size(urls) > 0).alias("online"), strip(first(_data(("260", "264"), "b")), ",:; ").alias("publisher"))
    return out.where("title <> ''")


# -- BibTeX -----------------------------------------------------------------------------------------

_OPEN = re.compile(r"@([^{\s]*)[^{]*\{\s*([^,\s]*)")
_BREAK = re.compile("\r\n|[\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029]")
_FIELD = re.compile(r"\s*,?\s*([^\s=}{,]+)\s*=\s*")
# The mark that leaves an entry out, and entry types that hold no record.
SKIP_MARK = "% lit:skip"
SKIPPED_TYPES = ("comment", "preamble", "string")


def _value(text: str, at: int) -> tuple[str, int]:
    """A braced, quoted or bare value and where it ends."""
    if at < len(text) and text[at] == "{":
        depth, end = 1, at + 1
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        return text[at + 1 : end - 1 if not depth else end], end
    if at < len(text) and text[at] == '"':
        m = re.compile(r'"((?:\\.|[^"\\])*)("|\Z)', re.S).match(text, at)
        return (m[1], m.end()) if m else (text[at + 1 :], len(text))
    m = re.compile(r"[^,}\s]*").match(text, at)
    return m[0], m.end()


def bib_entries(text: str) -> Iterator[tuple[str, str, list[tuple[str, str]], int, int, int]]:
    """(type, key, fields, place, start, end) of each entry, in order; comments, preambles, strings and
    entries with a skip mark in the three lines before them are left out."""
    at = place = 0
    #: lines that ended before `counted`; the line of the last mark before it, and the place of the next
    lines, counted, marked_line, mark = 0, 0, -4, text.find(SKIP_MARK)
    while m := _OPEN.search(text, at):
        start, kind = m.start(), m[1].lower()
        while 0 <= mark <= start - len(SKIP_MARK):
            lines += sum(1 for _ in _BREAK.finditer(text, counted, mark))
            counted, marked_line, mark = mark, lines, text.find(SKIP_MARK, mark + 1)
        lines += sum(1 for _ in _BREAK.finditer(text, counted, start))
        counted = start
        fields: list[tuple[str, str]] = []
        at = m.end()
        while at < len(text):
            if f := _FIELD.match(text, at):
                value, at = _value(text, f.end())
                fields.append((f[1].lower(), value))
                continue
            rest = re.compile(r"[\s,]*").match(text, at).end()
            if rest < len(text) and text[rest] == "}":
                at = rest + 1
                break
            if rest < len(text) and text[rest] == "@":
                at = rest
                break
            at = rest + 1
        open_line = start > 0 and not _BREAK.match(text, start - 1)
        marked = marked_line >= lines + open_line - 3
        if kind not in SKIPPED_TYPES and not marked:
            yield kind, m[2].strip(), fields, place, start, at
            place += 1


@udtf(returnType="entry_type string, key string, fields array<struct<name:string,value:string>>, pos int")
class BibTeX:
    """S19 as a table function: its braces nest, which no regular expression follows."""

    def eval(self, content: str):
        for kind, key, fields, place, _, _ in bib_entries(content or ""):
            yield kind, key, fields, place


def bib_table(files: DataFrame, column: str = "value") -> DataFrame:
    """The entries of a table of whole files, with the other columns of their file."""
    spark = files.sparkSession
    spark.udtf.register("folioscope_bibtex", BibTeX)
    rest = ", ".join(f"f.`{c}`" for c in files.columns if c != column)
    return spark.sql(f"SELECT {rest + ', ' if rest else ''}b.* FROM {{files}} f, LATERAL folioscope_bibtex(f.`{column}`) b", files=files)


def verification_entries(bib: DataFrame) -> DataFrame:
    """entry_type, key, pos, title without braces, last name of the first author, year, doi, eprint."""
    get = lambda name: F.coalesce(S.bib_field(F.col("fields"), name), F.lit(""))
    title = F.regexp_replace(get("title"), r"[{}]", "")
    first = F.split(F.split(get("author"), " and ")[0], ",")[0]
    return bib.select("entry_type", "key", "pos", F.when(title == "", "[no title]").otherwise(title).alias("title"), F.when(F.trim(first) == "", "").otherwise(S.last_name(first)).alias("author"), get("year").alias("year"), get("doi").alias("doi"), get("eprint").alias("eprint"))


def bib_record(bib: DataFrame) -> DataFrame:
    """The record of each file's first entry."""
    get = lambda name: S.bib_field(F.col("fields"), name)
    people = F.transform(F.split(get("author"), " and "), lambda a: S.invert_name(F.trim(a)))
    return bib.where("pos = 0").select(*[c for c in bib.columns if c not in ("entry_type", "key", "fields", "pos")], "pos", *_record(title=F.coalesce(get("title"), F.lit("")), year=F.coalesce(get("year"), F.lit("?")), doi=get("doi"), authors=F.filter(people, lambda a: a != ""), venue=get("journal")))


# -- other text files ---------------------------------------------------------------------------------


#: Fields that a key-value file may set, by the names it may use for them.
YAML_FIELDS = {"title": "title", "authors": "authors", "author": "authors", "year": "year", "arxiv": "arxiv_id", "doi": "doi", "journal": "journal", "volume": "volume", "number": "number", "pages": "pages", "url": "url", "publisher": "publisher", "booktitle": "booktitle"}


def yaml_records(files: DataFrame, column: str = "value", path: str = "path") -> DataFrame:
    """A paper of each flat key-value file; the last of repeated keys counts, authors are split on " and "."""
    lines = F.filter(F.transform(F.split(column, r"\r?\n"), S.trimmed), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)\z", 1)).alias("v")))
    clean = F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.when(p["v"].rlike(r'^".*"\z') & (F.length(p["v"]) > 1), F.regexp_extract(p["v"], r'^"(.*)"\z', 1)).otherwise(p["v"]).alias("v")))
    rows = files.select(F.col(path).alias("local_path"), clean.alias("p"))

    def last(field: str) -> Column:
        names = [k for k, f in YAML_FIELDS.items() if f == field]
        return F.try_element_at(F.filter("p", lambda x: x["k"].isin(*names)), F.lit(-1))["v"]

    out = [F.coalesce(last("title"), F.lit("unknown")).alias("title"), F.coalesce(F.transform(F.split(last("authors"), " and "), S.trimmed), F.array().cast("array<string>")).alias("authors")]
    return rows.select(*out, *[last(f).alias(f) for f in dict.fromkeys(YAML_FIELDS.values()) if f not in ("title", "authors")], "local_path")


def cited_keys(files: DataFrame, column: str = "value") -> DataFrame:
    r"""The keys that \cite commands of LaTeX texts name, once each. A key may hold one level of braces."""
    groups = F.regexp_extract_all(column, F.lit(r"\\cite[^{\n]*\{((?:[^{}]|\{[^{}]*\})*)\}?"), F.lit(1))
    return files.select(F.explode(F.flatten(F.transform(groups, lambda g: F.split(g, ",")))).alias("key")).select(F.trim(F.regexp_replace("key", r"\s+", " ")).alias("key")).where("key <> ''").distinct()


def read_tex(spark: SparkSession, folder: str) -> DataFrame:
    """All .tex files below a folder."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.tex")


def index_files(pages: DataFrame, column: str = "html") -> DataFrame:
    """Names of the .xml.gz files that an HTML index links to."""
    links = F.regexp_extract_all(column, F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select(F.posexplode(links).alias("pos", "href")).where(F.col("href").endswith(".xml.gz")).select("pos", F.element_at(F.split("href", "/"), -1).alias("filename"))


def cached_files(spark: SparkSession, folder: str) -> DataFrame:
    """(cache_key, body, fetched_at) of a folder of captured bodies."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("cache_key"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("fetched_at"))


def paper_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Folders one level below that have a source.yaml, with its content."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="source.yaml").select(F.col("_metadata.file_path").alias("file"), "value")
    depth = F.size(F.split(F.regexp_replace("file", r"^file:/*", ""), "/")) - F.size(F.split(F.regexp_replace(F.regexp_replace(F.lit(folder), r"^file:/*", ""), r"^/+|/+\z", ""), "/"))
    return found.where(depth == 2).select(F.regexp_replace("file", r"/source\.yaml\z", "").alias("path"), "value")


def cookie_expiry(spark: SparkSession, path: str) -> DataFrame:
    """How many rows a Netscape cookie file has, and the least and largest expiry."""
    rows = spark.read.option("sep", "\t").option("comment", "#").csv(path)
    fifth = F.try_element_at(F.array(*[F.col(c) for c in rows.columns]), F.lit(5)).try_cast("bigint") if rows.columns else F.lit(None).cast("bigint")
    return rows.select(fifth.alias("e")).where("e is not null").agg(F.count("*").alias("n"), F.min("e").alias("first"), F.max("e").alias("last"))


def dump_papers(spark: SparkSession, path: str) -> DataFrame:
    """A dump of JSON lines, also gzipped; external ids as a map."""
    return spark.read.schema("id string, title string, abstract string, year int, venue string, citation_count bigint, external_ids map<string,string>").json(path)


def first_line_title(text: Column) -> Column:
    """The first trimmed line of more than 15 bytes."""
    return F.try_element_at(F.filter(F.transform(F.split(text, "\n"), S.trimmed), lambda x: F.octet_length(x) > 15), F.lit(1))


def preferred_text(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Of each folder's files (name, value) the main .tex, else a text, else a PDF: a priority, and
    the least of it. LaTeX files of which none is the main one are no text."""
    tex = F.col("name").endswith(".tex")
    rank = F.when(tex & F.col("value").contains("\\documentclass"), 0).when(tex & F.col("name").rlike(r"(^|/)(main|paper)\.tex\z"), 1).when(F.col("name").endswith("paper.txt") & (F.trim("value") != ""), 3).when(F.col("name").endswith("paper.pdf"), 4)
    return files.withColumn("rank", rank).where("rank is not null").groupBy(folder).agg(F.min_by(F.struct("name", "value"), F.struct("rank", "name")).alias("f")).select(folder, "f.name")


def resolve_folder(folders: DataFrame, asked: str) -> DataFrame:
    """(name, matches) of the best stage that finds any folder (name, content): the exact name, the name
    without dots, either containing the other, or the content. More than one is ambiguous."""
    q, low = F.lit(asked), F.lower("name")
    bare = F.replace(q, F.lit("."), F.lit(""))
    stage = F.when(F.col("name") == q, 0).when(F.replace("name", F.lit("."), F.lit("")) == bare, 1).when(low.contains(asked.lower()) | F.lower(q).contains(low), 2).when(F.col("content").contains(asked), 3)
    hits = folders.withColumn("stage", stage).where("stage is not null")
    best = hits.agg(F.min("stage").alias("best"))
    found = hits.crossJoin(F.broadcast(best)).where("stage = best")
    return found.select("name").crossJoin(F.broadcast(found.agg(F.count("*").alias("matches"))))
