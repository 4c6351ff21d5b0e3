"""Records as BibTeX, JSON, YAML and report lines, in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import scalars as S
from folioscope.sources.payloads import RECORD


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))


def _entry(kind: str, key: Column, lines: list[Column], closing: str = "\n}") -> Column:
    return F.concat(F.lit(f"@{kind}{{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit(closing))


def _people() -> Column:
    return F.array_join("authors", " and ")


def _key() -> Column:
    return S.cite_key(F.col("authors"), F.col("year"), F.col("title"))


def bib_entry(entry_type: Column, key: Column, fields: Column) -> Column:
    """An entry with its fields in order."""
    lines = F.transform(fields, lambda f: F.concat(F.lit("  "), f["name"], F.lit(" = {"), f["value"], F.lit("}")))
    body = F.when(F.size(fields) > 0, F.concat(F.array_join(lines, ",\n"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("@"), entry_type, F.lit("{"), key, F.lit(",\n"), body, F.lit("}"))


def arxiv_bibtex(arxiv_id: Column) -> Column:
    """Of record columns; a paper with a venue is in proceedings."""
    head = [_line("title", F.col("title")), _line("author", _people())]
    tail = [_line("year", F.col("year")), _line("eprint", arxiv_id), _line("archivePrefix", F.lit("arXiv"))]
    return F.when(F.col("venue").isNotNull(), _entry("inproceedings", _key(), [*head, _line("booktitle", F.col("venue")), *tail], ",\n}")).otherwise(_entry("article", _key(), [*head, *tail], ",\n}"))


def preprint_bibtex(arxiv_id: Column) -> Column:
    """Of a lookup, which names no venue."""
    return _entry("article", _key(), [_line("title", F.col("title")), _line("author", _people()), _line("year", F.col("year")), _line("eprint", arxiv_id), _line("archivePrefix", F.lit("arXiv"))], ",\n}")


def book_bibtex() -> Column:
    """One author, publisher and ISBN if known."""
    author = F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("Unknown"))
    return _entry("book", _key(), [_line("title", F.col("title")), _line("author", author), _line("year", F.col("year")), _line("publisher", F.col("venue")), _line("isbn", F.col("isbn"))])


def fallback_bibtex() -> Column:
    """For records without an identifier."""
    return _entry("inproceedings", _key(), [_line("title", F.col("title")), _line("author", _people()), _line("year", F.col("year")), _line("booktitle", F.col("venue"))])


def misc_bibtex(key: Column, howpublished: Column, note: Column) -> Column:
    """Optional fields are left out."""
    return _entry("misc", key, [_line("title", F.col("title")), _line("author", _people()), _line("year", F.col("year")), _line("howpublished", howpublished), _line("note", note)], ",\n}")


def record_json(brief: bool = False) -> Column:
    """What is null is left out; brief also leaves out categories, date and PDF, and cuts the
    abstract at 150 bytes."""
    order = ["title", "authors", "year", "doi", "arxiv_id", "venue", "isbn", "pdf_url", "abstract", "citations", "categories", "published_date"]
    shown = [c for c in order if not brief or c not in ("categories", "published_date", "pdf_url")]
    special = {"categories": F.when(F.size("categories") > 0, F.col("categories")), "abstract": S.truncate_bytes(F.col("abstract"), 150) if brief else F.col("abstract")}
    return F.to_json(F.struct(*[special.get(c, F.col(c)).alias(c) for c in shown]))


def source_yaml(field: str, identifier: Column, retrieved: Column) -> Column:
    """Field is arxiv or doi."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [("title", quoted(F.col("title"))), ("authors", quoted(_people())), ("year", F.col("year")), (field, quoted(identifier)), ("retrieved", quoted(retrieved))]
    return F.concat(*[x for name, value in parts for x in (F.lit(f"{name}: "), value, F.lit("\n"))])


def report_line(place: Column) -> Column:
    """A numbered line; three authors at most, then et al."""
    names = F.when(F.size("authors") > 3, F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.lit(" et al."))).otherwise(F.array_join("authors", ", "))
    cited = F.when(F.col("citations").isNotNull(), F.concat(F.lit(" ["), F.col("citations").cast("string"), F.lit(" citations]"))).otherwise("")
    return F.concat(place.cast("string"), F.lit(". "), S.truncate(F.col("title"), 80), F.lit(" ("), F.col("year"), F.lit(") "), names, cited)


def byte_size(n: Column) -> Column:
    """Bytes in B, KB, MB or GB; halves go to the even digit."""
    steps = [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for size, unit in reversed(steps):
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", F.bround(n / size, 1))).otherwise(out)
    return out


def to_rows(records: DataFrame) -> DataFrame:
    """records as stored rows: unknown years null, categories joined, venue as journal."""
    return records.select("title", F.to_json("authors").alias("authors"), F.nullif("year", F.lit("?")).alias("year"), "doi", "arxiv_id", "isbn", "s2_id", "abstract", "pdf_url", F.col("citations").alias("citation_count"), F.col("venue").alias("journal"), F.when(F.size("categories") > 0, F.array_join("categories", ", ")).alias("categories"))


def from_rows(rows: DataFrame) -> DataFrame:
    """and back; authors that are no JSON array are none."""
    none = F.array().cast("array<string>")
    given = {"authors": F.coalesce(F.from_json("authors", "array<string>"), none), "year": F.coalesce("year", F.lit("?")), "citations": F.col("citation_count"), "venue": F.col("journal"), "categories": F.coalesce(F.split("categories", ", "), none), "published_date": F.lit(None).cast("string")}
    return rows.select(*[given.get(c, F.col(c)).alias(c) if c in given or c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in RECORD.items()])
