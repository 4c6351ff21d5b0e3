"""Registered queries of sources, renderers and scalar rules, and their SQL.

Bodies, files and entries are made of the driver's tables, as the services and users send them; the
library reads them, and the SQL says what has to come out, from the tables alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scalars as S
from folioscope.operators import linkage, render
from folioscope.operators.graph import checkpoint_folder
from folioscope.plans import adapters as A
from folioscope.plans import commands
from folioscope.plans.queries import query
from folioscope.sources import markup, payloads, urls
from folioscope.streaming import ingest

L, C = F.lit, F.concat


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """(id, k, name, brand, kind, year) of part; k is the id as text."""
    p = F.col("p_partkey")
    return A.table(spark, d, "part").select(p.alias("id"), p.cast("string").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), (L(1970) + F.col("p_size")).cast("int").alias("y"))


_P = "p AS (SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS k, p_name AS name, p_brand AS brand, p_type AS kind, 1970 + p_size AS y FROM part)"


def _body(spark, d, body: Column) -> DataFrame:
    return _parts(spark, d).select("id", body.alias("body"))


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))


def _s(**fields) -> Column:
    return F.struct(*[v.alias(n) for n, v in fields.items()])


def _even(x: Column) -> Column:
    return F.when(F.col("id") % 2 == 0, x)


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, so that any engine compares them."""
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(c, "|").alias(c) if kinds[c] == "array<string>" else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in columns])


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the executors share, for queries that read files."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _doi() -> Column:
    return C(L("10.1/"), "k")


def _arxiv() -> Column:
    return C(L("2001."), F.lpad("k", 5, "0"))


_ARXIV = "'2001.' || lpad(k, 5, '0')"

# -- JSON payloads ------------------------------------------------------------------------------------


@query(f"""WITH {_P} SELECT id, 0::BIGINT AS pos, name || ' & ' || kind AS title, CAST(y AS VARCHAR) AS year, brand AS authors, '10.1/' || k AS doi, id AS citations FROM p
UNION ALL SELECT id, 1, 'N/A', '?', '', NULL, NULL FROM p""")
def payload_openalex_search(spark, d):
    work = _s(title=C(L("<i>"), "name", L("</i> &amp; "), "kind"), publication_year=F.col("y"), authorships=F.array(_s(author=_s(display_name=C(L("Ada "), "brand")))), cited_by_count=F.col("id"), doi=C(L("https://doi.org/"), _doi()))
    empty = work.getField("title")
    none = _s(title=F.nullif(empty, empty), publication_year=L(None).cast("int"), authorships=L(None).cast("array<struct<author:struct<display_name:string>>>"), cited_by_count=L(None).cast("bigint"), doi=L(None).cast("string"))
    return _flat(payloads.openalex_search(_body(spark, d, _json(results=F.array(work, none)))), "id", "pos", "title", "year", "authors", "doi", "citations")


@query(f"WITH {_P} SELECT id, 'W' || k AS openalex_id, id AS cited_by_count, CASE WHEN id % 2 = 0 THEN 'http://o/' || k END AS oa_url FROM p")
def payload_openalex_work(spark, d):
    return payloads.openalex_work(_body(spark, d, _json(id=C(L("W"), "k"), cited_by_count=F.col("id"), open_access=_s(oa_url=_even(C(L("http://o/"), "k")))))).withColumn("cited_by_count", F.col("cited_by_count").cast("bigint"))


def _scholar(**more) -> Column:
    fields = {"paperId": C(L("s"), "k"), "title": F.col("name"), "year": F.col("y"), "authors": F.array(_s(name=L("Grace Ann Hopper")), _s(name=F.col("brand"))), "citationCount": F.col("id"), "externalIds": _s(ArXiv=_even(_arxiv()), DOI=_doi())} | more
    return _s(**fields)


@query(f"WITH {_P} SELECT id, 0::BIGINT AS pos, name AS title, CAST(y AS VARCHAR) AS year, 'Hopper|' || brand AS authors, '10.1/' || k AS doi, CASE WHEN id % 2 = 0 THEN {_ARXIV} END AS arxiv_id, id AS citations FROM p")
def payload_scholar_search(spark, d):
    return _flat(payloads.scholar_search(_body(spark, d, _json(data=F.array(_scholar())))), "id", "pos", "title", "year", "authors", "doi", "arxiv_id", "citations")


@query(f"WITH {_P} SELECT id, 's' || k AS s2_id, '10.1/' || k AS doi, CASE WHEN id % 2 = 0 THEN {_ARXIV} END AS arxiv_id, CASE WHEN id % 3 <> 0 THEN brand END AS venue, id AS citations, 'http://f/' || k AS pdf_url FROM p")
def payload_scholar_paper(spark, d):
    body = _scholar(venue=F.when(F.col("id") % 3 == 0, "").otherwise(F.col("brand")), openAccessPdf=_s(url=C(L("http://f/"), "k")))
    return _flat(payloads.scholar_paper(_body(spark, d, F.to_json(body))), "id", "s2_id", "doi", "arxiv_id", "venue", "citations", "pdf_url")


@query(f"WITH {_P} SELECT id, direction, 1::BIGINT AS pos, name AS title, 'Grace Ann Hopper|' || brand AS authors, 's' || k AS s2_id FROM p, (VALUES ('refs'), ('cites')) v(direction)")
def payload_scholar_related(spark, d):
    out = []
    for direction, key in (("refs", "citedPaper"), ("cites", "citingPaper")):
        item = F.struct(_scholar().alias(key))
        none = F.struct(F.nullif(_scholar(), _scholar()).alias(key))
        out.append(payloads.scholar_related(_body(spark, d, _json(data=F.array(none, item))), key).withColumn("direction", L(direction)))
    return _flat(out[0].unionAll(out[1]), "id", "direction", "pos", "title", "authors", "s2_id")


def _crossref() -> Column:
    return F.struct(F.array("name").alias("title"), F.array(_s(given=L("Ada"), family=F.col("brand")), _s(given=L("x"), family=L(None).cast("string")), _s(given=L(None).cast("string"), family=L("Solo"))).alias("author"), F.struct(F.array(F.array(F.col("y"), L(1))).alias("date-parts")).alias("published"), _doi().alias("DOI"), F.col("id").alias("is-referenced-by-count"), F.array("kind").alias("container-title"))


@query(f"WITH {_P} SELECT id, 0::BIGINT AS pos, name AS title, 'Ada ' || brand || '|Solo' AS authors, CAST(y AS VARCHAR) AS year, '10.1/' || k AS doi, id AS citations FROM p")
def payload_crossref_search(spark, d):
    return _flat(payloads.crossref_search(_body(spark, d, _json(message=_s(items=F.array(_crossref()))))), "id", "pos", "title", "authors", "year", "doi", "citations")


@query(f"WITH {_P} SELECT id, name AS title, 'Ada ' || brand || '|Solo' AS authors, CAST(y AS VARCHAR) AS year, '10.1/' || k AS doi, kind AS venue, CAST(NULL AS BIGINT) AS citations FROM p")
def payload_crossref_doi(spark, d):
    return _flat(payloads.crossref_doi(_body(spark, d, _json(message=_crossref()))), "id", "title", "authors", "year", "doi", "venue", "citations")


@query(f"WITH {_P} SELECT id, name AS title, CAST(y AS VARCHAR) AS year, CASE id % 3 WHEN 0 THEN brand WHEN 1 THEN brand || '|Two' ELSE 'Text' END AS authors, kind AS venue, 'http://u/' || k AS pdf_url FROM p")
def payload_dblp_search(spark, d):
    who = F.when(F.col("id") % 3 == 0, C(L('{"text": "One '), "brand", L('"}'))).when(F.col("id") % 3 == 1, C(L('[{"text": "One '), "brand", L('"}, "Number Two"]'))).otherwise(L('"Plain Text"'))
    body = C(L('{"result": {"hits": {"hit": [{"info": {"title": "'), "name", L('", "year": "'), F.col("y").cast("string"), L('", "venue": "'), "kind", L('", "url": "http://u/'), "k", L('", "authors": {"author": '), who, L("}}}]}}}"))
    return _flat(payloads.dblp_search(_body(spark, d, body)), "id", "title", "year", "authors", "venue", "pdf_url")


def _book() -> Column:
    return _s(title=F.col("name"), subtitle=_even(F.col("kind")), authors=F.array(_s(name=L("Ada Lovelace")), _s(name=F.col("brand"))), publishers=F.array(_s(name=C(L("Press "), "k"))), publish_date=C(L("March "), F.col("y").cast("string")), identifiers=_s(isbn_13=F.when(F.col("id") % 3 == 0, F.array(C(L("978"), "k"))), isbn_10=F.when(F.col("id") % 3 == 1, F.array("k"))))


def _keyed() -> Column:
    return F.to_json(F.create_map(C(L("ISBN:9"), "k"), _book()))


@query(f"WITH {_P} SELECT id, CASE WHEN id % 2 = 0 THEN name || ': ' || kind ELSE name END AS title, 'Ada Lovelace|' || brand AS authors, 'Press ' || k AS venue, CAST(y AS VARCHAR) AS year, CASE id % 3 WHEN 0 THEN '978' || k WHEN 1 THEN k ELSE '9' || k END AS isbn FROM p")
def payload_isbn(spark, d):
    return _flat(payloads.openlibrary_isbn(_body(spark, d, _keyed())), "id", "title", "authors", "venue", "year", "isbn")


@query(f"WITH {_P} SELECT id, name AS title, CASE WHEN id % 2 = 0 THEN kind END AS subtitle, 'Ada Lovelace|' || brand AS authors, 'Press ' || k AS publisher, 'March ' || y AS publish_date, CAST(y AS VARCHAR) AS year FROM p")
def payload_isbn_detail(spark, d):
    return _flat(payloads.openlibrary_isbn_detail(_body(spark, d, _keyed())), "id", "title", "subtitle", "authors", "publisher", "publish_date", "year")


@query(f"WITH {_P} SELECT id, name AS title, CASE WHEN id % 2 = 0 THEN CAST(y AS VARCHAR) ELSE '?' END AS year, 'Lovelace' AS authors, k AS isbn FROM p")
def payload_book_search(spark, d):
    doc = _s(title=F.col("name"), first_publish_year=_even(F.col("y")), author_name=F.array(L("Ada Lovelace")), isbn=F.array("k", L("2")))
    return _flat(payloads.openlibrary_search(_body(spark, d, _json(docs=F.array(doc)))), "id", "title", "year", "authors", "isbn")


def _editions() -> Column:
    late = _s(title=C(L("late "), "name"), publishers=F.array(L("Late")), publish_date=C(L("May "), (F.col("y") + 5).cast("string")), authors=F.array(_s(key=C(L("/a/"), "k"))))
    none = _s(title=L("undated"), publishers=F.array(L("None")), publish_date=L(None).cast("string"), authors=F.array(_s(key=L("/a/0"))))
    early = _s(title=C(L("early "), "name"), publishers=F.array("brand"), publish_date=F.col("y").cast("string"), authors=F.array(_s(key=C(L("/a/"), "k"))))
    return F.array(late, none, early)


@query(f"""WITH {_P} SELECT 'work' AS what, id, name AS title, '/a/' || k || '|/a/x' AS author_keys, NULL AS publisher, NULL AS year FROM p UNION ALL SELECT 'edition', id, 'late ' || name, '/a/' || k, 'Late', CAST(y + 5 AS VARCHAR) FROM p
UNION ALL SELECT 'editions', id, 'late ' || name, '/a/' || k, 'Late', CAST(y + 5 AS VARCHAR) FROM p UNION ALL SELECT 'editions', id, 'undated', '/a/0', 'None', '?' FROM p UNION ALL SELECT 'editions', id, 'early ' || name, '/a/' || k, brand, CAST(y AS VARCHAR) FROM p UNION ALL SELECT 'author', id, 'N ' || k, '', NULL, NULL FROM p""")
def payload_works(spark, d):
    none = L(None).cast("string")
    work = payloads.openlibrary_work(_body(spark, d, _json(title=F.col("name"), authors=F.array(_s(author=_s(key=C(L("/a/"), "k"))), _s(author=_s(key=L("/a/x"))))))).select(L("work").alias("what"), "id", "title", "author_keys", none.alias("publisher"), none.alias("year"))
    one = payloads.openlibrary_edition(_body(spark, d, F.to_json(_editions()[0]))).select(L("edition"), "id", "title", "author_keys", "publisher", "year")
    several = payloads.openlibrary_editions(_body(spark, d, _json(entries=_editions()))).select(L("editions"), "id", "title", "author_keys", "publisher", "year")
    person = payloads.openlibrary_author(_body(spark, d, F.when(F.col("id") % 2 == 0, _json(name=C(L("N "), "k"))).otherwise(_json(personal_name=C(L("N "), "k"))))).select(L("author"), "id", "name", F.array().cast("array<string>"), none, none)
    return _flat(work.unionAll(one).unionAll(several).unionAll(person), "what", "id", "title", "author_keys", "publisher", "year")


@query(f"WITH {_P} SELECT k AS work, name AS title, brand AS publisher, CAST(y AS VARCHAR) AS year, 'Ada Lovelace' AS author FROM p")
def work_records(spark, d):
    p = _parts(spark, d)
    works = p.select(F.col("k").alias("work"), _json(title=F.col("name"), authors=F.array(_s(author=_s(key=C(L("/a/"), "k"))))).alias("body"))
    people = p.select(C(L("/a/"), "k").alias("key"), _json(name=L("Lovelace, Ada")).alias("body"))
    return commands.work_record(works, p.select(F.col("k").alias("work"), _json(entries=_editions()).alias("body")), people)


@query(f"WITH {_P} SELECT id, name AS title, CAST(y AS VARCHAR) AS year, CASE WHEN id % 2 = 0 THEN 'Ada Lovelace' ELSE 'A One|B Two' END AS authors, kind AS venue, '10.1/' || k AS doi, 'https://philpapers.org/rec/E' || k AS pdf_url FROM p")
def payload_philpapers_search(spark, d):
    entry = _s(eId=C(L("E"), "k"), title=F.col("name"), pubYear=F.col("y").cast("string"), pub=F.when(F.col("id") % 3 == 0, F.col("kind")), journal=F.col("kind"), doi=_doi(), authorsStr=L("A One, B Two, "), authors=_even(F.array(_s(name=L("Lovelace, Ada")))))
    body = F.when(F.col("id") % 4 < 2, F.to_json(F.array(entry))).otherwise(_json(entries=F.array(entry)))
    return _flat(payloads.philpapers_search(_body(spark, d, body)), "id", "title", "year", "authors", "venue", "doi", "pdf_url")


@query(f"WITH {_P} SELECT id, name AS title, CASE WHEN id % 2 = 0 THEN 'http://pdf/' || k ELSE 'http://any/' || k END AS pdf_url FROM p")
def payload_unpaywall(spark, d):
    return payloads.unpaywall(_body(spark, d, _json(title=F.col("name"), best_oa_location=_s(url_for_pdf=_even(C(L("http://pdf/"), "k")), url=C(L("http://any/"), "k")))))


@query(f"WITH {_P} SELECT id, name AS title, 'Lovelace, Ada|' || brand AS authors, CAST(y AS VARCHAR) AS year, '10.1/' || k AS doi, 'http://p/' || k AS pdf_url, kind AS venue, k AS isbn FROM p WHERE id % 5 <> 0")
def payload_catalog_search(spark, d):
    doc = _s(title_display=F.when(F.col("id") % 5 != 0, F.array("name")), author_facet=F.array(L("Lovelace, Ada"), F.col("brand")), pub_year_display=F.array(F.col("y").cast("string")), url_munged_display=F.array(C(L("x|https://doi.org/"), _doi(), L("|y")), C(L("a|http://p/"), "k")), pub_name_display=F.array("kind"), isbn_display=F.array(C("k", L(" (pbk)"))))
    return _flat(payloads.catalog_search(_body(spark, d, _json(response=_s(docs=F.array(doc))))), "id", "title", "authors", "year", "doi", "pdf_url", "venue", "isbn")


# -- XML, BibTeX and text files ------------------------------------------------------------------------


def _atom() -> Column:
    x = lambda tag, value: C(L(f"<{tag}>"), value, L(f"</{tag}>"))
    author = lambda n: x("author", x("name", n))
    summary = F.repeat(C("name", L(" ")), 20)
    return C(L('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>q</title><entry>'), x("id", C(L("http://arxiv.org/abs/"), _arxiv(), L("v2"))), x("published", C(F.col("y").cast("string"), L("-06-19T17:24:44Z"))), x("title", C("name", L("\n  "), "kind")), x("summary", summary), author(L("Ada Lovelace")), author(F.col("brand")), L('<link href="http://l" rel="alternate"/><link title="pdf" href="http://f/'), "k", L('"/><category term="cs.LG"/><category term="stat.ML"/><category term="cs.LG"/></entry></feed>'))


@query(f"""WITH {_P} SELECT id, name || ' ' || kind AS title, 'Ada Lovelace|' || brand AS authors, CAST(y AS VARCHAR) AS year, {_ARXIV} AS arxiv_id, 'http://f/' || k AS pdf_url, CASE WHEN length(trim(repeat(name || ' ', 20))) <= 200 THEN trim(repeat(name || ' ', 20)) ELSE left(trim(repeat(name || ' ', 20)), 200) || '...' END AS abstract, y || '-06-19' AS published_date, 'cs.LG|stat.ML' AS categories FROM p""")
def atom_entries(spark, d):
    return _flat(markup.atom_entry(_body(spark, d, _atom())), "id", "title", "authors", "year", "arxiv_id", "pdf_url", "abstract", "published_date", "categories")


def _marc() -> Column:
    field = lambda tag, *subs: C(L(f'<datafield tag="{tag}" ind1="1" ind2="0">'), *[C(L(f'<subfield code="{c}">'), v, L("</subfield>")) for c, v in subs], L("</datafield>"))
    fixed = C(L('<controlfield tag="008">850101s'), F.when(F.col("id") % 2 == 0, F.col("y").cast("string")).otherwise("uuuu"), L("    nyu</controlfield>"))
    title = F.when(F.col("id") % 5 == 0, L("")).when(F.col("id") % 3 == 0, field("245", ("a", C("name", L(" :"))), ("b", C("kind", L(" /"))))).otherwise(field("245", ("a", C("name", L(" /")))))
    return C(L("<record>"), fixed, title, field("100", ("a", L("Lovelace, Ada."))), field("700", ("a", C("brand", L(",")))), field("020", ("a", C("k", L(" (hb)")))), field("022", ("a", L("1234-5678"))), field("264", ("b", L("Press,")), ("c", C(L("c"), F.col("y").cast("string"), L(".")))), field("856", ("u", C(L("https://doi.org/"), _doi()))), L("</record>"))


#: Records of a file at most, as catalogues are sent; files of fewer records are four.
_MARC_RECORDS = 50_000


def _marc_files(spark, d) -> str:
    """Gzipped files, each one collection of records, written a record at a time."""
    where, p = _folder(spark, "marc"), _parts(spark, d)
    files = max(4, -(-p.count() // _MARC_RECORDS))
    n = (F.col("id") % files).alias("n")
    ends = F.array(_s(place=L(0), value=L('<collection xmlns="http://www.loc.gov/MARC21/slim">')), _s(place=L(2), value=L("</collection>")))
    frame = p.select(n).distinct().select("n", F.explode(ends).alias("e")).select("n", "e.*")
    rows = p.select(n, L(1).alias("place"), _marc().alias("value")).unionAll(frame)
    rows.repartition(files, "n").sortWithinPartitions("n", "place").select("n", "value").write.partitionBy("n").option("compression", "gzip").text(where)
    return f"{where}/n=*"


_MARC_SQL = f"WITH {_P} SELECT CASE WHEN id % 3 = 0 THEN name || ' ' || kind ELSE name END AS title, 'Lovelace, Ada, ' || brand AS authors, CAST(y AS VARCHAR) AS year, k AS isbn, '1234-5678' AS issn, '10.1/' || k AS doi, 'https://doi.org/10.1/' || k AS url, true AS online, 'Press' AS publisher FROM p WHERE id % 5 <> 0"


@query(_MARC_SQL)
def marc_catalog(spark, d):
    """From a gzipped file of records, as a catalogue is sent."""
    return markup.marc_records(spark, _marc_files(spark, d))


@query(_MARC_SQL)
def marc_ingest(spark, d):
    """The same through the resumable ingest, twice, which takes each file once."""
    where = _marc_files(spark, d)
    sink, ledger = _folder(spark, "sink"), _folder(spark, "ledger")
    for _ in range(2):
        ingest.ingest_catalog(spark, where, sink, ledger)
    return spark.read.parquet(sink)


def _bibtex() -> Column:
    return C(L("@comment{no}\n@Article{key"), "k", L(",\n  title = {The {"), "name", L('} Title}, author = "Ada \\"A\\" Lovelace and '), "brand", L(', B",\n  year = '), F.col("y").cast("string"), L(", doi = {10.1/"), "k", L("}\n}\n\n% lit:skip\n@book{skipped, title={S}}\n\n\n\n@misc{"), "k", L(", title = {"), "kind", L("}, DOI={10.1/x}, Doi={10.1/y}}\n"))


@query(f"""WITH {_P} SELECT id, 0::BIGINT AS pos, 'article' AS entry_type, 'key' || k AS key, 'title=The {{' || name || '}} Title;author=Ada \\"A\\" Lovelace and ' || brand || ', B;year=' || y || ';doi=10.1/' || k AS fields FROM p UNION ALL SELECT id, 1, 'misc', k, 'title=' || kind || ';doi=10.1/x;doi=10.1/y' FROM p""")
def bibtex_entries(spark, d):
    bib = markup.bib_table(_body(spark, d, _bibtex()), "body")
    return bib.select("id", F.col("pos").cast("bigint").alias("pos"), "entry_type", "key", F.array_join(F.transform("fields", lambda f: C(f["name"], L("="), f["value"])), ";").alias("fields"))


@query(f"""WITH {_P} SELECT 'key' || k AS key, 0::BIGINT AS pos, 'article' AS entry_type, 'The ' || name || ' Title' AS title, 'Lovelace' AS author, CAST(y AS VARCHAR) AS year, '10.1/' || k AS doi, '' AS eprint FROM p UNION ALL SELECT k, 1, 'misc', kind, '', '', '10.1/x', '' FROM p""")
def bibtex_verification(spark, d):
    return _flat(markup.verification_entries(markup.bib_table(_body(spark, d, _bibtex()), "body")), "key", "pos", "entry_type", "title", "author", "year", "doi", "eprint")


@query(f"""WITH {_P} SELECT id, 'The {{' || name || '}} Title' AS title, 'Ada \\"A\\" Lovelace|B ' || brand AS authors, CAST(y AS VARCHAR) AS year, '10.1/' || k AS doi FROM p""")
def bibtex_records(spark, d):
    return _flat(markup.bib_record(markup.bib_table(_body(spark, d, _bibtex()), "body")), "id", "title", "authors", "year", "doi")


@query(f"""WITH {_P} SELECT CASE WHEN id % 7 = 0 THEN 'unknown' ELSE name || ': ' || kind END AS title, 'Ada L|' || brand AS authors, CAST(y AS VARCHAR) AS year, CASE WHEN id % 2 = 0 THEN {_ARXIV} END AS arxiv_id, CASE WHEN id % 2 = 1 THEN '10.1/' || k END AS doi, 'J2' AS journal, 'd/' || k AS local_path FROM p""")
def key_value_records(spark, d):
    return _flat(markup.yaml_records(_parts(spark, d).select(C(L("d/"), "k").alias("path"), _yaml().alias("value"))), "title", "authors", "year", "arxiv_id", "doi", "journal", "local_path")


def _yaml() -> Column:
    return C(L("# c: d\n"), F.when(F.col("id") % 7 == 0, "").otherwise(C(L('title: "'), "name", L(": "), "kind", L('"\n'))), L("authors: Ada L and "), "brand", L("\nyear: "), F.col("y").cast("string"), L("\n"), F.when(F.col("id") % 2 == 0, C(L("arxiv: "), _arxiv())).otherwise(C(L("doi: "), _doi())), L("\njournal: J1\nother: q\n\njournal: J2"))


@query(f"WITH {_P} SELECT DISTINCT c AS key FROM (SELECT unnest(['a' || (id % 40), 'b' || (id % 60), 'c{{o}}' || (id % 70), 'd e']) AS c FROM p)")
def latex_citations(spark, d):
    m = lambda n: (F.col("id") % n).cast("string")
    return markup.cited_keys(_body(spark, d, C(L("x \\cite{a"), m(40), L(", b"), m(60), L("} \\citep[see]{c{o}"), m(70), L("} \\citet*{ d\n  e }\\cite\n{no}"))), "body")


@query(f"WITH {_P} SELECT 'f' || k || '.xml.gz' AS filename, 1::BIGINT AS pos FROM p")
def index_links(spark, d):
    html = C(L('<a href="x.html">x</a><a href="/data/f'), "k", L('.xml.gz">f</a><a href="y.gz">'))
    return _flat(markup.index_files(_body(spark, d, html), "body"), "filename", "pos")


@query("SELECT count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer")
def cookie_expiries(spark, d):
    where = _folder(spark, "cookies")
    c = A.table(spark, d, "customer")
    c.select(L("d").alias("a"), L("TRUE").alias("b"), L("/").alias("c"), L("FALSE").alias("d"), F.col("c_custkey").alias("e"), L("n").alias("f"), "c_name").write.option("sep", "\t").csv(where)
    return markup.cookie_expiry(spark, where)


@query(f"WITH {_P} SELECT k AS id, name AS title, y AS year, brand AS venue, id AS citation_count, '10.1/' || k AS doi FROM p")
def dump_table(spark, d):
    """A gzipped dump of JSON lines."""
    where = _folder(spark, "dump")
    p = _parts(spark, d)
    p.select(F.col("k").alias("id"), F.col("name").alias("title"), F.col("y").alias("year"), F.col("brand").alias("venue"), F.col("id").alias("citation_count"), F.create_map(L("DOI"), _doi()).alias("external_ids")).write.option("compression", "gzip").json(where)
    return markup.dump_papers(spark, where).select("id", "title", F.col("year"), "venue", "citation_count", F.col("external_ids")["DOI"].alias("doi"))


@query(r"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: octet_length(encode(x)) > 15)[1] AS title FROM documents")
def first_lines(spark, d):
    return A.documents(spark, d).select("doc_id", markup.first_line_title(F.col("text")).alias("title"))


@query(f"""WITH {_P} SELECT k AS folder, CASE id % 4 WHEN 0 THEN 'z.tex' WHEN 1 THEN 'main.tex' WHEN 2 THEN 'paper.txt' ELSE 'paper.pdf' END AS name FROM p""")
def preferred_texts(spark, d):
    p = _parts(spark, d)
    m = F.col("id") % 4
    files = F.array(_s(name=L("paper.pdf"), value=L("")), _s(name=L("paper.txt"), value=F.when(m == 3, " ").otherwise("t")), F.when(m < 2, _s(name=L("main.tex"), value=L("q"))), F.when(m == 0, _s(name=L("z.tex"), value=L("\\documentclass{a}"))), F.when(m < 2, _s(name=L("a.tex"), value=L("q"))))
    return markup.preferred_text(p.select(F.col("k").alias("folder"), F.explode(F.array_compact(files)).alias("f")).select("folder", "f.*"))


@query("SELECT asked, name, count(*) OVER (PARTITION BY asked) AS matches FROM (SELECT 'dir.7' AS asked, 'dir.' || s_suppkey AS name FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 'DIR.9', 'dir.' || s_suppkey FROM supplier WHERE s_suppkey // 10 = 9 OR s_suppkey = 9 UNION ALL SELECT 'holds 5', 'dir.' || s_suppkey FROM supplier WHERE starts_with(CAST(s_suppkey AS VARCHAR), '5'))")
def resolved_folders(spark, d):
    s = A.table(spark, d, "supplier").select(C(L("dir."), F.col("s_suppkey").cast("string")).alias("name"), C(L("it holds "), F.col("s_suppkey").cast("string")).alias("content"))
    out = None
    for asked in ("dir.7", "DIR.9", "holds 5"):
        part = markup.resolve_folder(s, asked).select(L(asked).alias("asked"), "name", "matches")
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT 'f' || s_suppkey AS filename FROM supplier WHERE s_suppkey % 3 <> 0")
def files_to_do(spark, d):
    s = A.table(spark, d, "supplier").select("s_suppkey", C(L("f"), F.col("s_suppkey").cast("string")).alias("filename"))
    done = s.where("s_suppkey % 3 = 0").select(C(L("file:"), "filename").alias("key")).unionAll(s.where("s_suppkey % 3 = 1").select(F.col("filename")))
    return ingest.pending_files(s.select("filename"), done)


_ENCODED = [k for k in urls.PATTERNS if k not in urls.AS_IS]


def _address(kind: str) -> str:
    """An address in SQL: encoded text, or an identifier as it is."""
    head, tail = urls.PATTERNS[kind].replace("{n}", "10").replace("{mail}", "user@example.com").split("{}")
    value = "url_encode(name || ' & ' || brand)" if kind in _ENCODED else "'10.5555/' || k" if kind not in ("ss_paper", "ss_refs", "ss_cites") else "'DOI:10.5555/' || k"
    return f"SELECT id, '{kind}' AS kind, '{head}' || {value} || '{tail}' AS url FROM p"


@query(f"WITH {_P} " + " UNION ALL ".join(map(_address, urls.PATTERNS)))
def request_addresses(spark, d):
    p, text, ident = _parts(spark, d), C("name", L(" & "), "brand"), C(L("10.5555/"), "k")
    made = F.array(*[_s(kind=L(k), url=urls.request(k, text if k in _ENCODED else ident)) for k in urls.PATTERNS])
    return p.select("id", F.explode(made).alias("r")).select("id", "r.*")


# -- scalar rules ------------------------------------------------------------------------------------------


@query(f"""WITH {_P} SELECT id, CASE WHEN id % 2 = 0 THEN '10.1/' || k END AS doi, id % 3 <> 0 AS author_ok, id % 4 < 2 AS near_year, CASE WHEN id % 2 = 0 THEN 'Ada, ' || brand ELSE 'plain ' || k END AS names, coalesce(CASE WHEN id % 2 = 0 THEN 'old' END, 'new') AS kept,
CASE WHEN id % 2 = 0 THEN CAST(y AS VARCHAR) END AS year, CASE id % 3 WHEN 0 THEN 'Ada ' || brand WHEN 1 THEN brand ELSE 'Ada Lovelace' END AS inverted, id % 2 = 0 AS same_title, CASE id % 4 WHEN 0 THEN 'stale' WHEN 1 THEN 'fresh' WHEN 2 THEN 'web' ELSE 'auto' END AS override FROM p""")
def record_rules(spark, d):
    i, k = F.col("id"), F.col("k")
    y = F.col("y").cast("string")
    return _parts(spark, d).select(
        "id",
        S.doi_from_url(F.when(i % 2 == 0, C(L("https://dx.doi.org/"), _doi())).otherwise(C(L("http://x/"), k))).alias("doi"),
        S.author_matches(F.when(i % 3 == 0, L("Nobody")).when(i % 3 == 1, L("Lovelace")).otherwise(L("Li")), L("Ada Lovelace Ming Li")).alias("author_ok"),
        S.years_within(y, F.when(i % 4 == 0, y).when(i % 4 == 1, (F.col("y") + 3).cast("string")).when(i % 4 == 2, (F.col("y") + 4).cast("string")).otherwise("n.d."), 3).alias("near_year"),
        S.authors_text(F.when(i % 2 == 0, F.to_json(F.array(L("Ada"), "brand"))).otherwise(C(L("plain "), k))).alias("names"),
        S.keep_or_set(F.when(i % 2 == 0, "old"), L("new")).alias("kept"),
        S.valid_year(F.when(i % 2 == 0, C(L(" "), y, L(" "))).otherwise(C(y, L("a")))).alias("year"),
        S.invert_name(F.when(i % 3 == 0, C("brand", L(", Ada"))).when(i % 3 == 1, C("brand", L(", "))).otherwise("Ada Lovelace")).alias("inverted"),
        S.titles_match(C(L(" "), F.upper("name")), F.when(i % 2 == 0, F.col("name")).otherwise(F.col("kind"))).alias("same_title"),
        S.source_override(F.when(i % 4 == 0, "STALE").when(i % 4 == 1, "Fresh").when(i % 4 == 2, "web").otherwise("else")).alias("override"),
    )


@query(r"""WITH t AS (SELECT doc_id, text, octet_length(encode(text)) AS n, CAST(length(text) AS BIGINT) AS c FROM documents),
w AS (SELECT *, list_max(list_filter(range(0, 101), lambda i: octet_length(encode(left(text, i))) <= 100)) AS most FROM t)
SELECT doc_id, CASE WHEN n <= 100 THEN text ELSE left(text, most) END AS whole, CASE WHEN n <= 100 THEN text ELSE left(text, most) || '...' END AS dotted FROM w""")
def byte_cuts(spark, d):
    t = F.col("text")
    return A.documents(spark, d).select("doc_id", S.safe_truncate(t, 100).alias("whole"), S.truncate_bytes(t, 100).alias("dotted"))


@query(f"""WITH {_P} SELECT id, 'old' || k AS old_key, '@a{{new' || k || ',' || chr(10) || ' t={{x}}}}' AS renamed, CASE WHEN id % 2 = 0 THEN name END AS field, 'ID' || k AS pp, CASE WHEN id % 2 = 0 THEN 'OL' || k || 'W' END AS ol, {_ARXIV} AS arxiv,
CASE id % 5 WHEN 0 THEN 'https://arxiv.org/abs/' || {_ARXIV} WHEN 1 THEN 'https://doi.org/10.5555/' || k WHEN 2 THEN 'https://openlibrary.org/isbn/978' || lpad(k, 10, '0') WHEN 3 THEN 'https://www.semanticscholar.org/search?q=' || url_encode(name) ELSE 'https://dblp.org/rec/' || k END AS url FROM p""")
def identifier_rules(spark, d):
    i, k = F.col("id"), F.col("k")
    entry = C(L("@a{old"), k, L(",\n t={x}}"))
    fields = F.array(_s(name=L("Year"), value=L("1")), _s(name=F.when(i % 2 == 0, "TITLE").otherwise("note"), value=F.col("name")), _s(name=L("title2"), value=L("no")))
    asked = F.when(i % 5 == 0, C(L("arXiv:"), _arxiv())).when(i % 5 == 1, C(L("10.5555/"), k)).when(i % 5 == 2, C(L("978-"), F.lpad(k, 10, "0"))).when(i % 5 == 3, F.col("name")).otherwise(C(L("https://dblp.org/rec/"), k))
    return _parts(spark, d).select("id", S.bib_key(entry).alias("old_key"), S.replace_bib_key(entry, C(L("new"), k)).alias("renamed"), S.bib_field(fields, "title").alias("field"), S.philpapers_id(C(L("https://philpapers.org/rec/ID"), k, L("?x=1"))).alias("pp"), S.openlibrary_id(F.when(i % 2 == 0, C(L("https://openlibrary.org/works/OL"), k, L("W.json?x=1"))).otherwise("https://x.org/")).alias("ol"), S.arxiv_id_of_url(C(L("http://arxiv.org/abs/"), _arxiv(), L("v3"))).alias("arxiv"), S.open_url(asked).alias("url"))


@query(f"""WITH {_P} SELECT id, array_to_string(list_filter([CASE WHEN id % 2 = 0 THEN 'year:' || y || '->' || (y + 1) END, CASE WHEN id % 3 = 0 THEN 'author:Lovelace->Hopper' END, CASE WHEN id % 5 = 0 THEN 'title-mismatch' END], lambda x: x IS NOT NULL), ';') AS found, name = 'unknown' OR id % 6 = 0 AS placeholder FROM p""")
def issue_rules(spark, d):
    i, y = F.col("id"), F.col("y")
    found = S.issues(y.cast("string"), F.when(i % 2 == 0, y + 1).otherwise(y).cast("string"), L("Lovelace"), F.when(i % 3 == 0, "Hopper").otherwise("lovelace"), F.col("name"), F.when(i % 5 == 0, C(L("zz "), "name")).otherwise(F.upper("name")))
    return _parts(spark, d).select("id", F.array_join(found, ";").alias("found"), S.is_placeholder(F.when(i % 6 == 0, "unknown").otherwise(F.col("name")), F.when(i % 6 != 0, F.col("k")), L(None).cast("string")).alias("placeholder"))


@query(f"""WITH {_P} SELECT id, CASE WHEN id % 4 < 3 THEN name END AS title, CASE WHEN id % 4 < 3 THEN CAST(y AS VARCHAR) END AS year, CASE id % 4 WHEN 0 THEN 'Ada ' || brand WHEN 1 THEN 'Ada ' || brand || ', Solo' WHEN 2 THEN 'Ada Lovelace, ' || brand END AS authors_text FROM p""")
def conflict_fields(spark, d):
    i = F.col("id") % 4
    oa = _json(title=F.col("name"), publication_year=F.col("y"), authorships=F.array(_s(author=_s(display_name=C(L("Ada "), "brand")))))
    body = F.when(i == 0, oa).when(i == 1, _json(message=_crossref())).when(i == 2, F.replace(_atom(), C(L("\n  "), "kind"), L(""))).otherwise("junk")
    return payloads.extract_conflict_fields(_body(spark, d, body))


# -- records as text -----------------------------------------------------------------------------------------


def _records(spark, d) -> DataFrame:
    """Records of part, as the parsers give them."""
    i = F.col("id")
    given = {"title": C("kind", L(" of "), "name"), "authors": F.when(i % 3 == 0, F.array(L("Ada Lovelace"))).otherwise(F.array(L("Ada Lovelace"), L("B C"), L("D E"), L("F G"))), "year": F.when(i % 7 == 0, "?").otherwise(F.col("y").cast("string")), "doi": _even(_doi()), "arxiv_id": _arxiv(), "citations": F.when(i % 3 != 0, i), "venue": F.when(i % 4 == 0, F.col("brand")), "abstract": F.repeat(C("name", L(" ")), 20), "isbn": F.when(i % 5 == 0, F.col("k")), "categories": F.when(i % 2 == 0, F.array(L("cs.LG"), L("stat.ML"))).otherwise(F.array().cast("array<string>"))}
    return _parts(spark, d).select("id", *[given.get(n, L(None)).cast(t).alias(n) for n, t in payloads.RECORD.items()])


_R = f"""{_P}, r AS (SELECT id, k, kind || ' of ' || name AS title, CASE WHEN id % 3 = 0 THEN ['Ada Lovelace'] ELSE ['Ada Lovelace', 'B C', 'D E', 'F G'] END AS authors, CASE WHEN id % 7 = 0 THEN '?' ELSE CAST(y AS VARCHAR) END AS year, CASE WHEN id % 2 = 0 THEN '10.1/' || k END AS doi, {_ARXIV} AS arxiv_id, CASE WHEN id % 3 <> 0 THEN id END AS citations, CASE WHEN id % 4 = 0 THEN brand END AS venue, repeat(name || ' ', 20) AS abstract, CASE WHEN id % 5 = 0 THEN k END AS isbn, id % 2 = 0 AS sorted FROM p),
q AS (SELECT *, 'lovelace' || year || lower(split_part(title, ' ', 1)) AS key, array_to_string(authors, ' and ') AS people FROM r)"""


def _lines(*fields: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"'  {n} = {{' || {v} || '}}'" for n, v in fields) + "], lambda x: x IS NOT NULL), ',' || chr(10))"


@query(f"""WITH {_R} SELECT id, '@' || CASE WHEN venue IS NULL THEN 'article' ELSE 'inproceedings' END || '{{' || key || ',' || chr(10) || {_lines(("title", "title"), ("author", "people"), ("booktitle", "venue"), ("year", "year"), ("eprint", "arxiv_id"), ("archivePrefix", "'arXiv'"))} || ',' || chr(10) || '}}' AS arxiv,
'@book{{' || key || ',' || chr(10) || {_lines(("title", "title"), ("author", "authors[1]"), ("year", "year"), ("publisher", "venue"), ("isbn", "isbn"))} || chr(10) || '}}' AS book,
'@inproceedings{{' || key || ',' || chr(10) || {_lines(("title", "title"), ("author", "people"), ("year", "year"), ("booktitle", "venue"))} || chr(10) || '}}' AS fallback,
'@misc{{m' || k || ',' || chr(10) || {_lines(("title", "title"), ("author", "people"), ("year", "year"), ("howpublished", "doi"), ("note", "isbn"))} || ',' || chr(10) || '}}' AS misc,
'@a{{' || k || ',' || chr(10) || '  t = {{' || title || '}},' || chr(10) || '  y = {{' || year || '}}' || chr(10) || '}}' AS entry FROM q""")
def bibtex_texts(spark, d):
    r = _records(spark, d)
    k = F.col("id").cast("string")
    return r.select("id", render.arxiv_bibtex(F.col("arxiv_id")).alias("arxiv"), render.book_bibtex().alias("book"), render.fallback_bibtex().alias("fallback"), render.misc_bibtex(C(L("m"), k), F.col("doi"), F.col("isbn")).alias("misc"), render.bib_entry(L("a"), k, F.array(_s(name=L("t"), value=F.col("title")), _s(name=L("y"), value=F.col("year")))).alias("entry"))


def _object(*fields: tuple[str, str]) -> str:
    return "'{' || array_to_string(list_filter([" + ", ".join(f"'\"{n}\":' || {v}" for n, v in fields) + "], lambda x: x IS NOT NULL), ',') || '}'"


_AUTHORS = "'[\"' || array_to_string(authors, '\",\"') || '\"]'"
_QUOTE = "'\"' || {} || '\"'"
_SHARED = [("title", _QUOTE.format("title")), ("authors", _AUTHORS), ("year", _QUOTE.format("year")), ("doi", _QUOTE.format("doi")), ("arxiv_id", _QUOTE.format("arxiv_id")), ("venue", _QUOTE.format("venue")), ("isbn", _QUOTE.format("isbn"))]


@query(f"""WITH {_R} SELECT id, {_object(*_SHARED, ("abstract", _QUOTE.format("abstract")), ("citations", "citations"), ("categories", "CASE WHEN sorted THEN '[\"cs.LG\",\"stat.ML\"]' END"))} AS whole,
{_object(*_SHARED, ("abstract", _QUOTE.format("CASE WHEN length(abstract) <= 150 THEN abstract ELSE left(abstract, 150) || '...' END")), ("citations", "citations"))} AS brief,
'title: "' || title || '"' || chr(10) || 'authors: "' || people || '"' || chr(10) || 'year: ' || year || chr(10) || 'arxiv: "' || arxiv_id || '"' || chr(10) || 'retrieved: "2020-01-01"' || chr(10) AS yaml,
id || '. ' || CASE WHEN length(title) <= 80 THEN title ELSE left(title, 77) || '...' END || ' (' || year || ') ' || CASE WHEN len(authors) > 3 THEN array_to_string(authors[1:3], ', ') || ' et al.' ELSE array_to_string(authors, ', ') END || CASE WHEN citations IS NULL THEN '' ELSE ' [' || citations || ' citations]' END AS line,
CASE WHEN id * 5000 >= 1073741824 THEN format('{{:.1f}} GB', id * 5000 / 1073741824) WHEN id * 5000 >= 1048576 THEN format('{{:.1f}} MB', id * 5000 / 1048576) WHEN id * 5000 >= 1024 THEN format('{{:.1f}} KB', id * 5000 / 1024) ELSE id * 5000 || ' B' END AS size FROM q""")
def record_texts(spark, d):
    r = _records(spark, d)
    return r.select("id", render.record_json().alias("whole"), render.record_json(brief=True).alias("brief"), render.source_yaml("arxiv", F.col("arxiv_id"), L("2020-01-01")).alias("yaml"), render.report_line(F.col("id")).alias("line"), render.byte_size(F.col("id") * 5000).alias("size"))


@query(f"""WITH {_R} SELECT title, {_AUTHORS} AS authors, nullif(year, '?') AS year, citations AS citation_count, venue AS journal, CASE WHEN sorted THEN 'cs.LG, stat.ML' END AS categories, year AS back_year, array_to_string(authors, '|') AS back_authors, CASE WHEN sorted THEN 'cs.LG|stat.ML' ELSE '' END AS back_categories FROM q""")
def stored_rows(spark, d):
    #: joined by an id that is of one record only; arXiv ids of five digits aren't
    rows = render.to_rows(_records(spark, d).withColumn("s2_id", F.col("id").cast("string")).drop("id"))
    back = render.from_rows(rows).select(F.col("s2_id").alias("k"), F.col("year").alias("back_year"), F.array_join("authors", "|").alias("back_authors"), F.array_join("categories", "|").alias("back_categories"))
    return rows.join(back, rows["s2_id"] == back["k"]).select("title", "authors", "year", "citation_count", "journal", "categories", "back_year", "back_authors", "back_categories")


# -- linkage of whole files ---------------------------------------------------------------------------------------


@query(f"""WITH {_P}, s AS (SELECT *, CASE id % 5 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' WHEN 3 THEN 'book' ELSE 'unknown' END AS status FROM p) SELECT 'k' || k AS key, status, CASE id % 5 WHEN 0 THEN 'DOI' WHEN 1 THEN 'arXiv' WHEN 2 THEN 'SemanticScholar' WHEN 3 THEN 'OpenLibrary' ELSE '' END AS source, CASE WHEN id % 5 = 0 THEN 'year:' || y || '->' || (y + 1) ELSE '' END AS issues FROM s""")
def verified_entries(spark, d):
    return _verified(spark, d).select("key", "status", "source", F.array_join("issues", ";").alias("issues"))


def _verified(spark, d) -> DataFrame:
    p = _parts(spark, d)
    i = F.col("id") % 5
    title = C(L("Number "), F.lpad("k", 9, "0"), L(" "), "name")
    #: an arXiv id names one record: with five digits, as elsewhere, lpad would cut longer keys to one
    arxiv = lambda k: C(L("2001."), F.lpad(k, 9, "0"))
    entries = p.select(C(L("k"), "k").alias("key"), F.col("id").cast("int").alias("pos"), F.when(i == 3, "book").otherwise("article").alias("entry_type"), title.alias("title"), L("Lovelace").alias("author"), F.col("y").cast("string").alias("year"), F.when(i == 0, _doi()).otherwise("").alias("doi"), F.when(i == 1, arxiv("k")).otherwise("").alias("eprint"))
    people = F.array(L("Ada Lovelace"))
    found = lambda own, year: p.where(own).select(F.col("k").alias("id"), title.alias("title"), year.cast("string").alias("year"), people.alias("authors"), F.col("id").cast("int").alias("pos"), L(None).cast("string").alias("doi"))
    by_doi = found(i == 0, F.col("y") + 1).select(C(L("10.1/"), "id").alias("ref"), "title", "year", "authors")
    by_arxiv = found(i == 1, F.col("y")).select(arxiv("id").alias("ref"), "title", "year", "authors")
    return linkage.verify(entries, by_doi, by_arxiv, found(i == 9, F.col("y")), found(i == 2, F.col("y")), found(i == 3, F.col("y")))


@query("SELECT count(*) FILTER (p_partkey % 5 IN (1, 2)) AS ok, count(*) FILTER (p_partkey % 5 = 0) AS mismatch, count(*) FILTER (p_partkey % 5 = 3) AS book, count(*) FILTER (p_partkey % 5 = 4) AS unknown FROM part")
def status_tallies(spark, d):
    return linkage.tally(_verified(spark, d))


@query(f"""WITH {_P}, e AS (SELECT id, CASE WHEN id % 10 = 0 THEN '9x' || k ELSE 'x' || k END AS key, CASE WHEN id % 4 = 0 THEN '10.1/d' || (id % 50) END AS doi FROM p),
d AS (SELECT key, first_value(key) OVER w AS kept_key, row_number() OVER w AS n FROM e WHERE doi IS NOT NULL WINDOW w AS (PARTITION BY doi ORDER BY id))
SELECT 'malformed' AS kind, key, NULL AS kept_key FROM e WHERE id % 10 = 0 UNION ALL SELECT 'duplicate', key, kept_key FROM d WHERE n > 1 UNION ALL SELECT 'orphan', key, NULL FROM e WHERE id % 3 = 0""")
def cleaned_file(spark, d):
    """One file of all parts, and the LaTeX text that cites some of them."""
    i = F.col("id")
    key = C(F.when(i % 10 == 0, "9x").otherwise("x"), "k")
    entry = C(L("@article{"), key, L(", title={T}, author={A}, year={2000}"), F.when(i % 4 == 0, C(L(", doi={10.1/d"), (i % 50).cast("string"), L("}"))).otherwise(""), L("}\n"))
    rows = _parts(spark, d)
    whole = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), "").alias("value"))
    tex = rows.where("id % 3 <> 0").select(C(L("\\cite{"), key, L("}")).alias("value"))
    return commands.clean_file(whole, tex)


# -- commands ---------------------------------------------------------------------------------------------------


def _bodies(spark, d) -> DataFrame:
    """Captured bodies by (source, ref) for lookups."""
    p = _parts(spark, d)
    body = lambda source, ref, value: p.select(L(source).alias("source"), ref.alias("ref"), value.alias("body"))
    return body("arxiv", _arxiv(), _atom()).unionAll(body("ss_paper", _arxiv(), F.to_json(_scholar(venue=F.col("brand"))))).unionAll(body("cr_doi", C(L("10.5555/"), "k"), _json(message=_crossref()))).unionAll(body("oa_doi", C(L("10.5555/"), "k"), _json(cited_by_count=F.col("id"), open_access=_s(oa_url=C(L("http://o/"), "k"))))).unionAll(body("cr_bibtex", C(L("10.5555/"), "k"), C(L("@inproceedings{cr"), F.col("y").cast("string"), L(", title={T}}")))).unionAll(body("isbn", C(L("978"), F.lpad("k", 10, "0")), _keyed()))


@query(f"""WITH {_P} SELECT {_ARXIV} AS ref, name || ' ' || kind AS title, brand AS venue, k AS citations, '@article{{lovelace' || y || 'x' AS head FROM p WHERE id = 7 UNION ALL SELECT '10.5555/' || k, name, kind, k, '@inproceedings{{cr' || y || 'x' FROM p WHERE id = 8 UNION ALL SELECT '978' || lpad(k, 10, '0'), CASE WHEN id % 2 = 0 THEN name || ': ' || kind ELSE name END, 'Press ' || k, NULL, '@book{{lovelace' || y || 'x' FROM p WHERE id = 9""")
def looked_up(spark, d):
    bodies = _bodies(spark, d)
    out = None
    for asked in ("arXiv:2001.00007v2", "https://doi.org/10.5555/8", "978-0000000009"):
        row = commands.lookup(bodies, asked)
        row = row.select("ref", "title", "venue", "citations", C(F.regexp_extract("bibtex", r"^(@\w+\{[a-z]+[0-9]{4})", 1), L("x")).alias("head"))
        out = row if out is None else out.unionAll(row)
    return out


def _searches(spark, d) -> DataFrame:
    """Search results of two sources in one body each."""
    p = _parts(spark, d).where("id between 1 and 40")
    oa = p.agg(_json(results=F.transform(F.array_sort(F.collect_list(F.struct("id", "name", "k"))), lambda x: F.struct(x["name"].alias("title"), x["id"].alias("cited_by_count"), C(L("https://doi.org/10.1/"), (x["id"] % 30).cast("string")).alias("doi")))).alias("body"))
    ss = p.agg(_json(data=F.transform(F.array_sort(F.collect_list(F.struct("id", "kind"))), lambda x: F.struct(x["kind"].alias("title")))).alias("body"))
    return ss.select(L("ss").alias("source"), "body").unionAll(oa.select(L("oa"), "body"))


_HITS = "x AS (SELECT p_partkey AS id, p_name AS title, row_number() OVER (PARTITION BY p_partkey % 30 ORDER BY p_partkey) AS n, len(list_filter(['red', 'widget', 'zzz'], lambda w: list_contains(string_split(p_name, ' '), w))) / 3 AS s FROM part WHERE p_partkey BETWEEN 1 AND 40)"


@query(f"WITH {_HITS} SELECT title, id AS citations, s AS relevance FROM x WHERE n = 1 ORDER BY s DESC, id DESC LIMIT 10")
def searched_source(spark, d):
    return commands.search_payloads(_searches(spark, d), "red widget zzz", "oa").select("title", F.col("citations").cast("bigint").alias("citations"), "relevance")


@query(f"WITH {_P} SELECT kind AS title FROM p WHERE id = 1")
def searched_top(spark, d):
    """The first source whose first row is relevant, and its best row."""
    from folioscope.operators import search

    rows = search.merge_sources([payloads.SEARCH[s](_searches(spark, d).where(F.col("source") == s)) for s in ("ss", "oa")])
    first = _parts(spark, d).where("id = 1").first()
    return search.resolve_top(rows, first["kind"]).select("title")


@query(f"""WITH {_P} SELECT 'T' || max(id) AS title, count(*) AS n, bool_or(id % 7 = 0) AS has_unknown FROM p WHERE id % 7 <> 0 GROUP BY id % 50""")
def rebuilt_store(spark, d):
    """K7: folders in order of their paths; of those with one id the last path names the title."""
    p = _parts(spark, d)
    text = C(F.when(F.col("id") % 7 == 0, "").otherwise(C(L("title: T"), "k", L("\ndoi: 10.1/"), (F.col("id") % 50).cast("string"))), L("\nauthors: A B"))
    folders = p.select(C(L("d/"), F.lpad("k", 9, "0")).alias("path"), text.alias("value"))
    seen = p.where("id % 7 <> 0").groupBy(C(L("10.1/"), (F.col("id") % 50).cast("string")).alias("ref")).agg(F.count("*").alias("n"))
    out = commands.rebuild(folders).where("not rejected")
    return out.join(seen, out["doi"] == seen["ref"]).select("title", "n", (F.col("title") == "unknown").alias("has_unknown"))


@query("SELECT 'missing' AS kind, 'd/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 1 UNION ALL SELECT 'untracked', 'd/' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0")
def checked_folders(spark, d):
    s = A.table(spark, d, "supplier").select("s_suppkey", C(L("d/"), F.col("s_suppkey").cast("string")).alias("path"))
    papers = s.where("s_suppkey % 3 = 0 or s_suppkey % 5 = 0").select(F.col("path").alias("local_path"), F.when(F.col("s_suppkey") % 3 != 0, F.current_timestamp()).alias("deleted_at"))
    return commands.check(papers, s.where("s_suppkey % 2 = 0").select("path", L("").alias("value")))


@query(f"""WITH {A.CLAIMS}, live AS (SELECT * FROM claims WHERE paper_id % 3 <> 0) SELECT paper_id, field, string_agg(source || '=' || value, ';' ORDER BY fetched_at DESC, source DESC, value DESC) AS found FROM live GROUP BY paper_id, field HAVING count(DISTINCT value) > 1""")
def conflicts_of_live(spark, d):
    from folioscope.operators import store

    claims = store.latest_claims(A.raw_claims(spark, d))
    papers = claims.select(F.col("paper_id").alias("id")).distinct().select("id", F.when(F.col("id") % 3 == 0, F.current_timestamp()).alias("deleted_at"))
    return commands.conflicts(claims, papers).select("paper_id", "field", F.array_join(F.transform("found", lambda c: C(c["source"], L("="), c["value"])), ";").alias("found"))


# -- files and requests -----------------------------------------------------------------------------------------


def _written(spark, name: str, rows: list) -> str:
    """A few small files (path, content) in a new folder that the executors share."""
    folder = _folder(spark, name)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for path, content in rows:
        out = files.create(place(f"{folder}/{path}"))
        out.write(bytearray(content.encode()))
        out.close()
    return folder


@query("SELECT 'd' || n_nationkey AS folder, n_name AS title, '10.1/' || n_nationkey AS doi FROM nation")
def folder_records(spark, d):
    """Folders one level below that have a source file; deeper ones and other files don't count."""
    nations = A.table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    rows = [(f"d{n}/source.yaml", f"title: {name}\ndoi: 10.1/{n}\n") for n, name in nations] + [("d1/deep/source.yaml", "title: deep"), ("e/other.yaml", "title: other")]
    out = markup.yaml_records(markup.paper_folders(spark, _written(spark, "papers", rows)))
    return out.select(F.element_at(F.split("local_path", "/"), -1).alias("folder"), "title", "doi")


@query("SELECT 'k' || n_nationkey AS cache_key, CASE WHEN n_nationkey % 2 = 0 THEN 'kept' ELSE '{\"n\": \"' || n_name || '\"}' END AS body FROM nation")
def cached_bodies(spark, d):
    """Files of captured bodies go into the cache where it has none of their name."""
    from folioscope.operators import store

    nations = A.table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    files = markup.cached_files(spark, _written(spark, "bodies", [(f"k{n}", f'{{"n": "{name}"}}') for n, name in nations]))
    cache = files.where(F.substring("cache_key", 2, 9).cast("int") % 2 == 0).withColumn("body", L("kept"))
    return store.cache_insert_missing(cache, files).select("cache_key", "body")


@query("SELECT 'k' || p_partkey AS cache_key, CASE WHEN p_partkey % 2 = 0 THEN '{\"cached\": 1}' ELSE '[\"http://x/' || p_partkey || '\"]' END AS body FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0")
def fetched_bodies(spark, d):
    """Fresh bodies of the cache, and for stale and missing ones what the getter has, if it looks like
    a payload."""
    from folioscope.sources import fetch

    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), C(L("k"), F.col("p_partkey").cast("string")).alias("cache_key"), C(L("http://x/"), F.col("p_partkey").cast("string")).alias("url"))
    now = F.to_timestamp(L("2020-01-02 00:00:00"))
    cache = p.where("id % 2 = 0 or id % 5 = 0").select("cache_key", "url", L('{"cached": 1}').alias("body"), F.when(F.col("id") % 2 == 0, F.to_timestamp(L("2020-01-01 12:00:00"))).otherwise(F.to_timestamp(L("2019-01-01 00:00:00"))).alias("fetched_at"))

    def get(url: str) -> tuple[int, dict, str]:
        return 200, {}, "no payload" if int(url.rsplit("/", 1)[1]) % 3 == 0 else f'["{url}"]'

    return fetch.fetch(p.select("cache_key", "url"), cache, get, now).select("cache_key", "body")
