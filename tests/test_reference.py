"""The bibliographic engine on small literals."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from folioscope.functions import scalars as S
from folioscope.operators import graph, linkage, render, search, store
from folioscope.plans import commands
from folioscope.sources import bibfile, markup, payloads, urls

YEARS = {"p1": (2017, 90000), "p2": (2019, 80000), "p3": (2021, 500), "p4": (2022, 1200), "p5": (2022, 900), "p6": (2020, 400), "p7": (2022, 700), "p8": (2020, 3500), "p9": (2023, 50), "p10": (2014, 12000)}
EDGES = {"p3": "p1 p1 p2 p10", "p4": "p1 p2", "p5": "p1 p2 p3 p4", "p6": "p1 p2 p10", "p7": "p1 p2 p3 p4 p6", "p8": "p1 p2 p5 p10", "p9": "p1 p2 p3 p4 p5 p7", "p10": "p1"}


@pytest.fixture(scope="module")
def g(spark):
    papers = spark.createDataFrame([(k, f"title {k}", y, c) for k, (y, c) in YEARS.items()], "id string, title string, year int, citation_count bigint")
    edges = spark.createDataFrame([(a, b) for a, bs in EDGES.items() for b in bs.split()], "src string, dst string")
    return papers, edges


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def one(spark, column, *values):
    """A column expression over literal inputs a, b, ..."""
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip("abcdef", values)])
    return row.select(column(*[F.col(n) for n in "abcdef"[: len(values)]]).alias("x")).first().x


def test_neighbours(g):
    assert ids(graph.neighbours(*g, "p1", "cites")) == ["p10", "p8", "p4", "p5", "p7", "p3", "p3", "p6", "p9"]
    assert len(ids(graph.neighbours(*g, "p1", "cites", 3))) == 3
    assert ids(graph.neighbours(*g, "p3", "refs")) == ["p1", "p1", "p2", "p10"]


def test_closure(g):
    rows = graph.closure(*g, ["p1", "p2"], "cites").collect()
    assert [(r.id, r.seed_count) for r in rows] == [(p, 2) for p in ("p8", "p4", "p5", "p7", "p3", "p6", "p9")] + [("p10", 1)]
    assert ids(graph.closure(*g, ["p1"], "cites", 2022)) == ["p4", "p5", "p7", "p9"]
    assert ids(graph.closure(*g, ["p3"], "both")) == ["p1", "p2", "p10", "p5", "p7", "p9"]
    assert ids(graph.closure(*g, [])) == []


def test_hops_and_paths(g, spark):
    papers, edges = g
    root = lambda x: spark.createDataFrame([(x,)], "node string")
    levels = lambda x, d: {r.node: r.level for r in graph.hops(edges, root(x), d).collect()}
    assert levels("p9", "refs") == {"p9": 0, **{f"p{i}": 1 for i in (1, 2, 3, 4, 5, 7)}, "p6": 2, "p10": 2}
    assert levels("p8", "refs") == {"p8": 0, "p1": 1, "p2": 1, "p5": 1, "p10": 1, "p3": 2, "p4": 2}
    undirected = levels("p10", "both")
    assert {k for k, v in undirected.items() if v == 1} == {"p1", "p3", "p6", "p8"}
    for other in ("p9", "p6", "p10"):
        path = [r.node for r in graph.shortest_path(edges, "p10", other).orderBy("place").collect()]
        assert len(path) - 1 == undirected[other] and path[0] == "p10" and path[-1] == other
    assert graph.shortest_path(edges, "p10", "none").count() == 0
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    assert {r.node: r.level for r in graph.hops(cycle, spark.createDataFrame([(1,)], "node int")).collect()} == {1: 0, 2: 1}
    nameless = spark.createDataFrame([(1, 2), (1, None), (1, None), (2, None), (2, 3), (None, 4)], "src int, dst int")
    got = [(r.node, r.level) for r in graph.hops(nameless, spark.createDataFrame([(1,)], "node int")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 1), (None, 1), (None, 1), (3, 2), (None, 2)], key=str)
    assert len(ids(commands.refs(papers, edges, "p9", 2, 3))) == 3
    assert [r.title for r in commands.path(papers, edges, "p10", "p1").collect()] == ["title p10", "title p1"]


@pytest.mark.parametrize(
    ("x", "kind"),
    [("https://arxiv.org/abs/2001.00001", "arxiv"), ("https://export.arxiv.org/abs/1", "arxiv"), ("http://dx.doi.org/10.1/x", "doi"), ("https://dblp.org/rec/1", "dblp_url"), ("https://www.semanticscholar.org/paper/1", "semantic_scholar_url"), ("https://philpapers.org/rec/ANDCIT-6", "philpapers_url"), ("https://openlibrary.org/works/OL1W", "openlibrary_url"), ("https://example.com/10.1234/x", "url"), ("2006.11239v2", "arxiv"), ("arXiv:2006.11239", "arxiv"), ("math.GT/0309136", "arxiv"), ("10.1145/3442188", "doi"), ("978-0-262-03924-6", "isbn"), ("080442957X", "isbn"), ("attention is all", "search"), ("2006.11239\n", "search")],
)
def test_detect_type(spark, x, kind):
    assert one(spark, S.detect_type, x) == kind


def test_scalars(spark):
    check = lambda f, want, *a: (one(spark, f, *a), want)
    cases = [
        check(S.normalize_arxiv, "2006.11239", "https://arxiv.org/pdf/2006.11239.pdf"),
        check(S.normalize_arxiv, "2006.11239v2", "https://arxiv.org/pdf/2006.11239v2.pdf"),
        check(S.normalize_doi, "10.1/x", "http://dx.doi.org/10.1/x"),
        check(S.cache_key, "arxiv_b2a462a972bbaa37", "arxiv", "2006.11239"),
        check(S.year_from_date, "2019", "March 2019"),
        check(S.year_from_date, "0315", "20190315"),
        check(S.year_from_date, "?", "n.d."),
        check(S.url_encode, "a%20b%2Ac~%2B%2F%C3%A9", "a b*c~+/é"),
        check(S.plain_text, "A & B <", "<i>A</i> &amp; B &amp;lt;"),
        check(lambda a: S.safe_truncate(a, 3), "aé", "aéé"),
        check(lambda a: S.truncate(a, 5), "ab...", "abcdefgh"),
        check(lambda a: S.truncate_bytes(a, 3), "abc...", "abcd"),
        check(S.invert_name, "Mordecai Ezekiel", "Ezekiel, Mordecai"),
        check(S.normalize_node_id, "ARXIV:2006.11239v2", "2006.11239v2"),
        check(S.normalize_node_id, "DOI:10.1145/3", "10.1145/3"),
        check(S.normalize_node_id, "CorpusId:3", "CorpusId:3"),
        check(S.valid_year, None, "not4"),
        check(S.author_matches, True, "Vaswani", "A Vaswani N Shazeer"),
        check(S.author_matches, False, "Li", "Ming Liang"),
        check(S.common_prefix_length, 3, "abcd", "abce"),
        check(S.common_prefix_length, 0, "", "x"),
        check(S.authors_text, "A, B", '["A","B"]'),
        check(S.authors_text, "plain", "plain"),
        check(S.open_url, "https://arxiv.org/abs/2006.11239", "arXiv:2006.11239"),
        check(S.openlibrary_id, "OL1W", "https://openlibrary.org/works/OL1W.json?x=1"),
        check(S.replace_bib_key, "@a{new,\n t={x}}", "@a{old,\n t={x}}", "new"),
        check(lambda a, b: S.years_within(a, b, 3), True, "2010", "2013"),
        check(lambda a: S.cite_key(F.array(a), F.lit("2017"), F.lit("On the Attention mechanism")), "vaswani2017attention", "Ashish Vaswani"),
        check(lambda a: S.directory_slug(F.array(a), F.lit("2017"), F.lit("State-of-the-art")), "müller2017state", "K Müller"),
        check(lambda a: urls.request("oa_search", a, 5), "https://api.openalex.org/works?search=a%20b&per-page=5", "a b"),
        check(S.source_override, "fresh", "FRESH"),
        check(lambda a: render.byte_size(a), "1.5 KB", 1536),
    ]
    assert [a for a, _ in cases] == [b for _, b in cases]


def sqlite_ranks(rows, query):
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b)")
    db.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", rows)
    return dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,)).fetchall())


@pytest.mark.parametrize("query", ["the", "the cat", "cat OR owl", "the NOT dog", '"the bird"', "bir*", "a : cat", "cafe", "NEAR(the cat, 2)", "(cat OR dog) AND the"])
def test_bm25_is_what_sqlite_has(spark, query):
    rows = [(1, "the cat", "old"), (2, "the dog", ""), (3, "the the bird", "cat"), (4, "owl", "Café"), (5, "the big fat cat", "the bird sings")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.doc: r.score for r in search.bm25(df, query, "id", ["a", "b"]).collect()}
    want = sqlite_ranks(rows, query)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_query_errors(spark):
    for text in ("a-b", "what?", "a.b", "(a", '"open'):
        with pytest.raises(ValueError):
            search.parse_query(text)
    df = spark.createDataFrame([(1, "has a-b inside"), (2, "none")], "id int, t string")
    assert ids(search.search_catalog(df, "a-b", "id", ["t"], ["t"], 5)) == [1]
    cased = spark.createDataFrame([(1, "É-A"), (2, "é-a"), (3, "x")], "id int, t string")
    assert ids(search.search_catalog(cased, "é-A", "id", ["t"], ["t"], 5)) == [2]
    assert ids(search.search_local(df.withColumn("deleted_at", F.lit(None)), "inside OR none", "id", ["t"], 5, F.col("deleted_at").isNull())) == [2, 1]


def bodies(spark, *rows):
    return spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r,) for r in rows], "body string")


def test_payloads(spark):
    oa = payloads.openalex_search(bodies(spark, {"results": [{"title": "<i>Deep</i> &amp; wide", "publication_year": 2017, "authorships": [{"author": {"display_name": "Ashish Vaswani"}}], "cited_by_count": 5, "doi": "https://doi.org/10.1/x"}, {"title": None}]}, "no json", {"total": 0})).collect()
    assert [(r.title, r.year, r.authors, r.doi, r.citations) for r in oa] == [("Deep & wide", "2017", ["Vaswani"], "10.1/x", 5), ("N/A", "?", [], None, None)]
    dblp = payloads.dblp_search(bodies(spark, {"result": {"hits": {"hit": [{"info": {"title": "A", "year": "2001", "authors": {"author": {"text": "One Person"}}}}, {"info": {"title": "B", "authors": {"author": [{"text": "X Y"}, "Z W"]}}}, {"info": {"authors": {"author": "Q R"}}}, {"info": {"title": "C"}}]}}})).collect()
    assert [r.authors for r in dblp] == [["Person"], ["Y", "W"], ["R"], []]
    cr = payloads.crossref_search(bodies(spark, {"message": {"items": [{"title": ["T"], "author": [{"given": "A", "family": "B"}, {"given": "x"}, {"family": "C"}], "published": {"date-parts": [[2020, 1]]}, "DOI": "10.1/y", "is-referenced-by-count": 3}]}})).first()
    assert (cr.title, cr.authors, cr.year, cr.doi, cr.citations) == ("T", ["A B", "C"], "2020", "10.1/y", 3)
    s2 = payloads.scholar_related(bodies(spark, {"data": [{"citedPaper": {"paperId": "1", "title": "T", "year": 2001, "authors": [{"name": "A B"}], "externalIds": {"DOI": "d"}}}, {"citedPaper": None}]}), "citedPaper").collect()
    assert [(r.s2_id, r.authors, r.doi) for r in s2] == [("1", ["A B"], "d")]
    paper = payloads.scholar_paper(bodies(spark, {"paperId": "1", "venue": "", "citationCount": 7, "openAccessPdf": {"url": "u"}})).first()
    assert (paper.venue, paper.citations, paper.pdf_url) == (None, 7, "u")
    isbn = payloads.openlibrary_isbn(bodies(spark, {"ISBN:123": {"title": "T", "subtitle": "S", "publish_date": "March 2018", "publishers": [{"name": "P"}], "identifiers": {"isbn_10": ["10"]}}}, {"ISBN:9": {}})).collect()
    assert [(r.title, r.year, r.venue, r.isbn) for r in isbn] == [("T: S", "2018", "P", "10"), ("N/A", "?", None, "9")]
    for root in ([{"title": "T", "pubYear": "1999", "eId": "E", "authors": [{"name": "Last, First"}]}], {"entries": [{"title": "T", "year": "1999", "eId": "E", "authorsStr": "First Last, "}]}):
        pp = payloads.philpapers_search(bodies(spark, root)).first()
        assert (pp.year, pp.authors, pp.pdf_url) == ("1999", ["First Last"], "https://philpapers.org/rec/E")
    clio = payloads.catalog_search(bodies(spark, {"response": {"docs": [{"title_display": ["T"], "url_munged_display": ["x|https://doi.org/10.1/z|y", "a|http://p/q"], "isbn_display": ["123 (pbk)"]}, {"title_display": []}]}})).collect()
    assert [(r.doi, r.pdf_url, r.isbn, r.year) for r in clio] == [("10.1/z", "http://p/q", "123", "")]
    editions = payloads.openlibrary_editions(bodies(spark, {"entries": [{"title": "b"}, {"title": "a", "publish_date": "1990"}]})).collect()
    assert [r.title for r in editions] == ["a", "b"]
    assert payloads.unpaywall(bodies(spark, {"best_oa_location": {"url": "u"}})).first().pdf_url == "u"
    assert payloads.openlibrary_author(bodies(spark, {"personal_name": "N"})).first().name == "N"


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>q</title><entry><id>http://arxiv.org/abs/2006.11239v2</id><published>2020-06-19T17:24:44Z</published><title>Denoising
  Models</title><summary>{}</summary><author><name>Jonathan Ho</name></author><author><name>Ajay Jain</name></author><link href="http://arxiv.org/abs/x" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/x"/><category term="cs.LG"/><category term="stat.ML"/><category term="cs.LG"/></entry></feed>"""


def test_atom_and_marc(spark, tmp_path):
    r = markup.atom_entry(bodies(spark, ATOM.format("a" * 250), "<feed></feed>", "junk")).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.title, r.arxiv_id, r.year, r.published_date, r.authors, r.categories, r.pdf_url) == ("Denoising Models", "2006.11239", "2020", "2020-06-19", ["Jonathan Ho", "Ajay Jain"], ["cs.LG", "stat.ML"], "http://arxiv.org/pdf/x")
    assert r.abstract == "a" * 200 + "..."
    marc = """<collection xmlns="http://www.loc.gov/MARC21/slim"><record><controlfield tag="008">850101s1999    nyu</controlfield><datafield tag="245" ind1="1" ind2="0"><subfield code="a">Causality :</subfield><subfield code="b">models /</subfield></datafield><datafield tag="100" ind1="1" ind2=" "><subfield code="a">Pearl, Judea.</subfield></datafield><datafield tag="020" ind1=" " ind2=" "><subfield code="a">0521 (hb)</subfield></datafield><datafield tag="856" ind1="4" ind2="0"><subfield code="u">https://doi.org/10.1/q</subfield></datafield></record><record><controlfield tag="008">x</controlfield></record></collection>"""
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a.xml.gz", "wt") as f:
        f.write(marc)
    rows = markup.marc_records(spark, str(tmp_path / "in")).collect()
    assert [(r.title, r.authors, r.year, r.isbn, r.doi, r.online) for r in rows] == [("Causality models", "Pearl, Judea", "1999", "0521", "10.1/q", True)]
    from folioscope.streaming.ingest import ingest_catalog

    for _ in range(2):
        ingest_catalog(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


BIB = """@comment{no}
@Article{key1,
  title = {Deep {Nested} Title}, author = "A \\"B\\" C and D, E",
  year = 2001, doi = {10.1/X}
}

% lit:skip
@book{skipped, title={S}}



@book{9bad, title = {Other},
 eprint={1}, author={Q}, year={2000}}
@misc{key3, title={T}, author={W}, year={1}, doi={10.1/x}, eprint={1}}
"""


def test_bibtex(spark):
    files = spark.createDataFrame([("f", BIB)], "path string, value string")
    rows = markup.bib_table(files).orderBy("pos").collect()
    assert [(r.path, r.entry_type, r.key) for r in rows] == [("f", "article", "key1"), ("f", "book", "9bad"), ("f", "misc", "key3")]
    assert [(f.name, f.value) for f in rows[0].fields] == [("title", "Deep {Nested} Title"), ("author", 'A \\"B\\" C and D, E'), ("year", "2001"), ("doi", "10.1/X")]
    v = markup.verification_entries(markup.bib_table(files)).orderBy("pos").first()
    assert (v.title, v.author, v.year) == ("Deep Nested Title", "C", "2001")
    report = {tuple(r) for r in commands.clean_file(files.select("value"), spark.createDataFrame([("\\cite{key1, 9bad}",)], "value string")).collect()}
    assert report == {("malformed", "9bad", None), ("duplicate", "key3", "9bad"), ("duplicate", "key3", "key1"), ("orphan", "key3", None)}
    assert bibfile.keys(bibfile.without(BIB, {"9bad"})) == ["key1", "key3"]
    assert "% lit:skip" in bibfile.without(BIB, {"9bad"})
    new = bibfile.upsert(BIB, "@misc{key3, title={New}}")
    assert bibfile.keys(new) == ["key1", "9bad", "key3"] and "{New}" in new and "{T}" not in new
    assert bibfile.keys(bibfile.upsert(BIB, "@misc{key4, title={New}}")) == ["key1", "9bad", "key3", "key4"]
    assert bibfile.append("", "@a{b}") == "@a{b}\n"


def test_text_sources(spark, tmp_path):
    tex = spark.createDataFrame([("\\cite{a, b} \\citep[x]{c} \\citet*{d}\\cite\n{no} \\citealt{ a }",)], "value string")
    assert sorted(ids(markup.cited_keys(tex), "key")) == ["a", "b", "c", "d"]
    y = markup.yaml_records(spark.createDataFrame([("p", '# c\ntitle: "A: B"\nauthors: X Y and Z, W\nyear: 2001\narxiv: 1\nother: q')], "path string, value string")).first()
    assert (y.title, y.authors, y.year, y.arxiv_id, y.doi) == ("A: B", ["X Y", "Z, W"], "2001", "1", None)
    html = spark.createDataFrame([('<a href="/x/a.xml.gz">a</a><a href="b.html">',)], "html string")
    assert ids(markup.index_files(html), "filename") == ["a.xml.gz"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "source.yaml").write_text("title: T\narxiv: 2001.1\n")
    (tmp_path / "cookies").write_text("# c\nd\tT\t/\tT\t200\tn\tv\nd\tT\t/\tT\t100\tn\tv\n")
    assert tuple(markup.cookie_expiry(spark, str(tmp_path / "cookies")).first()) == (2, 100, 200)
    folders = markup.paper_folders(spark, str(tmp_path))
    assert folders.count() == 1
    assert [(r.title, r.rejected) for r in commands.rebuild(folders).collect()] == [("T", False)]
    files = spark.createDataFrame([("f", "x.tex", "q"), ("f", "main.tex", "q"), ("f", "paper.txt", "z"), ("g", "paper.txt", " "), ("g", "paper.pdf", "")], "folder string, name string, value string")
    assert {r.folder: r.name for r in markup.preferred_text(files).collect()} == {"f": "main.tex", "g": "paper.pdf"}
    found = markup.resolve_folder(spark.createDataFrame([("2001.1", "x"), ("20011", "y")], "name string, content string"), "2001.1").collect()
    assert [(r.name, r.matches) for r in found] == [("2001.1", 1)]


def test_search_commands(spark):
    ss = {"data": [{"title": "unrelated", "authors": []}]}
    oa = {"results": [{"title": "Attention is all you need", "cited_by_count": 1, "doi": "https://doi.org/10.1/A"}, {"title": "Attention again", "cited_by_count": 9, "doi": "https://doi.org/10.1/a"}]}
    df = spark.createDataFrame([("ss", json.dumps(ss)), ("oa", json.dumps(oa))], "source string, body string")
    assert [r.title for r in commands.search_payloads(df, "attention need").collect()] == ["Attention is all you need"]
    assert [r.title for r in commands.search_payloads(df, "zzz").collect()] == ["Attention is all you need", "unrelated"]
    assert [r.title for r in commands.search_payloads(df, "attention", "ss").collect()] == ["unrelated"]
    atom = spark.createDataFrame([("arxiv", "2006.11239", ATOM.format("s")), ("ss_paper", "2006.11239", json.dumps({"paperId": "p", "venue": "NeurIPS", "citationCount": 3}))], "source string, ref string, body string")
    r = commands.lookup(atom, "https://arxiv.org/abs/2006.11239").first()
    assert (r.venue, r.citations, r.s2_id) == ("NeurIPS", "3", "p") and r.bibtex.startswith("@article{ho2020denoising,\n  title = {Denoising Models},")
    assert commands.lookup(atom, "words").count() == 0
    key, text = commands.add("", atom, "2006.11239")
    assert key == "ho2020denoising" and text.startswith("@inproceedings{ho2020denoising,") and "booktitle = {NeurIPS}" in text
    assert commands.add(text, atom, "2006.11239", "mine")[1].count("@inproceedings") == 2
    with pytest.raises(ValueError):
        commands.add("", atom, "words")
    key, text = commands.misc("", "k", "T", ["A B", "C D"], "2001", note="n")
    assert (key, text) == ("k", "@misc{k,\n  title = {T},\n  author = {A B and C D},\n  year = {2001},\n  note = {n},\n}\n")
    assert commands.remove(text, "k") == (True, "") and commands.remove(text, "other") == (False, text)
    pages = [("dblp_bib", "https://dblp.org/rec/1", "@article{x, title={Y}}"), ("pp_bib", "E-1", "@article{x, title={Y}, author={B, A}, year={2001}}"), ("page", "https://x.org/p", "<html><TITLE> Denoising &amp; more </TITLE>"), ("ss", "Denoising & more", json.dumps({"data": [{"title": "Denoising more", "externalIds": {"ArXiv": "2006.11239"}}]})), ("page", "https://x.org/q", "<p>none</p>")]
    more = atom.unionAll(spark.createDataFrame(pages, "source string, ref string, body string"))
    titles = {i: [x.title for x in commands.lookup(more, i).collect()] for i in ("https://dblp.org/rec/1.bib", "https://philpapers.org/rec/E-1", "https://x.org/p", "https://x.org/q")}
    assert titles == {"https://dblp.org/rec/1.bib": ["https://dblp.org/rec/1.bib"], "https://philpapers.org/rec/E-1": ["Y"], "https://x.org/p": ["Denoising Models"], "https://x.org/q": []}


def test_store_commands(spark, tmp_path):
    folders = spark.createDataFrame([("b", "title: Second\ndoi: 10.1/x"), ("a", "title: First\ndoi: 10.1/x"), ("c", "authors: X")], "path string, value string")
    where = str(tmp_path / "store")
    for _ in range(2):
        assert commands.rebuild_store(folders, where) == 1
    assert spark.read.parquet(where).first().title == spark.read.parquet(where + ".bak").first().title == "Second"
    with pytest.raises(ValueError):
        commands.rebuild_store(folders.limit(0), where)
    record = spark.createDataFrame([("Third", ["A"], "2001", "10.1/x", None, 3, None, None, None, None, None, None, [])], ", ".join(f"{k} {v}" for k, v in payloads.RECORD.items()))
    assert [(r.title, r.year, r.citation_count) for r in commands.keep(spark.read.parquet(where), record).collect()] == [("Third", "2001", 3)]
    report = spark.createDataFrame([("malformed", "9", None), ("duplicate", "b", "a"), ("orphan", "c", None)], "kind string, key string, kept_key string")
    lines = lambda *a: [r.line for r in commands.clean_summary(*a).collect()]
    assert lines(report) == ["Malformed (1):", "  9", "Duplicates (1):", "  keep:a remove:b", "Orphans (1):", "  c", "Dry run: 3 issues found. Pass --apply to remove malformed + duplicate entries."]
    assert lines(report, False, True)[-3:] == ["Removed 2 entries:", "  9", "  b"]
    assert lines(report.limit(0)) == ["No issues found."]
    names = spark.createDataFrame([("p.1", ""), ("p.2", "")], "name string, content string")
    files = spark.createDataFrame([("p.1", "main.tex", ""), ("p.1", "a.tex", ""), ("p.2", "x.tex", ""), ("p.2", "paper.pdf", "")], "folder string, name string, value string")
    shown = lambda asked: [(r.name, r.matches, r.file, r.kind, r.extra) for r in commands.read(names, files, asked).orderBy("name").collect()]
    assert shown("p.1") == [("p.1", 1, "main.tex", "tex", ["a.tex", "main.tex"])] and shown("p.2") == [("p.2", 1, "paper.pdf", "txt (generated from PDF)", [])]
    assert [r[1:3] for r in shown("p")] == [(2, None)] * 2
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "a.xml.gz", "wt") as f:
        f.write('<collection><record><datafield tag="245" ind1="1" ind2="0"><subfield code="a">T</subfield></datafield></record></collection>')
    index = spark.createDataFrame([('<a href="/x/a.xml.gz">a</a><a href="b.xml.gz">',)], "html string")
    for _ in range(2):
        got = commands.catalog_sync(spark, index, *(str(tmp_path / n) for n in ("in", "sink", "ledger")))
    assert {(r.filename, r.here) for r in got.collect()} == {("a.xml.gz", True), ("b.xml.gz", False)}
    assert [r.title for r in spark.read.parquet(str(tmp_path / "sink")).collect()] == ["T"]


def test_store(spark):
    cols = "seq long, title string, authors array<string>, year string, doi string, arxiv_id string, isbn string, s2_id string, openalex_id string, entry_type string, citation_count long, deleted_at timestamp"
    row = lambda seq, title, **k: (seq, title, ["A"], k.get("year"), k.get("doi"), k.get("arxiv_id"), None, k.get("s2_id"), None, "Article", k.get("cites"), None)
    rows = [row(1, "first", doi="d1", s2_id="s", cites=100), row(2, "x" * 2001, doi="d1", year="not4", s2_id="t", cites=50), row(3, "other", arxiv_id="a1"), row(4, "both", doi="d1", arxiv_id="a1"), row(5, "repeat", s2_id="s"), row(6, "alone")]
    got = {(r.seq, r.rejected): r for r in store.upsert(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {(1, False), (3, False), (4, True), (5, True), (6, False)}
    first = got[(1, False)]
    assert (len(first.title), first.s2_id, first.citation_count, first.entry_type, first.year) == (2000, "s", 50, "article", None)
    claims = spark.createDataFrame([(1, "year", "a", "2001", 1, 1), (1, "year", "a", "2002", 2, 2), (1, "year", "b", "2003", 1, 3), (1, "title", "a", "T", 1, 4)], "paper_id int, field string, source string, value string, fetched_at int, seq int")
    last = store.latest_claims(claims)
    assert {(r.source, r.field): r.value for r in last.collect()} == {("a", "year"): "2002", ("b", "year"): "2003", ("a", "title"): "T"}
    assert [(r.paper_id, r.field, r.n_values) for r in linkage.claim_conflicts(last).collect()] == [(1, "year", 2)]
    assert store.largest_claim(claims, "year").first().value == 2003
    assert one(spark, store.leading_integer, "12abc") == 12 and one(spark, store.leading_integer, "abc") == 0


def test_linkage(spark):
    entries = spark.createDataFrame([("k1", 0, "article", "Attention is all you need", "Vaswani", "2017", "", ""), ("k2", 1, "article", "Other paper with long title", "Smith", "2000", "10.1/z", ""), ("k3", 2, "book", "Causality", "Pearl", "2009", "", ""), ("k4", 3, "misc", "Nothing like it", "No", "1", "", "")], "key string, pos int, entry_type string, title string, author string, year string, doi string, eprint string")
    found = "id string, title string, year string, authors array<string>, pos int, doi string"
    oa = spark.createDataFrame([("o1", "Attention Is All You Need!", "2017", ["Vaswani"], 0, "https://doi.org/10.5/a"), ("o2", "Attention is all you want", "2017", ["X"], 1, None)], found)
    none = spark.createDataFrame([], found)
    books = spark.createDataFrame([("b", "Causality: models", "2009", ["Pearl"], 0, None)], found)
    direct = spark.createDataFrame([("10.1/z", "Other paper with long title", "2001", ["A Jones"])], "ref string, title string, year string, authors array<string>")
    got = {r.key: (r.status, r.source, r.issues) for r in linkage.verify(entries, direct, direct.limit(0), oa, none, books).collect()}
    assert got == {"k1": ("ok", "OpenAlex", ["add-doi:10.5/a"]), "k2": ("mismatch", "DOI", ["year:2000->2001", "author:Smith->Jones"]), "k3": ("book", "OpenLibrary", []), "k4": ("unknown", "", [])}


def test_render(spark):
    df = spark.createDataFrame([("T", ["A B", "C D"], "2001", "d", None, 3, None, None, None, None, None, None, [])], ", ".join(f"{k} {v}" for k, v in payloads.RECORD.items()))
    assert json.loads(df.select(render.record_json().alias("j")).first().j) == {"title": "T", "authors": ["A B", "C D"], "year": "2001", "doi": "d", "citations": 3}
    assert df.select(render.book_bibtex().alias("b")).first().b == "@book{b2001,\n  title = {T},\n  author = {A B},\n  year = {2001}\n}"
    assert df.select(render.source_yaml("doi", F.col("doi"), F.lit("2020-01-01")).alias("y")).first().y == 'title: "T"\nauthors: "A B and C D"\nyear: 2001\ndoi: "d"\nretrieved: "2020-01-01"\n'
    assert render.from_rows(render.to_rows(df)).first().asDict() == df.first().asDict()
    assert df.select(render.report_line(F.lit(1)).alias("l")).first().l == "1. T (2001) A B, C D [3 citations]"


def test_fetch(spark, tmp_path):
    from folioscope.sources import fetch as f

    seen = []

    def flaky(url):
        seen.append(url)
        if len(seen) < 3:
            return 429, {"Retry-After": "99"}, ""
        return 200, {}, "{}"

    waits = []
    assert f.retrying(flaky, "u", waits.append) == "{}" and waits == [5.0, 5.0]
    assert f.retrying(lambda u: (404, {}, "{}"), "u") is None
    assert f.retrying(lambda u: (503, {}, ""), "u", lambda s: None) is None
    requests = spark.createDataFrame([("a", "ua"), ("b", "ub"), ("c", "uc")], "cache_key string, url string")
    cache = spark.sql("SELECT 'a' AS cache_key, 'ua' AS url, '{1}' AS body, timestamp'2020-01-01 00:00:00' AS fetched_at UNION ALL SELECT 'b', 'ub', '{old}', timestamp'2000-01-01 00:00:00'")
    got = f.fetch(requests, cache, lambda u: (200, {}, f"[{u}]" if u == "ub" else "plain"), F.lit("2020-01-01 01:00:00").cast("timestamp"))
    assert {r.cache_key: r.body for r in got.collect()} == {"a": "{1}", "b": "[ub]"}
    assert f.inside(str(tmp_path), "x.bib", ".bib").name == "x.bib"
    for bad, suffix in (("../x", None), ("x.txt", ".bib")):
        with pytest.raises(ValueError):
            f.inside(str(tmp_path), bad, suffix)


def test_work_record_and_postings(spark):
    works = spark.createDataFrame([("w", json.dumps({"title": "T", "authors": [{"author": {"key": "/a/1"}}, {"author": {"key": "/a/2"}}]}))], "work string, body string")
    editions = spark.createDataFrame([("w", json.dumps({"entries": [{"publishers": ["late"], "publish_date": "2001"}, {"publishers": ["none"]}, {"publishers": ["early"], "publish_date": "May 1990"}]}))], "work string, body string")
    authors = spark.createDataFrame([("/a/1", json.dumps({"name": "Ezekiel, Mordecai"}))], "key string, body string")
    assert tuple(commands.work_record(works, editions, authors).first()) == ("w", "T", "early", "1990", "Mordecai Ezekiel")
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "id int, t string")
    index = search.postings(docs, "id", ["t"])
    new = search.maintain_postings(index, spark.createDataFrame([(2, "z"), (4, "y")], "id int, t string"), spark.createDataFrame([(3,)], "id int"), "id", ["t"])
    assert {(r.doc, r.term) for r in new.collect()} == {(1, "a"), (1, "b"), (2, "z"), (4, "y")}
