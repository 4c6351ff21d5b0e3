"""The address of each request, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.scalars import normalize_node_id, url_encode

# Request patterns; {} is the argument, {n} the number of rows, {mail} an address.
PATTERNS = {
    "oa_search": "https://api.openalex.org/works?search={}&per-page={n}",
    "oa_title": "https://api.openalex.org/works?filter=title.search:{}&per-page={n}",
    "oa_doi": "https://api.openalex.org/works/doi:{}",
    "ss_search": "https://api.semanticscholar.org/graph/v1/paper/search?query={}&limit={n}&fields=title,authors,year,citationCount,externalIds",
    "ss_paper": "https://api.semanticscholar.org/graph/v1/paper/{}?fields=paperId,externalIds,venue,citationCount,openAccessPdf",
    "ss_refs": "https://api.semanticscholar.org/graph/v1/paper/{}/references?fields=title,authors,year,externalIds&limit=50",
    "ss_cites": "https://api.semanticscholar.org/graph/v1/paper/{}/citations?fields=title,authors,year,externalIds&limit=50",
    "cr_search": "https://api.crossref.org/works?query={}&rows={n}&sort=relevance",
    "cr_doi": "https://api.crossref.org/works/{}",
    "cr_bibtex": "https://api.crossref.org/works/{}/transform/application/x-bibtex",
    "dblp_search": "https://dblp.org/search/publ/api?q={}&format=json&h={n}",
    "arxiv": "https://export.arxiv.org/api/query?id_list={}",
    "ol_search": "https://openlibrary.org/search.json?q={}&limit={n}",
    "ol_isbn": "https://openlibrary.org/api/books?bibkeys=ISBN:{}&format=json&jscmd=data",
    "ol_work": "https://openlibrary.org/works/{}.json",
    "ol_edition": "https://openlibrary.org/books/{}.json",
    "ol_editions": "https://openlibrary.org/works/{}/editions.json?limit=50",
    "ol_author": "https://openlibrary.org{}.json",
    "pp_search": "https://philpapers.org/api/search?q={}&format=json&limit={n}",
    "pp_bib": "https://philpapers.org/rec/{}.bib",
    "unpaywall": "https://api.unpaywall.org/v2/{}?email={mail}",
    "clio_search": "https://clio.columbia.edu/catalog.json?q={}&per_page={n}",
}
#: Arguments that go in as they are, or by a rule of their own, instead of encoded.
_PLAIN = ("oa_doi", "cr_doi", "cr_bibtex", "arxiv", "ol_isbn", "ol_work", "ol_edition", "ol_editions", "ol_author", "pp_bib", "unpaywall")
AS_IS: dict[str, Callable[[Column], Column]] = {k: (lambda x: x) for k in _PLAIN} | {k: normalize_node_id for k in ("ss_paper", "ss_refs", "ss_cites")}


def request(kind: str, value: Column, n: int = 10, mail: str = "user@example.com") -> Column:
    head, tail = PATTERNS[kind].replace("{n}", str(n)).replace("{mail}", mail).split("{}")
    return F.concat(F.lit(head), AS_IS.get(kind, url_encode)(value), F.lit(tail))
