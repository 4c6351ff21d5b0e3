"""Scalar rules of bibliographic records, as column expressions that stay inside codegen.

Each takes columns and returns a column. Unless it says otherwise, null gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no part of a citation key.
SKIP_WORDS = ["the", "a", "an", "of", "and", "in", "on", "for", "to", "how", "what", "why", "when", "with", "from", "by", "is", "are", "at", "its"]
# URL prefixes of identifiers.
ARXIV_PREFIXES = ["https://export.arxiv.org/abs/", "https://arxiv.org/abs/", "http://arxiv.org/abs/", "https://arxiv.org/pdf/", "http://arxiv.org/pdf/"]
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/"]
# Kinds of input by pattern, the first that matches counts; a plain URL comes before bare ids.
INPUT_KINDS = [
    (r"^https?://([a-z]+\.)?arxiv\.org/", "arxiv"),
    (r"^https?://(dx\.)?doi\.org/", "doi"),
    (r"^https?://dblp\.org/", "dblp_url"),
    (r"^https?://www\.semanticscholar\.org/", "semantic_scholar_url"),
    (r"^https?://philpapers\.org/rec/", "philpapers_url"),
    (r"^https?://openlibrary\.org/(works|books)/", "openlibrary_url"),
    (r"^https?://", "url"),
    (r"^(arXiv:|arxiv:)?[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$", "arxiv"),
    (r"^[a-z-]+(\.[A-Z][A-Za-z-]*)?/[0-9]{7}(v[0-9]+)?$", "arxiv"),
    (r"^10\.[0-9]{4,}/", "doi"),
]
ISBN = r"^[0-9]{9}[0-9Xx]$|^[0-9]{13}$"
# HTML entities, decoded in this order.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'")]
# Venues that name no venue.
JUNK_VENUES = ["arxiv.org", "arxiv", "biorxiv.org", "biorxiv"]


def _alternatives(prefixes: list[str]) -> str:
    return "^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"


def _end(pattern: str) -> str:
    r"""Java's $ also matches before a last line break; \z doesn't."""
    return pattern.replace("$", r"\z")


def trimmed(x: Column) -> Column:
    """F.trim of one argument: handed to F.transform, F.trim itself would take places for what to trim."""
    return F.trim(x)


def detect_type(x: Column) -> Column:
    """one of arxiv, doi, isbn, dblp_url, semantic_scholar_url, philpapers_url, openlibrary_url, url, search."""
    kind = F.when(F.translate(x, "- ", "").rlike(_end(ISBN)), "isbn").when(x.isNotNull(), "search")
    return reduce(lambda rest, rule: F.when(x.rlike(_end(rule[0])), rule[1]).otherwise(rest), reversed(INPUT_KINDS), kind)


def normalize_arxiv(x: Column) -> Column:
    """URL prefix, arXiv: prefix, version and then .pdf are taken off, in that order."""
    bare = F.regexp_replace(x, _alternatives(ARXIV_PREFIXES), "")
    bare = F.regexp_replace(F.regexp_replace(bare, "^(arXiv:|arxiv:)", ""), r"v[0-9]+\z", "")
    return F.regexp_replace(bare, r"\.pdf\z", "")


def normalize_doi(x: Column) -> Column:
    """F3"""
    return F.regexp_replace(x, _alternatives(DOI_PREFIXES), "")


def normalize_isbn(x: Column) -> Column:
    """F4"""
    return F.translate(x, "- ", "")


def last_name(name: Column) -> Column:
    """F8: the last token; a blank name as it is."""
    tokens = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    return F.when(F.trim(F.regexp_replace(name, r"\s+", " ")) == "", name).otherwise(F.element_at(tokens, -1))


def first_author_last_name(authors: Column) -> Column:
    """F8 of the first of an array of names; empty for none."""
    return F.coalesce(last_name(F.try_element_at(authors, F.lit(1))), F.lit(""))


def _first_word(words: Column) -> Column:
    kept = F.filter(words, lambda w: ~w.isin(*SKIP_WORDS) & (F.octet_length(w) > 2))
    return F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))


def cite_key(authors: Column, year: Column, title: Column) -> Column:
    """last name of the first author, year, first significant title word. Letters with accents are deleted."""
    name = F.when(F.size(F.coalesce(authors, F.array())) < 1, "unknown").otherwise(F.lower(F.regexp_replace(first_author_last_name(authors), "[^a-zA-Z]", "")))
    words = F.split(F.lower(F.trim(F.regexp_replace(F.regexp_replace(title, r"[^a-zA-Z\s]", ""), r"\s+", " "))), " ")
    return F.concat(name, year, _first_word(words))


def directory_slug(authors: Column, year: Column, title: Column) -> Column:
    """like a cite key, with letters of all scripts and words cut at all that is not alphanumeric."""
    name = F.when(F.size(F.coalesce(authors, F.array())) < 1, "unknown").otherwise(F.lower(F.regexp_replace(first_author_last_name(authors), r"[^\p{L}]", "")))
    return F.concat(name, year, _first_word(tokens(title)))


def cache_key(prefix: Column, value: Column) -> Column:
    """F7"""
    return F.concat(prefix, F.lit("_"), F.left(F.md5(F.concat(value, F.lit("\n"))), F.lit(16)))


def year_from_date(date: Column) -> Column:
    """the first run of exactly four digits, else the last four characters if digits, else "?"."""
    run = F.regexp_extract(date, r"(?<![0-9])([0-9]{4})(?![0-9])", 1)
    tail = F.right(date, F.lit(4))
    return F.when(run != "", run).when(tail.rlike(r"^[0-9]{4}\z"), tail).when(date.isNotNull(), "?")


def four_digits(x: Column) -> Column:
    """the first four digits in a row; null without."""
    return F.nullif(F.regexp_extract(x, "[0-9]{4}", 0), F.lit(""))


def doi_from_url(url: Column) -> Column:
    """what follows the first doi.org/; null without."""
    return F.nullif(F.regexp_extract(url, r"(?s)doi\.org/(.*)", 1), F.lit(""))


def url_encode(x: Column) -> Column:
    """RFC 3986, only unreserved characters stay."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def plain_text(x: Column) -> Column:
    """tags are taken out, then entities decoded in order."""
    return reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.regexp_replace(x, "<[^>]+>", ""))


def normalize_title(x: Column) -> Column:
    """letters and digits, lower case."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def normalize_author(x: Column) -> Column:
    """letters, lower case."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}]", ""))


def common_prefix_length(a: Column, b: Column) -> Column:
    """F15, in characters: one less than the first place where they differ."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differs = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n)


def author_matches(author: Column, names: Column) -> Column:
    """F16: the first four letters are somewhere in the names; shorter ones must be a word of them."""
    own, low = normalize_author(author), F.lower(names)
    word = F.concat(F.lit(" "), low, F.lit(" ")).contains(F.concat(F.lit(" "), own, F.lit(" ")))
    return F.when(own == "", True).when(F.length(own) >= 4, low.contains(F.left(own, F.lit(4)))).otherwise(word)


def years_within(a: Column, b: Column, n: int) -> Column:
    """false where either is no number."""
    return F.coalesce(F.abs(a.try_cast("int") - b.try_cast("int")) <= n, F.lit(False))


def safe_truncate(x: Column, n: int) -> Column:
    """the longest prefix of whole characters that has at most n bytes."""
    ends = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: F.octet_length(F.left(x, i)) <= n)
    return F.when(F.octet_length(x) <= n, x).otherwise(F.left(x, F.array_max(ends)))


def truncate(x: Column, n: int) -> Column:
    """at most n characters, "..." among them."""
    return F.when(F.length(x) <= n, x).otherwise(F.left(x, F.lit(n)) if n <= 3 else F.concat(F.left(x, F.lit(n - 3)), F.lit("...")))


def truncate_bytes(x: Column, n: int) -> Column:
    """F32: at most n bytes of whole characters, and "..." after them."""
    return F.when(F.octet_length(x) <= n, x).otherwise(F.concat(safe_truncate(x, n), F.lit("...")))


def authors_text(authors: Column, most: int = 500) -> Column:
    """a JSON array's first names joined; what is no JSON array stays as it is."""
    names = F.from_json(authors, "array<string>")
    return F.when(F.trim(authors).startswith("["), F.coalesce(F.array_join(F.slice(names, 1, most), ", "), authors)).otherwise(authors)


def keep_or_set(existing: Column, incoming: Column) -> Column:
    """F21"""
    return F.coalesce(existing, incoming)


def valid_year(x: Column) -> Column:
    """four ASCII digits, trimmed, else null."""
    return F.when(F.trim(x).rlike(r"^[0-9]{4}\z"), F.trim(x))


def invert_name(x: Column) -> Column:
    """"Last, First" to "First Last"."""
    last, rest = F.trim(F.split_part(x, F.lit(","), F.lit(1))), F.trim(F.regexp_extract(x, r"(?s)^[^,]*,(.*)\z", 1))
    return F.when(~x.contains(","), x).when(rest == "", last).otherwise(F.concat(rest, F.lit(" "), last))


def bib_key(entry: Column) -> Column:
    """the key of a BibTeX entry's text."""
    return F.nullif(F.regexp_extract(entry, r"@\w+\{\s*([^,\s]+)", 1), F.lit(""))


def replace_bib_key(entry: Column, key: Column) -> Column:
    """the same entry under another key."""
    head = F.regexp_extract(entry, r"(?s)^([^{]*\{)", 1)
    rest = F.regexp_extract(entry, r"(?s)^[^{]*\{[^,\n]*([,\n].*)\z", 1)
    return F.when(rest == "", entry).otherwise(F.concat(head, key, rest))


def titles_match(a: Column, b: Column) -> Column:
    """F26"""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def philpapers_id(url: Column) -> Column:
    """F27"""
    return F.nullif(F.regexp_extract(url, r"philpapers\.org/rec/([^/?#]+)", 1), F.lit(""))


def openlibrary_id(url: Column) -> Column:
    """the id of a work or edition page."""
    rest = F.regexp_extract(url, r"^https?://openlibrary\.org/(?:works|books)/([^?]*)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(rest, r"/+\z", ""), r"(\.json)+\z", ""), F.lit(""))


def arxiv_id_of_url(url: Column) -> Column:
    """the id after /abs/, without version."""
    return F.nullif(F.regexp_replace(F.regexp_extract(url, r"/abs/(.+)\z", 1), r"v[0-9]+\z", ""), F.lit(""))


def epoch_date(seconds: Column) -> Column:
    """F28"""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def open_url(x: Column) -> Column:
    """the page of an identifier, or of a search for it."""
    kind = detect_type(x)
    return (
        F.when(kind == "arxiv", F.concat(F.lit("https://arxiv.org/abs/"), normalize_arxiv(x)))
        .when(kind == "doi", F.concat(F.lit("https://doi.org/"), normalize_doi(x)))
        .when(kind == "isbn", F.concat(F.lit("https://openlibrary.org/isbn/"), normalize_isbn(x)))
        .when(kind == "search", F.concat(F.lit("https://www.semanticscholar.org/search?q="), url_encode(x)))
        .otherwise(x)
    )


def source_override(x: Column) -> Column:
    """stale, fresh or web, whatever the case; anything else is auto."""
    return F.when(F.lower(x).isin("stale", "fresh", "web"), F.lower(x)).when(x.isNotNull(), "auto")


def bib_field(fields: Column, name: str) -> Column:
    """the first of an array of (name, value) with the name, whatever its case."""
    return F.try_element_at(F.filter(fields, lambda f: F.lower(f["name"]) == name.lower()), F.lit(1))["value"]


def node_id(s2_id: Column, doi: Column, arxiv_id: Column) -> Column:
    """G6"""
    return F.coalesce(s2_id, F.concat(F.lit("DOI:"), doi), F.concat(F.lit("ARXIV:"), arxiv_id))


def normalize_node_id(x: Column) -> Column:
    """Prefixed ids pass; bare arXiv and DOI ids get their prefix."""
    arxiv = F.split(x, "v")[0].rlike(r"^[0-9]{4}\.[0-9]{4,5}\z")
    return F.when(x.contains(":"), x).when(arxiv, F.concat(F.lit("ARXIV:"), x)).when(x.rlike(r"^10\.[0-9]{4,}/"), F.concat(F.lit("DOI:"), x)).otherwise(x)


def tokens(x: Column) -> Column:
    """R2: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def relevance(query: Column, title: Column, authors: Column) -> Column:
    """The share of query tokens, repeats counted, among the tokens of title and authors; 0 for no query."""
    own = F.concat(tokens(title), F.flatten(F.transform(F.coalesce(authors, F.array().cast("array<string>")), tokens)))
    hits = F.size(F.filter(query, lambda t: F.array_contains(own, t)))
    return F.when(F.size(query) < 1, F.lit(0.0)).otherwise(hits / F.size(query))


def is_book_review(title: Column) -> Column:
    """P15"""
    low = F.lower(title)
    return low.contains("book review") | low.startswith("review of ") | low.contains("reviews:")


def is_junk_venue(venue: Column) -> Column:
    """P16"""
    return F.lower(venue).isin(*JUNK_VENUES)


def looks_like_payload(body: Column) -> Column:
    """P17"""
    return body.rlike(r"^\s*[{\[<]")


def is_malformed(key: Column, title: Column, author: Column, year: Column) -> Column:
    """The key has = or http or starts with a digit, or a required field is blank."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return key.contains("=") | key.contains("http") | key.rlike("^[0-9]") | blank(title) | blank(author) | blank(year)


def occurrences(x: Column, mark: str) -> Column:
    """How often a mark is in a text, without overlaps; null has none."""
    return F.coalesce(F.regexp_count(x, F.lit(rf"\Q{mark}\E")), F.lit(0))


def is_placeholder(title: Column, doi: Column, arxiv_id: Column) -> Column:
    """P14"""
    return (title == "unknown") & doi.isNull() & arxiv_id.isNull()


def issues(year: Column, found_year: Column, author: Column, found_author: Column, title: Column, found_title: Column) -> Column:
    """what differs between an entry and the record found for it; blanks don't count."""
    both = lambda a, b: (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    a, f = normalize_author(author), normalize_author(found_author)
    author_differs = F.when(F.length(a) >= 4, ~F.left(a, F.lit(4)).eqNullSafe(F.when(F.length(f) >= 4, F.left(f, F.lit(4))))).otherwise(a != f)
    return F.array_compact(
        F.array(
            F.when(both(year, found_year) & (year != found_year), F.concat(F.lit("year:"), year, F.lit("->"), found_year)),
            F.when(both(author, found_author) & author_differs, F.concat(F.lit("author:"), author, F.lit("->"), found_author)),
            F.when(both(title, found_title) & (F.left(normalize_title(title), F.lit(30)) != F.left(normalize_title(found_title), F.lit(30))), F.lit("title-mismatch")),
        )
    )
