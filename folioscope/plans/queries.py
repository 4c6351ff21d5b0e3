"""Registered queries of the bibliographic engine over the adapter views, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scalars as S
from folioscope.operators import graph, linkage, search, store
from folioscope.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- graph ------------------------------------------------------------------------------------------

_EDGES = f"WITH {A.PAPERS}, {A.CITATIONS}"


@query(f"""{_EDGES}, linked AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM citations UNION ALL SELECT dst, src FROM citations) WHERE a IN (1, 2, 3) AND b NOT IN (1, 2, 3))
SELECT id, title, year, citation_count, string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) AS linked_seeds, count(*) AS seed_count FROM linked JOIN papers ON b = id WHERE year IS NULL OR year >= 1980
GROUP BY id, title, year, citation_count ORDER BY seed_count DESC, citation_count DESC NULLS LAST, id""")
def graph_closure(spark, d):
    out = graph.closure(A.papers(spark, d), A.citations(spark, d), [1, 2, 3], "both", 1980)
    return out.select("id", "title", "year", "citation_count", F.array_join(F.col("linked_seeds").cast("array<string>"), ",").alias("linked_seeds"), "seed_count")


@query(f"""{_EDGES}, linked AS (SELECT DISTINCT dst AS a, src AS b FROM citations WHERE dst IN (5, 9) AND src NOT IN (5, 9))
SELECT id, count(*) AS seed_count FROM linked JOIN papers ON b = id GROUP BY id""")
def graph_closure_cites(spark, d):
    return graph.closure(A.papers(spark, d), A.citations(spark, d), [5, 9], "cites").select("id", "seed_count")


@query(f"""{_EDGES} SELECT id, title, citation_count FROM citations JOIN papers ON dst = id WHERE src = 1 ORDER BY citation_count DESC NULLS LAST, id""")
def graph_refs(spark, d):
    return graph.neighbours(A.papers(spark, d), A.citations(spark, d), 1, "refs").select("id", "title", "citation_count")


@query(f"""{_EDGES} SELECT id, title, citation_count FROM citations JOIN papers ON src = id WHERE dst = 1 ORDER BY citation_count DESC NULLS LAST, id LIMIT 10""")
def graph_cites_top(spark, d):
    return graph.neighbours(A.papers(spark, d), A.citations(spark, d), 1, "cites", 10).select("id", "title", "citation_count")



def _levels(direction: str, most: int) -> str:
    step = {"refs": "SELECT src AS a, dst AS b FROM citations", "both": "SELECT src AS a, dst AS b FROM citations UNION SELECT dst, src FROM citations"}[direction]
    return f"WITH RECURSIVE {A.CITATIONS}, steps AS ({step}), walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS level UNION SELECT b, level + 1 FROM walk JOIN steps ON node = a WHERE level < {most}) SELECT node, CAST(min(level) AS INTEGER) AS level FROM walk GROUP BY node"


@query(_levels("refs", 4))
def graph_hops_refs(spark, d):
    return graph.hops(A.citations(spark, d), spark.range(1, 2).select(F.col("id").alias("node")), "refs", 4)


@query(_levels("both", 3))
def graph_hops_both(spark, d):
    return graph.hops(A.citations(spark, d), spark.range(1, 2).select(F.col("id").alias("node")), "both", 3)


@query(f"""WITH RECURSIVE {A.CITATIONS}, steps AS (SELECT src AS a, dst AS b FROM citations UNION SELECT dst, src FROM citations),
walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS level UNION SELECT b, level + 1 FROM walk JOIN steps ON node = a WHERE level < 4)
SELECT min(level) AS hops, min(level) AS edges FROM walk WHERE node = 77""")
def graph_path_length(spark, d):
    """The length of a shortest path, and how many of its steps are edges: all. Both are null without a path."""
    return _path_length(A.citations(spark, d), 1, 77)


def _path_length(edges, start, end):
    both = graph.oriented(edges, "both").distinct()
    path = graph.shortest_path(edges, start, end)
    after = path.select((F.col("place") - 1).alias("place"), F.col("node").alias("next"))
    steps = path.join(after, "place", "left").join(both, (F.col("node") == F.col("a")) & (F.col("next") == F.col("b")), "left")
    length = lambda c: F.when(F.count("*") > 0, F.count(c)).cast("int")
    return steps.agg(length("next").alias("hops"), length("a").alias("edges"))


@query(f"""{_EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM citations UNION ALL SELECT dst, src FROM citations) SELECT a AS node, count(*) AS edges, count(DISTINCT b) AS neighbours FROM both_ways GROUP BY a""")
def graph_degrees(spark, d):
    return graph.oriented(A.citations(spark, d), "both").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("edges"), F.countDistinct("b").alias("neighbours"))


@query("SELECT CAST(count(*) AS BIGINT) AS edges FROM (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)")
def edge_insert(spark, d):
    e = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.insert_edges(e.where("src % 2 = 0"), e).agg(F.count("*").alias("edges"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey WHEN c_custkey % 3 = 1 THEN 'DOI:10.1/' || c_custkey WHEN c_custkey % 6 = 2 THEN 'ARXIV:2001.' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS node FROM customer""")
def node_ids(spark, d):
    k = F.col("c_custkey")
    s2, doi, arx = F.when(k % 3 == 0, F.concat(F.lit("s"), k.cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("10.1/"), k.cast("string"))), F.when(k % 6 == 2, F.concat(F.lit("2001."), F.lpad(k.cast("string"), 5, "0")))
    return A.table(spark, d, "customer").select(k.alias("id"), S.node_id(s2, doi, arx).alias("node"))


# -- projections, filters, statistics ------------------------------------------------------------------


@query(f"WITH {A.PAPERS} SELECT id, title, venue, year, citation_count FROM papers WHERE id = 42")
def point_lookup(spark, d):
    return store.find(A.papers(spark, d), "id", 42).select("id", "title", "venue", "year", "citation_count")


@query(f"WITH {A.PAPERS} SELECT id, title FROM papers WHERE title ILIKE '%red%' OR venue ILIKE '%brand#1_%'")
def contains_search(spark, d):
    return A.papers(spark, d).where(search.contains_any(["title"], "red") | search.contains_any(["venue"], "brand#1_")).select("id", "title")


@query(f"""{_EDGES} SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM citations) AS edges, (SELECT count(*) FROM events) AS cached, (SELECT CAST(sum(octet_length(encode(props))) AS BIGINT) FROM events) AS bytes""")
def store_statistics(spark, d):
    papers = A.papers(spark, d).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return store.statistics(papers, A.citations(spark, d), A.table(spark, d, "events").select(F.col("props").alias("body")))


@query(f"WITH {A.PAPERS}, page AS (SELECT * FROM papers ORDER BY citation_count DESC NULLS LAST, id LIMIT 21 OFFSET 40) SELECT id, citation_count, (SELECT count(*) FROM page) > 20 AS has_more FROM page ORDER BY citation_count DESC NULLS LAST, id LIMIT 20")
def paged_papers(spark, d):
    return store.paginate(A.papers(spark, d).select("id", "citation_count"), [F.desc_nulls_last("citation_count"), F.col("id")], 40, 20)


@query("""WITH o AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) SELECT p_partkey AS id, EXISTS (SELECT 1 FROM o WHERE l_partkey = p_partkey) AS bulk FROM part""")
def existence_probe(spark, d):
    return store.marked(A.table(spark, d, "part").select(F.col("p_partkey").alias("id")), A.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id")), "id", "bulk")


@query("SELECT o_orderkey AS id, substr(o_orderpriority, 3) AS name FROM orders WHERE starts_with(o_orderpriority, '1-')")
def key_prefix(spark, d):
    orders = A.table(spark, d, "orders")
    return store.keyed(orders, "o_orderpriority", "1-", "name").select(F.col("o_orderkey").alias("id"), "name")


@query("""SELECT doc_id, CASE WHEN lower(text) LIKE '%book review%' OR lower(text) LIKE 'review of %' OR lower(text) LIKE '%reviews:%' THEN true ELSE false END AS review,
regexp_matches(text, '^\\s*[{\\[<]') AS payload, lower(source) IN ('arxiv.org', 'arxiv', 'biorxiv.org', 'biorxiv') AS junk_venue FROM documents""")
def text_predicates(spark, d):
    return A.documents(spark, d).select("doc_id", S.is_book_review(F.col("text")).alias("review"), S.looks_like_payload(F.col("text")).alias("payload"), S.is_junk_venue(F.col("source")).alias("junk_venue"))


# -- claims and cache ----------------------------------------------------------------------------------


def _claims(spark, d):
    return store.latest_claims(A.raw_claims(spark, d))


@query(f"WITH {A.CLAIMS} SELECT paper_id, field, source, value, fetched_at FROM claims")
def claims_latest(spark, d):
    return _claims(spark, d).select("paper_id", "field", "source", "value", "fetched_at")


@query(f"WITH {A.CLAIMS} SELECT paper_id, field, count(DISTINCT value) AS n_values FROM claims GROUP BY paper_id, field HAVING count(DISTINCT value) > 1")
def claim_conflicts(spark, d):
    return linkage.claim_conflicts(_claims(spark, d))


@query(f"WITH {A.CLAIMS} SELECT paper_id, field, string_agg(source || '=' || value, ';' ORDER BY fetched_at DESC, source DESC, value DESC) AS found FROM claims GROUP BY paper_id, field HAVING count(DISTINCT value) > 1")
def conflict_details(spark, d):
    out = linkage.conflict_details(_claims(spark, d))
    return out.select("paper_id", "field", F.array_join(F.transform("found", lambda c: F.concat(c["source"], F.lit("="), c["value"])), ";").alias("found"))


@query(f"WITH {A.CLAIMS} SELECT count(DISTINCT paper_id) AS papers FROM (SELECT paper_id FROM claims GROUP BY paper_id, field HAVING count(DISTINCT value) > 1)")
def papers_in_conflict(spark, d):
    return linkage.claim_conflicts(_claims(spark, d)).agg(F.countDistinct("paper_id").alias("papers"))


@query(f"WITH {A.CLAIMS}, v AS (SELECT paper_id, field, coalesce(TRY_CAST(regexp_extract(value, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS n FROM claims) SELECT paper_id, max(n) AS value FROM v WHERE field = (SELECT min(field) FROM claims) GROUP BY paper_id")
def largest_claim(spark, d):
    c = _claims(spark, d)
    return store.largest_claim(c, c.agg(F.min("field")).first()[0])


@query(f"WITH {A.CLAIMS} SELECT value, source, fetched_at FROM claims WHERE paper_id = 7 AND field = (SELECT min(field) FROM claims WHERE paper_id = 7)")
def claims_of_paper(spark, d):
    c = _claims(spark, d)
    return store.claims_of(c, 7, c.where("paper_id = 7").agg(F.min("field")).first()[0] or "")


@query(f"WITH {A.RAW_CLAIMS} SELECT paper_id, count(*) AS n FROM raw_claims GROUP BY paper_id HAVING count(*) > 1")
def multi_source_counts(spark, d):
    return A.raw_claims(spark, d).groupBy("paper_id").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT user_id AS paper_id, event_type AS source, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS body FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1)""")
def multi_source_bodies(spark, d):
    e = A.table(spark, d, "events")
    sources = e.select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("source"), F.col("event_id").alias("cache_key"))
    return store.multi_source(sources, e.where("event_id % 2 = 0").select(F.col("event_id").alias("cache_key"), F.col("props").alias("body")))


def _cache(spark, d):
    return A.table(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("cache_key"), F.col("props").alias("body"), F.col("ts").alias("fetched_at"), "event_id")


@query("SELECT 'k' || event_id AS cache_key FROM events WHERE epoch((SELECT max(ts) FROM events)) - floor(epoch(ts)) < 86400 * 7")
def cache_hits(spark, d):
    c = _cache(spark, d)
    now = c.agg(F.max("fetched_at").alias("now"))
    return store.cache_hits(c.crossJoin(F.broadcast(now)), F.col("now"), store.TTL_LOOKUP).select("cache_key")


@query("SELECT 'k' || event_id AS cache_key FROM events WHERE floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) <= 86400 * 10 OR event_id % 5 = 0 OR event_id % 7 = 0")
def cache_eviction(spark, d):
    c = _cache(spark, d)
    now = c.agg(F.max("fetched_at").alias("now"))
    return store.evict(c.crossJoin(F.broadcast(now)), [c.where("event_id % 5 = 0"), c.where("event_id % 7 = 0")], F.col("now"), 10 * 86_400).select("cache_key")


@query("SELECT 'k' || event_id AS cache_key, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE props END AS body FROM events")
def cache_replace(spark, d):
    c = _cache(spark, d).drop("event_id")
    new = _cache(spark, d).where("event_id % 3 = 0").drop("event_id").withColumn("body", F.lit("new"))
    return store.cache_set(c, new).select("cache_key", "body")


@query("SELECT 'k' || event_id AS cache_key, props AS body FROM events")
def cache_scan_missing(spark, d):
    c = _cache(spark, d)
    return store.cache_insert_missing(c.where("event_id % 2 = 0").drop("event_id"), c.withColumn("body", F.col("body")).drop("event_id")).select("cache_key", "body")


@query("""SELECT 'k' || event_id AS cache_key, 'https://x/' || event_type AS url, concat('oa_', left(md5(props || chr(10)), 16)) AS hashed FROM events""")
def cache_keys(spark, d):
    e = A.table(spark, d, "events")
    return e.select(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("cache_key"), F.concat(F.lit("https://x/"), "event_type").alias("url"), S.cache_key(F.lit("oa"), F.col("props")).alias("hashed"))


@query("""WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS venue, CAST(NULL AS VARCHAR) AS kind FROM part), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_partkey END AS venue, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS kind FROM part), c AS (SELECT p_partkey AS id, p_name AS venue, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS kind FROM part)
SELECT a.id, coalesce(nullif(a.venue, ''), b.venue, c.venue) AS venue, coalesce(a.kind, b.kind, c.kind) AS kind FROM a LEFT JOIN b USING (id) LEFT JOIN c USING (id)""")
def enrichment(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    a = p.select(k.alias("id"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("venue"), F.lit(None).cast("string").alias("kind"))
    b = p.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("b"), k.cast("string"))).alias("venue"), F.when(k % 5 == 0, F.col("p_type")).alias("kind"))
    c = p.select(k.alias("id"), F.col("p_name").alias("venue"), F.when(k % 4 == 0, F.col("p_name")).alias("kind"))
    return store.enrich(a, [b, c], "id", ["venue", "kind"])


@query("""WITH have AS (SELECT DISTINCT 'd/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 <> 0), dirs AS (SELECT 'd/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 2 = 0)
SELECT 'missing' AS kind, path FROM have WHERE path NOT IN (SELECT path FROM dirs) UNION ALL SELECT 'untracked', path FROM dirs WHERE path NOT IN (SELECT path FROM have)""")
def path_differences(spark, d):
    s = A.table(spark, d, "supplier")
    path = F.concat(F.lit("d/"), F.col("s_suppkey").cast("string"))
    return store.path_differences(s.where("s_suppkey % 3 <> 0").select(path.alias("local_path"), F.lit(None).cast("timestamp").alias("deleted_at")), s.where("s_suppkey % 2 = 0").select(path.alias("path")))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'new' WHEN s_suppkey % 4 = 1 THEN NULL ELSE 'old' END AS local_path FROM supplier")
def local_paths(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("old").alias("local_path"))
    return store.set_local_path(s, s.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "new").alias("local_path")))


@query("SELECT n_regionkey AS k, max(n_name) AS v FROM nation GROUP BY n_regionkey")
def layered_settings(spark, d):
    n = A.table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("v"))
    top = n.groupBy("k").agg(F.max("v").alias("v"))
    return store.layered([n.groupBy("k").agg(F.min("v").alias("v")), top, top.withColumn("v", F.lit(None).cast("string"))], "k", "v")


@query("""SELECT min(event_id) AS seq, arg_max(event_type, event_id) AS title, '10.1/' || user_id AS doi, max(CASE WHEN event_id % 3 = 0 THEN 'a' || (user_id % 5000) END) AS arxiv_id, '2020' AS year, 'article' AS entry_type, arg_max(CAST(floor(value) AS BIGINT), event_id) FILTER (value IS NOT NULL) AS citation_count, false AS rejected FROM events WHERE event_id IS NOT NULL GROUP BY user_id""")
def upsert_fold(spark, d):
    """K1 over the events as records: those of a user share a DOI, and some an arXiv id, so the last of a
    user names the title and the first one's number stays."""
    e = A.table(spark, d, "events").where("event_id is not null")
    text = lambda c, m: F.when(F.col("event_id") % m == 0, F.concat(F.lit(c), (F.col("user_id") % 5000).cast("string")))
    null = lambda: F.lit(None).cast("string")
    records = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("title"), F.array(F.lit("A B")).alias("authors"), F.lit("2020").alias("year"), F.concat(F.lit("10.1/"), F.col("user_id").cast("string")).alias("doi"), text("a", 3).alias("arxiv_id"), null().alias("isbn"), null().alias("s2_id"), null().alias("openalex_id"), F.lit("Article").alias("entry_type"), F.floor("value").alias("citation_count"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return store.upsert(records).select("seq", "title", "doi", "arxiv_id", "year", "entry_type", F.col("citation_count").cast("bigint").alias("citation_count"), "rejected")


# -- scalar rules ----------------------------------------------------------------------------------------

_PAGE_INPUT = "(SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN 'https://arxiv.org/pdf/2001.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || 'v2' WHEN 1 THEN 'https://doi.org/10.1000/' || page_id WHEN 2 THEN '978-' || lpad(CAST(page_id AS VARCHAR), 10, '0') WHEN 3 THEN 'arXiv:2001.' || lpad(CAST(page_id AS VARCHAR), 5, '0') WHEN 4 THEN '10.1234/x' || page_id WHEN 5 THEN 'math.GT/' || lpad(CAST(page_id AS VARCHAR), 7, '0') WHEN 6 THEN url ELSE 'free text ' || page_id END AS x FROM pages)"
_KIND = r"""CASE WHEN regexp_matches(x, '^https?://([a-z]+\.)?arxiv\.org/') THEN 'arxiv' WHEN regexp_matches(x, '^https?://(dx\.)?doi\.org/') THEN 'doi' WHEN regexp_matches(x, '^https?://dblp\.org/') THEN 'dblp_url' WHEN regexp_matches(x, '^https?://www\.semanticscholar\.org/') THEN 'semantic_scholar_url' WHEN regexp_matches(x, '^https?://philpapers\.org/rec/') THEN 'philpapers_url' WHEN regexp_matches(x, '^https?://openlibrary\.org/(works|books)/') THEN 'openlibrary_url' WHEN regexp_matches(x, '^https?://') THEN 'url' WHEN regexp_matches(x, '^(arXiv:|arxiv:)?[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$') OR regexp_matches(x, '^[a-z-]+(\.[A-Z][A-Za-z-]*)?/[0-9]{7}(v[0-9]+)?$') THEN 'arxiv' WHEN regexp_matches(x, '^10\.[0-9]{4,}/') THEN 'doi' WHEN regexp_matches(replace(replace(x, '-', ''), ' ', ''), '^[0-9]{9}[0-9Xx]$|^[0-9]{13}$') THEN 'isbn' ELSE 'search' END"""


def _inputs(spark, d):
    k = F.col("page_id")
    five = F.lpad(k.cast("string"), 5, "0")
    c = F.concat
    L = F.lit
    x = F.when(k % 8 == 0, c(L("https://arxiv.org/pdf/2001."), five, L("v2"))).when(k % 8 == 1, c(L("https://doi.org/10.1000/"), k.cast("string"))).when(k % 8 == 2, c(L("978-"), F.lpad(k.cast("string"), 10, "0"))).when(k % 8 == 3, c(L("arXiv:2001."), five)).when(k % 8 == 4, c(L("10.1234/x"), k.cast("string"))).when(k % 8 == 5, c(L("math.GT/"), F.lpad(k.cast("string"), 7, "0"))).when(k % 8 == 6, F.col("url")).otherwise(c(L("free text "), k.cast("string")))
    return A.table(spark, d, "pages").select("page_id", "url", x.alias("x"))


@query(rf"""SELECT page_id, {_KIND} AS kind, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^(https://export\.arxiv\.org/abs/|https://arxiv\.org/abs/|http://arxiv\.org/abs/|https://arxiv\.org/pdf/|http://arxiv\.org/pdf/)', ''), '^(arXiv:|arxiv:)', ''), 'v[0-9]+$', ''), '\.pdf$', '') AS arxiv,
regexp_replace(x, '^(https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/)', '') AS doi, replace(replace(x, '-', ''), ' ', '') AS isbn FROM {_PAGE_INPUT}""")
def identifiers(spark, d):
    return _inputs(spark, d).select("page_id", S.detect_type(F.col("x")).alias("kind"), S.normalize_arxiv(F.col("x")).alias("arxiv"), S.normalize_doi(F.col("x")).alias("doi"), S.normalize_isbn(F.col("x")).alias("isbn"))


@query(rf"""WITH k AS (SELECT page_id, x, {_KIND} AS kind FROM {_PAGE_INPUT}) SELECT page_id, CASE WHEN contains(x, ':') THEN x WHEN regexp_matches(split_part(x, 'v', 1), '^[0-9]{{4}}\.[0-9]{{4,5}}$') THEN 'ARXIV:' || x WHEN regexp_matches(x, '^10\.[0-9]{{4,}}/') THEN 'DOI:' || x ELSE x END AS node, replace(replace(x, '%', '%25'), ' ', '%20') AS spaced FROM k""")
def node_id_rules(spark, d):
    return _inputs(spark, d).select("page_id", S.normalize_node_id(F.col("x")).alias("node"), F.replace(F.replace("x", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")).alias("spaced"))


@query("SELECT doc_id, url_encode(text) AS encoded FROM documents")
def url_encoding(spark, d):
    return A.documents(spark, d).select("doc_id", S.url_encode(F.col("text")).alias("encoded"))


_SKIPPED = "[" + ", ".join(f"'{w}'" for w in S.SKIP_WORDS) + "]"


@query(rf"""WITH w AS (SELECT c_custkey AS id, c_name, lower(regexp_replace(list_last(regexp_split_to_array(trim(c_name), '\s+')), '[^a-zA-Z]', '', 'g')) AS last, 1970 + c_custkey % 50 AS year, c_mktsegment || ' of the Graph-based ' || c_name AS title FROM customer)
SELECT id, last || year || coalesce(list_filter(regexp_split_to_array(lower(trim(regexp_replace(title, '[^a-zA-Z\s]', '', 'g'))), '\s+'), lambda t: NOT list_contains({_SKIPPED}, t) AND length(t) > 2)[1], '') AS cite_key,
last || year || coalesce(list_filter(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND NOT list_contains({_SKIPPED}, t) AND length(t) > 2)[1], '') AS slug FROM w""")
def citation_keys(spark, d):
    c = A.table(spark, d, "customer")
    authors, year, title = F.array("c_name", F.lit("Second Author")), (F.lit(1970) + F.col("c_custkey") % 50).cast("string"), F.concat("c_mktsegment", F.lit(" of the Graph-based "), "c_name")
    return c.select(F.col("c_custkey").alias("id"), S.cite_key(authors, year, title).alias("cite_key"), S.directory_slug(authors, year, title).alias("slug"))


@query(r"""SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS title, lower(regexp_replace(text, '[^\p{L}]', '', 'g')) AS author, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '...' END AS short,
nullif(regexp_extract(text, '[0-9]{4}'), '') AS year4 FROM documents""")
def text_rules(spark, d):
    t = F.col("text")
    return A.documents(spark, d).select("doc_id", S.normalize_title(t).alias("title"), S.normalize_author(t).alias("author"), S.truncate(t, 40).alias("short"), S.four_digits(t).alias("year4"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', '''') AS plain FROM pages""")
def page_text(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.plain_text(F.col("html")).alias("plain"))


@query("""WITH p AS (SELECT p_partkey AS a, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) AS x FROM part), q AS (SELECT a, x, lead(x) OVER (ORDER BY x, a) AS y FROM p)
SELECT a, CAST(coalesce(list_min(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[i] <> y[i])) - 1, least(length(x), length(y))) AS INTEGER) AS n FROM q WHERE y IS NOT NULL""")
def common_prefixes(spark, d):
    """Each part's name with the one after it in the order of names."""
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("a"), S.normalize_title(F.col("p_name")).alias("x"))
    order = F.struct("x", "a")
    places = p.withColumn("o", order).transform(lambda t: t.join(store.ranked(t, "o", "place"), "o"))
    after = places.select((F.col("place") - 1).alias("place"), F.col("x").alias("y"))
    return places.join(after, "place").select("a", S.common_prefix_length(F.col("x"), F.col("y")).cast("int").alias("n"))


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%B %Y') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y%m%d') ELSE 'n.d.' END AS x, ts FROM events)
SELECT event_id, CASE WHEN regexp_matches(x, '(^|[^0-9])[0-9]{4}([^0-9]|$)') THEN regexp_extract(x, '(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)', 1) WHEN regexp_matches(right(x, 4), '^[0-9]{4}$') THEN right(x, 4) ELSE '?' END AS year, strftime(to_timestamp(floor(epoch(ts))), '%Y-%m-%d') AS day FROM t""")
def date_rules(spark, d):
    e = F.col("event_id")
    x = F.when(e % 4 == 0, F.date_format("ts", "MMMM yyyy")).when(e % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(e % 4 == 2, F.date_format("ts", "yyyyMMdd")).otherwise("n.d.")
    return A.table(spark, d, "events").select("event_id", S.year_from_date(x).alias("year"), S.epoch_date(F.unix_timestamp("ts")).alias("day"))


# -- search ------------------------------------------------------------------------------------------------


def _results(spark, d):
    """documents as results of five sources, in order of id."""
    source = (F.col("doc_id") % 5).cast("int")
    return A.documents(spark, d).select("doc_id", source.alias("source_ord"), F.col("doc_id").alias("pos"), F.col("text").alias("title"), F.array("source").alias("authors"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/A"), (F.col("doc_id") % 40).cast("string"))).alias("doi"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("citations"))


_RESULTS = "results AS (SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS source_ord, doc_id AS pos, text AS title, source, CASE WHEN doc_id % 3 = 0 THEN '10.1/A' || (doc_id % 40) END AS doi, CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS citations FROM documents)"


def _score(words: list[str]) -> str:
    return f"CAST(len(list_filter({words}, lambda w: list_contains(list_concat(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), regexp_split_to_array(lower(source), '[^\\p{{L}}\\p{{N}}]+')), w))) AS DOUBLE) / {len(words)}"


@query(f"WITH {_RESULTS} SELECT doc_id, {_score(['the', 'of', 'src3'])} AS relevance FROM results")
def relevance_scores(spark, d):
    return _results(spark, d).select("doc_id", S.relevance(S.tokens(F.lit("The of, SRC3")), F.col("title"), F.col("authors")).alias("relevance"))


@query(f"WITH {_RESULTS}, u AS (SELECT *, row_number() OVER (PARTITION BY lower(doi) ORDER BY source_ord, pos) AS n FROM results) SELECT doc_id FROM u WHERE doi IS NULL OR n = 1")
def doi_dedup(spark, d):
    return search.dedup_by_doi(_results(spark, d), ["source_ord", "pos"]).select("doc_id")


@query(f"WITH {_RESULTS}, u AS (SELECT *, row_number() OVER (PARTITION BY lower(doi) ORDER BY source_ord, pos) AS n FROM results), s AS (SELECT *, {_score(['the', 'of', 'src3'])} AS relevance FROM u WHERE doi IS NULL OR n = 1) SELECT doc_id, relevance FROM s ORDER BY relevance DESC, coalesce(citations, 0) DESC, source_ord, pos LIMIT 25")
def reranked(spark, d):
    return search.rerank(_results(spark, d), "the of src3", limit=25).select("doc_id", "relevance")


@query(f"WITH {_RESULTS}, f AS (SELECT source_ord, arg_min(title, pos) AS title, arg_min(source, pos) AS source FROM results GROUP BY source_ord), c AS (SELECT min(source_ord) AS chosen FROM f WHERE {_score(['that', 'src3', 'zzz'])} >= 0.3) SELECT doc_id FROM results, c WHERE chosen IS NULL OR source_ord = chosen")
def cascade_choice(spark, d):
    return search.cascade(_results(spark, d), "that src3 zzz").select("doc_id")


@query(f"WITH {_RESULTS} SELECT doc_id, source_ord FROM results WHERE source_ord < 2 UNION ALL SELECT doc_id, 2 FROM results WHERE source_ord = 4")
def merged_sources(spark, d):
    r = _results(spark, d).drop("source_ord")
    return search.merge_sources([r.where("doc_id % 5 = 0"), r.where("doc_id % 5 = 1"), r.where("doc_id % 5 = 4")]).select("doc_id", "source_ord")


def _bm25_sql(terms: list[str], match: str) -> str:
    sums = " + ".join(f"CASE WHEN d{i}.tf IS NULL THEN 0 ELSE greatest(CASE WHEN ln((n - f{i} + 0.5) / (f{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - f{i} + 0.5) / (f{i} + 0.5)) END, 0) * d{i}.tf * 2.2 / (d{i}.tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) END" for i in range(len(terms)))
    joins = " ".join(f"LEFT JOIN (SELECT doc_id, count(*) AS tf FROM p WHERE term = '{t}' GROUP BY doc_id) d{i} ON d{i}.doc_id = s.doc_id CROSS JOIN (SELECT count(DISTINCT doc_id) AS f{i} FROM p WHERE term = '{t}') c{i}" for i, t in enumerate(terms))
    return rf"""WITH p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS term FROM documents),
s AS (SELECT d.doc_id, coalesce(l.dl, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS dl FROM p GROUP BY doc_id) l USING (doc_id)), w AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s)
SELECT s.doc_id AS doc, round(-({sums}), 6) AS score FROM s CROSS JOIN w {joins} WHERE {match}"""


@query(_bm25_sql(["thing", "shand"], "d0.tf > 0 AND d1.tf > 0").replace("shand", "and"))
def fts_all_words(spark, d):
    return search.bm25(A.documents(spark, d), "thing and", "doc_id", ["text"]).select("doc", F.round("score", 6).alias("score"))


@query(_bm25_sql(["ention", "chung"], "d0.tf > 0 OR d1.tf > 0"))
def fts_any_word(spark, d):
    return search.bm25(A.documents(spark, d), "ention OR chung", "doc_id", ["text"]).select("doc", F.round("score", 6).alias("score"))


@query(_bm25_sql(["the"], "d0.tf > 0 AND s.doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'of')"))
def fts_without(spark, d):
    return search.bm25(A.documents(spark, d), "the NOT of", "doc_id", ["text"]).select("doc", F.round("score", 6).alias("score"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t <> ''), ' ') || ' ', ' of the ')""")
def fts_phrase(spark, d):
    return search.matching(A.documents(spark, d), '"of the"', ["text"]).select("doc_id")


@query(r"""SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: starts_with(t, 'entionth'))) > 0""")
def fts_prefix(spark, d):
    return search.matching(A.documents(spark, d), "entionth*", ["text"]).select("doc_id")


@query(r"""SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(strip_accents(lower(source)), '[^\p{L}\p{N}]+'), 'src3') AND list_contains(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), 'the')""")
def fts_column(spark, d):
    return search.matching(A.documents(spark, d), "source: src3 AND text: the", ["text", "source"]).select("doc_id")


_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT doc_id FROM documents WHERE {_ASCII.format('text')} LIKE '%license, ver%' OR {_ASCII.format('source')} LIKE '%license, ver%' ORDER BY doc_id LIMIT 20")
def catalog_fallback(spark, d):
    """A comma is no part of a query, so this one is looked for as it is."""
    return search.search_catalog(A.documents(spark, d), "LICENSE, ver", "doc_id", ["text", "source"], ["text", "source"], 20).select("doc_id")


@query(_bm25_sql(["thing", "shand"], "d0.tf > 0 AND d1.tf > 0 AND s.doc_id % 7 <> 0").replace("shand", "and") + " ORDER BY score, doc LIMIT 15")
def fts_best_live(spark, d):
    """The best live documents; deleted ones count for the statistics."""
    docs = A.documents(spark, d).select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, F.current_timestamp()).alias("deleted_at"))
    return search.search_local(docs, "thing and", "doc_id", ["text"], 15, F.col("deleted_at").isNull()).select(F.col("doc_id").alias("doc"), F.round("score", 6).alias("score"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(CASE WHEN doc_id % 3 = 0 THEN source || ' new' ELSE text END)), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents WHERE doc_id % 5 <> 0) SELECT doc_id AS doc, len(w) AS terms, len(list_distinct(w)) AS different FROM t WHERE len(w) > 0""".replace("\\\\", "\\"))
def index_upkeep(spark, d):
    """An index in which a third of the documents are changed and a fifth removed."""
    docs = A.documents(spark, d).select("doc_id", "text", "source")
    changed = docs.where("doc_id % 3 = 0 and doc_id % 5 <> 0").select("doc_id", F.concat("source", F.lit(" new")).alias("text"))
    index = search.maintain_postings(search.postings(docs, "doc_id", ["text"]), changed, docs.where("doc_id % 5 = 0"), "doc_id", ["text"])
    return index.groupBy("doc").agg(F.count("*").alias("terms"), F.countDistinct("term").alias("different"))


# -- linkage -------------------------------------------------------------------------------------------------


def _entries(spark, d):
    """All parts as bibliography entries; half of them name an author."""
    b = A.table(spark, d, "part")
    return b.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" "), "p_type").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "Lovelace").otherwise("").alias("author"), (F.lit(1970) + F.col("p_size")).cast("string").alias("year"))


def _candidates(spark, d):
    b = A.table(spark, d, "part")
    return b.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" "), "p_type").alias("title"), (F.lit(1970) + F.col("p_size")).cast("string").alias("year"), F.array(F.when(F.col("p_partkey") % 3 == 0, "Ada Lovelace").otherwise("Grace Hopper")).alias("authors"))


_NORM = "lower(regexp_replace(p_name || ' ' || p_type, '[^\\p{L}\\p{N}]', '', 'g'))"
#: All parts against all parts, by title classes: parts of one title have the same prefix with any other.
_MATCH = f"""WITH x AS (SELECT p_partkey AS id, {_NORM} AS t, CAST(1970 + p_size AS VARCHAR) AS year, p_partkey % 2 = 0 AS named, p_partkey % 3 = 0 AS lovelace FROM part),
e AS (SELECT DISTINCT t, year, named FROM x), c AS (SELECT t AS ct, year AS c_year, lovelace, min(id) AS c_id FROM x GROUP BY ALL),
p AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(t), length(ct)) + 1), lambda i: t[i] <> ct[i])) - 1, least(length(t), length(ct))) AS prefix FROM (SELECT DISTINCT e.t, c.ct FROM (SELECT DISTINCT t FROM e) e, (SELECT DISTINCT ct FROM c) c WHERE left(t, 10) = left(ct, 10) AND length(t) >= 10 AND length(ct) >= 10)),
s AS (SELECT e.*, c.*, prefix, prefix >= 15 OR (prefix >= 10 AND prefix >= 0.8 * length(t)) AS close, NOT named OR lovelace AS author_ok FROM p JOIN e USING (t) JOIN c USING (ct))"""


@query(f"""{_MATCH}, r AS (SELECT *, CAST(prefix + CASE WHEN close AND year = c_year THEN 10 ELSE 0 END + CASE WHEN close AND author_ok THEN 15 ELSE 0 END AS INTEGER) AS score FROM s),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY t, year, named ORDER BY score DESC, c_id) = 1) SELECT CAST(x.id AS VARCHAR) AS key, c_id, score FROM x JOIN b USING (t, year, named) WHERE (score >= 20 AND author_ok) OR score >= 35""")
def fuzzy_best(spark, d):
    return linkage.best_match(_entries(spark, d), _candidates(spark, d)).select("key", "c_id", F.col("score").cast("int").alias("score"))


@query(f"{_MATCH}, b AS (SELECT t, year, named, min(c_id) AS c_id FROM s WHERE close AND author_ok GROUP BY ALL) SELECT CAST(x.id AS VARCHAR) AS key, c_id FROM x JOIN b USING (t, year, named)")
def fuzzy_first(spark, d):
    return linkage.first_match(_entries(spark, d), _candidates(spark, d)).select("key", "c_id")


@query(f"""WITH x AS (SELECT p_partkey AS id, {_NORM} AS t FROM part), c AS (SELECT t AS ct, min(id) AS c_id FROM x WHERE length(t) > 0 GROUP BY t), b AS (SELECT t, min(c_id) AS c_id FROM (SELECT DISTINCT t FROM x WHERE length(t) > 0) JOIN c ON left(t, least(20, length(t), length(ct))) = left(ct, least(20, length(t), length(ct))) GROUP BY t) SELECT CAST(id AS VARCHAR) AS key, c_id FROM x JOIN b USING (t)""")
def book_prefix(spark, d):
    return linkage.book_match(_entries(spark, d), _candidates(spark, d)).select("key", "c_id")


def _bib(spark, d):
    p = A.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("pos"), F.when(k % 50 == 0, F.concat(F.lit("9bad"), k.cast("string"))).when(k % 51 == 0, F.concat(F.lit("x="), k.cast("string"))).otherwise(F.concat(F.lit("key"), k.cast("string"))).alias("key"), F.when(k % 33 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("author"), F.lit("2001").alias("year"), F.when(k % 3 == 0, F.concat(F.lit("10.1/X"), (k % 100).cast("string"))).alias("doi"), F.when(k % 5 == 0, F.concat(F.lit("2001."), (k % 77).cast("string"))).alias("eprint"))


_BIB = "bib AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 50 = 0 THEN '9bad' || p_partkey WHEN p_partkey % 51 = 0 THEN 'x=' || p_partkey ELSE 'key' || p_partkey END AS key, CASE WHEN p_partkey % 33 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN '10.1/X' || (p_partkey % 100) END AS doi, CASE WHEN p_partkey % 5 = 0 THEN '2001.' || (p_partkey % 77) END AS eprint FROM part)"
_REPORT = f"""WITH {_BIB}, dup AS (SELECT * FROM (SELECT key, first_value(key) OVER (PARTITION BY lower(doi) ORDER BY pos) AS kept_key, row_number() OVER (PARTITION BY lower(doi) ORDER BY pos) AS n FROM bib WHERE doi IS NOT NULL) WHERE n > 1 UNION ALL SELECT * FROM (SELECT key, first_value(key) OVER (PARTITION BY eprint ORDER BY pos), row_number() OVER (PARTITION BY eprint ORDER BY pos) AS n FROM bib WHERE eprint IS NOT NULL) WHERE n > 1),
report AS (SELECT 'malformed' AS kind, key, NULL AS kept_key FROM bib WHERE contains(key, '=') OR regexp_matches(key, '^[0-9]') OR title IS NULL UNION ALL SELECT 'duplicate', key, kept_key FROM dup UNION ALL SELECT 'orphan', key, NULL FROM bib WHERE pos % 2 = 0)"""


@query(f"{_REPORT} SELECT kind, key, kept_key FROM report")
def clean_report(spark, d):
    bib = _bib(spark, d)
    return linkage.clean_report(bib, bib.where("pos % 2 <> 0").select("key"))


@query(f"{_REPORT} SELECT DISTINCT key FROM report WHERE kind <> 'orphan'")
def removable_keys(spark, d):
    bib = _bib(spark, d)
    return linkage.removable_keys(linkage.clean_report(bib, bib.where("pos % 2 <> 0").select("key")))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n FROM pages")
def marker_counts(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.occurrences(F.col("html"), "<p>").alias("n"))
