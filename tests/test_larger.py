"""What only larger or odder tables show: work in proportion to the rows, and keys of more digits."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import linkage
from folioscope.plans import queries, source_queries
from folioscope.sources import markup


@pytest.fixture
def plain(spark):
    """Plans as they are made, so that their metrics can be read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def joined(df):
    """The rows of df, and the most that a join in its plan made."""
    rows, most = df.collect(), 0
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        metric = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and metric.isDefined():
            most = max(most, metric.get().value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def same_as_sql(spark, folder, name, **tables):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        got = queries.QUERIES[name](spark, str(folder))
        want = c.execute(queries.ORACLES[name])
        columns = [x[0] for x in want.description]
        return sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))), sorted(map(repr, want.fetchall()))


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def parts(*keys):
    return [(k, f"red bolt {k % 3}", "Brand#1", "SMALL", k % 50, 900.0) for k in keys], PART


# -- linkage ------------------------------------------------------------------------------------------------

_ENTRY, _CANDIDATE = "key string, title string, author string, year string", "id long, title string, year string, authors array<string>, pos int"


def _prefix(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _titles(rng, n):
    """Titles that share beginnings of many lengths."""
    return ["".join(rng.choice("ab") if i in (3, 9, 11, 13, 14, 15, 17, 19, 22) else "x" for i in range(rng.choice((4, 9, 10, 12, 14, 16, 18, 20, 25)))) for _ in range(n)]


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    entries = [(f"e{i}", t, rng.choice(("Lovelace", "Li", "", None)), rng.choice(("2000", "2001", "", None))) for i, t in enumerate(_titles(rng, 60))]
    entries += [("none", None, "Li", "2000"), ("empty", "", "Li", "2000"), ("e0", "xxxbxxxxxaxxxx", "Li", "2001")]
    places = rng.sample(range(1000), 60)
    found = [(i, t, rng.choice(("2000", "2001", None)), rng.choice((["Ada Lovelace"], ["Ming Li"], ["Grace Hopper"], [], None)), p) for (i, t), p in zip(enumerate(_titles(rng, 60)), places)]
    return entries, [*found, (99, None, "2000", ["Ming Li"], 2000)]


def _by_hand(entries, found, kind):
    """The rules of the three matches, pair by pair."""
    out = {}
    for key, t, author, year in entries:
        for i, ct, c_year, authors, pos in found:
            if not t or not ct:
                continue
            n, names = _prefix(t, ct), None if authors is None else " ".join(authors).lower()
            own = (author or "").lower()
            ok = True if not own else None if names is None else own[:4] in names if len(own) >= 4 else f" {own} " in f" {names} "
            close = n >= 15 or (n >= 10 and n >= 0.8 * len(t))
            score = n + 10 * bool(close and year and year == c_year) + 15 * bool(close and ok)
            if kind == "book" and n >= min(20, len(t), len(ct)):
                out[key] = min(out.get(key, (1e9,)), (pos, i))
            if kind == "first" and close and ok:
                out[key] = min(out.get(key, (1e9,)), (pos, i))
            if kind == "best" and n >= 10:
                out[key] = min(out.get(key, (1e9,)), (-score, pos, i, bool(ok)))
    if kind == "best":
        return {k: (b[2], -b[0]) for k, b in out.items() if (-b[0] >= 20 and b[3]) or -b[0] >= 35}
    return {k: b[1] for k, b in out.items()}


def test_matches_are_those_of_all_pairs(spark, records):
    entries, found = spark.createDataFrame(records[0], _ENTRY), spark.createDataFrame(records[1], _CANDIDATE)
    assert {r.key: (r.c_id, r.score) for r in linkage.best_match(entries, found).collect()} == _by_hand(*records, "best")
    assert {r.key: r.c_id for r in linkage.first_match(entries, found).collect()} == _by_hand(*records, "first")
    assert {r.key: r.c_id for r in linkage.book_match(entries, found).collect()} == _by_hand(*records, "book")


def _alike(spark, n, one=False):
    """Entries and candidates that share a long beginning, n of each; of one title, or of as many."""
    title = F.lit("the same beginning of all") if one else F.concat(F.lit("the same beginning of all "), F.col("id").cast("string"))
    rows = spark.range(n).select(F.col("id").cast("string").alias("key"), "id", title.alias("title"), F.lit("Lovelace").alias("author"), F.lit("2000").alias("year"), F.array(F.lit("Ada Lovelace")).alias("authors"), F.col("id").cast("int").alias("pos"))
    return rows.select("key", "title", "author", "year"), rows.select("id", "title", "year", "authors", "pos")


@pytest.mark.parametrize("one", [False, True])
@pytest.mark.parametrize("match", ["best_match", "first_match", "book_match"])
def test_matches_make_no_pairs(plain, match, one):
    rows, most = joined(getattr(linkage, match)(*_alike(plain, 400, one)))
    assert len(rows) == 400 and most <= 400 * 40
    assert one or match != "best_match" or all(r.key == str(r.c_id) for r in rows)


def test_verification_makes_no_pairs(plain):
    entries, found = _alike(plain, 400)
    entries = entries.select("key", F.col("key").cast("int").alias("pos"), F.when(F.col("key") % 2 == 0, "book").otherwise("article").alias("entry_type"), "title", "author", "year", F.lit("").alias("doi"), F.lit("").alias("eprint"))
    found = found.withColumn("doi", F.lit(None).cast("string"))
    refs = found.select(F.col("id").cast("string").alias("ref"), "title", "year", "authors")
    rows, most = joined(linkage.verify(entries, refs, refs, found.limit(0), found, found))
    assert {(r.status, r.source) for r in rows} == {("ok", "SemanticScholar"), ("mismatch", "SemanticScholar")} and most <= 400 * 40
    tally, most = joined(linkage.tally(linkage.verify(entries, refs, refs, found.limit(0), found, found)))
    assert tally[0].ok + tally[0].mismatch == 400 and most <= 400 * 40


@pytest.mark.parametrize("name", ["verified_entries", "status_tallies", "stored_rows", "fuzzy_best", "fuzzy_first", "book_prefix"])
def test_keys_of_six_digits(spark, tmp_path, name):
    got, want = same_as_sql(spark, tmp_path, name, part=parts(7, 100001, 100002, 100003, 100004, 100006, 100009, 100015))
    assert got == want


# -- files ----------------------------------------------------------------------------------------------------


class Read(str):
    """Counts the characters that slices of it copy."""

    copied = 0

    def __getitem__(self, at):
        out = super().__getitem__(at)
        Read.copied += len(out)
        return out


def test_a_long_file_is_read_once():
    text = Read("".join(f"@article{{k{i}, title={{T}}}}\n" for i in range(2000)))
    Read.copied = 0
    assert len(list(markup.bib_entries(text))) == 2000
    assert Read.copied <= 10 * len(text)


def test_marks_are_in_the_three_lines_before():
    rng = random.Random(1)
    pieces = ["@a{k, t={x}}", "@b{j, t={% lit:skip}}", markup.SKIP_MARK, "x", "\n", "\n", "\r\n", "\r", " ", "\x0b", " "]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        kept = [start for *_, start, _ in markup.bib_entries(text)]
        heads = [m for m in range(len(text)) if text.startswith(("@a{", "@b{"), m)]
        assert kept == [m for m in heads if not any(markup.SKIP_MARK in line for line in text[:m].splitlines()[-3:])], repr(text)


def test_marc_files_are_written_a_record_at_a_time(spark, data, monkeypatch):
    monkeypatch.setattr(source_queries, "_MARC_RECORDS", 30)
    where = source_queries._marc_files(spark, data)
    n = spark.read.parquet(f"{data}/part.parquet").count()
    lines = spark.read.text(where).withColumn("file", F.input_file_name())
    assert lines.count() == n + 2 * -(-n // 30)
    files = spark.read.text(where, wholetext=True).collect()
    assert len(files) == -(-n // 30)
    for f in files:
        assert f.value.startswith("<collection ") and f.value.endswith("</record>\n</collection>\n")
        assert f.value.count("<collection ") == f.value.count("</collection>") == 1
    assert markup.marc_records(spark, where).count() == spark.read.parquet(f"{data}/part.parquet").where("p_partkey % 5 <> 0").count()


# -- graph ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chain", [[1, 2], [1, 5, 77], [1, 2, 3, 4, 77]])
def test_path_length(spark, tmp_path, chain):
    """Without a path the length is null, as in the SQL."""
    lines = [(1, p, n) for n, p in enumerate(chain)] + [(2, 77, 0), (2, 78, 1)]
    got, want = same_as_sql(spark, tmp_path, "graph_path_length", lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int"))
    assert got == want
