"""The entity store: claims, cache, identity, upserts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Identifiers, in the order in which a record is looked for; all five are unique.
PROBES, UNIQUE = ("doi", "arxiv_id", "isbn"), ("doi", "arxiv_id", "isbn", "s2_id", "openalex_id")
#: Fields that an update overwrites, and those it sets where it has a value.
OVERWRITTEN = ("title", "authors")
MERGED = ("year", "doi", "arxiv_id", "isbn", "journal", "booktitle", "publisher", "volume", "number", "pages", "abstract", "url", "pdf_url", "categories", "local_path")
TITLE_CHARS = 2000
#: Seconds that a search, a lookup and an unreferenced cache row last.
TTL_SEARCH, TTL_LOOKUP, EVICT_AFTER = 86_400, 7 * 86_400, 90 * 86_400


def latest_claims(claims: DataFrame, order: tuple[str, ...] = ("fetched_at", "seq")) -> DataFrame:
    """K2: one claim for each (paper, field, source), the last. max_by combines before the shuffle."""
    rest = [c for c in claims.columns if c not in ("paper_id", "field", "source")]
    return claims.groupBy("paper_id", "field", "source").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("paper_id", "field", "source", "r.*")


def claims_of(claims: DataFrame, paper_id: object, field: str) -> DataFrame:
    """P20: newest first."""
    return claims.where((F.col("paper_id") == F.lit(paper_id)) & (F.col("field") == field)).select("value", "source", "fetched_at").orderBy(F.desc("fetched_at"), "source")


def leading_integer(x: Column) -> Column:
    """The integer that a text begins with, 0 without one, as a lenient cast has it."""
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))


def largest_claim(claims: DataFrame, field: str) -> DataFrame:
    """A4: (paper_id, value), the largest claim as an integer."""
    return claims.where(F.col("field") == field).groupBy("paper_id").agg(F.max(leading_integer(F.col("value"))).alias("value"))


def cache_hits(cache: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Rows younger than the time to live."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("fetched_at") < ttl)


def cache_set(cache: DataFrame, new: DataFrame) -> DataFrame:
    """K4: a new row replaces that of its key."""
    return cache.join(new, "cache_key", "left_anti").unionByName(new)


def cache_insert_missing(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of keys that aren't there yet."""
    return cache.unionByName(new.join(cache, "cache_key", "left_anti"))


def evict(cache: DataFrame, references: list[DataFrame], now: Column, after: int = EVICT_AFTER) -> DataFrame:
    """What stays: rows that are young, or that any reference (cache_key) names."""
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    named = reduce(DataFrame.unionAll, [r.select("cache_key").where("cache_key is not null") for r in references]).distinct().withColumn("named", F.lit(True))
    return cache.join(named, "cache_key", "left").where((age <= after) | F.col("named")).drop("named")


def enrich(base: DataFrame, others: list[DataFrame], key: str, fields: list[str], empty_is_missing: bool = True) -> DataFrame:
    """Each field from the first table that has it, the base's own first."""
    out, picks = base, {f: [F.nullif(F.col(f), F.lit("")) if empty_is_missing else F.col(f)] for f in fields}
    for n, other in enumerate(others):
        own = [f for f in fields if f in other.columns]
        out = out.join(other.select(key, *[F.col(f).alias(f"_{n}_{f}") for f in own]), key, "left")
        for f in own:
            picks[f].append(F.nullif(F.col(f"_{n}_{f}"), F.lit("")) if empty_is_missing else F.col(f"_{n}_{f}"))
    return out.select(*[F.coalesce(*picks[c]).alias(c) if c in picks else F.col(c) for c in base.columns])


def find(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The rows with a key; the comparison goes into the scan."""
    return rows.where(F.col(column) == F.lit(value))


def keyed(rows: DataFrame, column: str, prefix: str, name: str) -> DataFrame:
    """The rows whose key has a prefix, and what comes after it."""
    return rows.where(F.col(column).startswith(prefix)).withColumn(name, F.substring(column, len(prefix) + 1, (1 << 31) - 1))


def marked(rows: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    """Rows, each with whether any other row has its key. Nothing is repeated, however many have."""
    there = others.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_there", F.lit(True))
    return rows.join(there, key, "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_there")


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the place of each different value in the order of all. Values are dealt out by
    range and numbered where they lie, so no task has them all; how many each range has is the only
    thing that is summed up in one place."""
    from folioscope.operators.graph import checkpoint_folder

    checkpoint_folder(rows.sparkSession)
    dealt = rows.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return dealt.join(F.broadcast(before), "_range").select(column, (F.col("_before") + own).alias(name))


def set_local_path(papers: DataFrame, paths: DataFrame) -> DataFrame:
    """K5: (id, local_path) replace or, where null, clear."""
    p = paths.select("id", F.col("local_path").alias("_p"), F.lit(True).alias("_set"))
    return papers.join(p, "id", "left").withColumn("local_path", F.when(F.col("_set"), F.col("_p")).otherwise(F.col("local_path"))).drop("_p", "_set")


def path_differences(papers: DataFrame, folders: DataFrame) -> DataFrame:
    """(kind, path): paths of live papers without a folder, and folders without a paper."""
    have = papers.where("deleted_at is null and local_path is not null").select(F.col("local_path").alias("path"))
    gone, extra = have.join(folders, "path", "left_anti"), folders.join(have, "path", "left_anti")
    return gone.select(F.lit("missing").alias("kind"), "path").unionAll(extra.select(F.lit("untracked"), "path"))


def statistics(papers: DataFrame, edges: DataFrame, cache: DataFrame) -> DataFrame:
    """A1: one row of counts."""
    return papers.where("deleted_at is null").agg(F.count("*").alias("papers")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(cache.agg(F.count("*").alias("cached"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")))


def multi_source(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """The sources of papers that have more than one, with the cached body or an empty one. A
    count beside the rows replaces the look at each paper."""
    many = sources.groupBy("paper_id").agg(F.count("*").alias("n")).where("n > 1").select("paper_id")
    return sources.join(many, "paper_id", "left_semi").join(cache.select("cache_key", "body"), "cache_key", "left").select("paper_id", "source", F.coalesce("body", F.lit("")).alias("body"))


def paginate(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page with has_more. One row more than the page is fetched, which tells."""
    page = rows.orderBy(*order).offset(offset).limit(size + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return page.withColumn("has_more", F.count("*").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


# -- upsert ---------------------------------------------------------------------------------------


def components(records: DataFrame, key: str = "seq", ids: tuple[str, ...] = UNIQUE) -> DataFrame:
    """records with component: the least seq that shared identifiers lead to. Each identifier hooks its
    records to the least of them; stars of those links settle in few rounds, however long a chain is."""
    from folioscope.operators import graph

    links = records.select(F.col(key).alias("a"), F.explode(F.array_compact(F.array(*[F.when(F.col(i).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(i))) for i in ids]))).alias("i"))
    hooks = links.join(links.groupBy("i").agg(F.min("a").alias("b")), "i").select("a", "b")
    roots = graph.components(hooks).select(F.col("node").alias(key), "root")
    return records.join(roots, key, "left").withColumn("component", F.coalesce("root", F.col(key))).drop("root")


def fold(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """Upserts records in order: (stored rows, rejected records).

    A record is looked for by doi, then arXiv id, then ISBN among live rows. Found: title and authors
    are overwritten, most fields set where the record has a value, s2_id and openalex_id kept.
    An update or insert that repeats an id of another row, also of a deleted one, is rejected.
    An id is of one row at most, so a table by id finds it at once."""
    stored: list[dict] = []
    rejected: list[dict] = []
    by_id: dict[str, dict] = {u: {} for u in UNIQUE}
    for r in rows:
        new = dict(r)
        new["title"] = (r.get("title") or "")[:TITLE_CHARS]
        year = (r.get("year") or "").strip()
        new["year"] = year if len(year) == 4 and year.isascii() and year.isdigit() else None
        new["entry_type"] = (r.get("entry_type") or "").lower() or None
        found = (by_id[p].get(new[p]) for p in PROBES if new.get(p) is not None)
        own = next((s for s in found if s is not None and s.get("deleted_at") is None), None)
        if own is None:
            result = new
        else:
            result = dict(own)
            for f in OVERWRITTEN:
                result[f] = new.get(f)
            for f in (*MERGED, "citation_count"):
                if new.get(f) is not None:
                    result[f] = new[f]
            for f in ("s2_id", "openalex_id"):
                if result.get(f) is None:
                    result[f] = new.get(f)
        if any(by_id[u].get(result[u], own) is not own for u in UNIQUE if result.get(u) is not None):
            rejected.append(r)
            continue
        if own is None:
            stored.append(own := result)
        else:
            for u in UNIQUE:
                by_id[u].pop(own.get(u), None)
            own.update(result)
        for u in UNIQUE:
            if own.get(u) is not None:
                by_id[u][own[u]] = own
    return stored, rejected


def upsert(records: DataFrame) -> DataFrame:
    """K1: records (seq and any of the paper fields) folded in order of seq; rows get `rejected`.

    Records that share no identifier, not even through others, can't touch each other, so each
    component is folded on its own; its size bounds the work of a task."""
    linked = components(records)
    schema = T.StructType([*records.schema.fields, T.StructField("rejected", T.BooleanType())])
    names = records.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in r.items()} for r in pdf.sort_values("seq")[names].astype(object).to_dict("records")]
        stored, rejected = fold(rows)
        return pd.DataFrame([{**{n: s.get(n) for n in names}, "rejected": flag} for flag, part in ((False, stored), (True, rejected)) for s in part], columns=[*names, "rejected"])

    return linked.groupBy("component").applyInPandas(run, schema)


def claims_from(records: DataFrame, source: str, fields: tuple[str, ...]) -> DataFrame:
    """The raw values of records as claims of a source; nulls make none."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return records.select(F.col("id").alias("paper_id"), F.explode(pairs).alias("p")).select("paper_id", "p.*", F.lit(source).alias("source")).where("value is not null")


def layered(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """Settings by key; the last layer that has a value wins."""
    rows = reduce(DataFrame.unionAll, [d.select(key, value, F.lit(n).alias("_n")) for n, d in enumerate(layers)]).where(F.col(value).isNotNull())
    return rows.groupBy(key).agg(F.max_by(value, "_n").alias(value))


