"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the files of public tokenizers are, unless their package or a parameter says otherwise.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ModuleNotFoundError:
        return os.path.join(TOKENIZERS, name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.decontaminate import decontaminate
    from folioscope.llm.text import doc_input

    out = decontaminate(doc_input(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.text import doc_input
    from folioscope.llm.tokens import count_tokens

    out = count_tokens(doc_input(read(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), 5, 50)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.simhash import near_duplicates

    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import quality

    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", F.col("junk").alias("junk_score"), F.col("toxic").alias("toxic_score"), (F.col("junk") >= 0.5).alias("is_junk"), (F.col("toxic") >= 0.5).alias("is_toxic"), "keep")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.warc import read_packages, write_packages

    packages = write_packages(read(spark, sf_dir, "pages"))
    return read_packages(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import langid
    from folioscope.llm.text import doc_input

    docs = read(spark, sf_dir, "documents")
    training = docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    model = langid.fit(training, langid.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    return langid.predict(doc_input(docs), model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.phrases import dedup_phrases

    return dedup_phrases(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.suffixes import dedup_substrings

    return dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm.mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, ns WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw) dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= 1000
"""

OP10_SQL = r"""
WITH base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS tag FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3] AS BIGINT) AS wt, 2 * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER lo, 0) AS capped, sum(wt) OVER () - coalesce(sum(wt) OVER lo, 0) AS open_w, sum(source_size) OVER () AS words, CAST(cap AS DOUBLE) / wt AS r FROM w
      WINDOW lo AS (ORDER BY CAST(cap AS DOUBLE) / wt, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(words AS DOUBLE) * 1.5::DOUBLE - CAST(capped AS DOUBLE)) / CAST(open_w AS DOUBLE) AS lv FROM o),
lv AS (SELECT *, first_value(CASE WHEN wt * lv <= cap THEN lv END IGNORE NULLS) OVER (ORDER BY r, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM l),
t AS (SELECT source, source_size, coalesce(wt * level, CAST(cap AS DOUBLE)) AS target FROM lv),
q AS (SELECT base.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY base.source ORDER BY tag, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent FROM base JOIN t ON base.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, c.copy, CASE WHEN target > 0 THEN CAST(sent + c.copy * source_size AS DOUBLE) / target ELSE 0 END AS finish FROM q, (VALUES (0), (1)) c(copy)),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, tag, doc_id, source, size, copy ROWS UNBOUNDED PRECEDING) AS used, (SELECT floor(sum(source_size) * 1.5) FROM s) AS goal FROM p)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN used <= goal THEN size ELSE 0 END) AS BIGINT) AS taken FROM u GROUP BY doc_id, source, size, source_size, target
"""

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_exact_top_k, op4_simhash_dedup, op5_quality, op6_warc, op7_language, op8_phrase_dedup, op9_suffix_dedup, op10_mix_sources)}
ORACLES = {"op1_decontaminate": OP1_SQL, "op3_exact_top_k": OP3_SQL, "op6_warc": OP6_SQL, "op10_mix_sources": OP10_SQL}
