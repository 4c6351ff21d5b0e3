"""The driver's tables read as bibliographic ones, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, venue, year, citation_count, kind) of part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), (F.lit(1970) + F.col("p_size")).alias("year"), F.floor("p_retailprice").alias("citation_count"), F.col("p_type").alias("kind"))


PAPERS = "papers AS (SELECT p_partkey AS id, p_name AS title, p_brand AS venue, 1970 + p_size AS year, CAST(floor(p_retailprice) AS BIGINT) AS citation_count, p_type AS kind FROM part)"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts on successive lines of an order, distinct."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = lines.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    pairs = lines.join(nxt, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n")))
    return pairs.where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst").distinct()


CITATIONS = "citations AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, field, source, value, fetched_at, seq) of events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.get_json_object("props", "$.k").alias("field"), F.col("event_type").alias("source"), F.round("value", 1).cast("string").alias("value"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"))


RAW_CLAIMS = "raw_claims AS (SELECT user_id AS paper_id, json_extract_string(props, '$.k') AS field, event_type AS source, CAST(round(value, 1) AS VARCHAR) AS value, ts AS fetched_at, event_id AS seq FROM events)"
CLAIMS = RAW_CLAIMS + ", claims AS (SELECT paper_id, field, source, value, fetched_at FROM raw_claims QUALIFY row_number() OVER (PARTITION BY paper_id, field, source ORDER BY fetched_at DESC, seq DESC) = 1)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
