"""Resumable ingest: each file of a folder is read once, whatever is interrupted.

The file source's checkpoint is the ledger of files that are done, and a batch and its entry in
the ledger are committed together, so nothing is taken twice or left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators import store
from folioscope.sources.markup import MARC, marc_fields
from folioscope.sources.payloads import SEARCH


def _run(rows: DataFrame, sink: str, ledger: str) -> StreamingQuery:
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ledger).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest_catalog(spark: SparkSession, folder: str, sink: str, ledger: str, files_at_a_time: int = 3) -> StreamingQuery:
    """MARCXML files, also gzipped, to a table of catalogue records."""
    raw = spark.readStream.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").option("maxFilesPerTrigger", files_at_a_time).schema(MARC).load(folder)
    return _run(marc_fields(raw), sink, ledger)


def ingest_payloads(spark: SparkSession, folder: str, source: str, sink: str, ledger: str) -> StreamingQuery:
    """Captured bodies of one search source to a table of records, with the file each came from."""
    files = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(folder)
    bodies = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("cache_key"), F.col("value").alias("body"))
    return _run(SEARCH[source](bodies), sink, ledger)


def ingest_dump(spark: SparkSession, folder: str, sink: str, ledger: str) -> StreamingQuery:
    """JSON lines of papers, also gzipped, to a table."""
    schema = "id string, title string, abstract string, year int, venue string, citation_count bigint, external_ids map<string,string>"
    return _run(spark.readStream.schema(schema).json(folder), sink, ledger)


def pending_files(listed: DataFrame, done: DataFrame) -> DataFrame:
    """Listed file names that no ledger row "file:<name>" marks as done."""
    return listed.join(store.keyed(done, "key", "file:", "filename").select("filename"), "filename", "left_anti")
