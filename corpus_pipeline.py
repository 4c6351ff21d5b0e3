"""From raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, mixing, quality, simhash, suffixes
from folioscope.llm.storage import remove, shared_folder


def _beside(docs: DataFrame, fields: list[tuple[str, str]], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `work` keeps of docs, with all of their columns, also those that have the name of one of the
    fields that the operator adds."""
    names = {n for n, _ in fields}
    hidden = {c: f"_input_{i}" if c in names else c for i, c in enumerate(docs.columns)}
    kept = work(docs.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]))
    return kept.select(*[F.col(f"`{h}`").alias(c) for c, h in hidden.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Junk and toxic documents go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _beside(docs, quality.RESULT, lambda d: quality.classify(d, model).where("keep"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose sets of five-word shingles are 0.8 or more alike, pair by pair,
    one stays: that with the smallest id. The operator's wide fingerprints find the pairs; the narrow
    ones of op4 serve its query only, as pairs of that similarity differ in about 10 of 64 bits."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside strings of 200 bytes that occur again are cut out of the texts; a character
    that a cut splits goes with it. Null texts stay null."""
    out = suffixes.dedup_substrings(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("kept_text", _whole_characters("kept"))
    columns = [text.alias(c) if c == "text" else F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(F.col(f"rest.`{c}`")).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)


def _whole_characters(name: str):
    """The text of UTF-8 bytes, without the replacement characters that stand for broken ones."""
    return F.replace(F.make_valid_utf8(F.col(name).cast("string")), F.lit("\ufffd"), F.lit(""))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(docs, decontaminate.RESULT, lambda d: decontaminate.decontaminate(d, items).where("n_hit = 0"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how often and for how many words it takes each."""
    return mixing.mix_sources(docs).where("copies > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing_sources),
]

#: The classifier is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again. What
    a stage has read is removed once its result is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return docs
