"""The corpus pipeline: five stages from raw documents to a training mixture.

Each stage takes all that its predecessor kept and is written as Parquet before the next one reads it. Stages one to four
return the columns of documents; the last adds domain, n_words and epochs.

* language_id drops documents without letters (null and empty texts among them) and those whose best language has a
  probability under ``MIN_SCORE``.
* line_dedup deletes repeated runs of lines and drops documents of which nothing stays.
* near_dedup keeps one document of each component of texts whose sets of five-word shingles have a Jaccard similarity of
  0.8 or more, found by long SimHash fingerprints (``longhash``).
* decontaminate drops documents that hold part of a benchmark item.
* mix_sources selects documents, and how often each is read, by target weights.

Nulls, ties, repeated rows, very long texts and clashing columns are those of the operators. An empty documents table gives
an empty result. Rows with null ids are kept like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from streetflow.llm import decontaminate, langid, linededup, longhash, mixing, scratch, simhash
from streetflow.llm.names import prefix

MIN_SCORE = 0.3
#: Rows that a Python worker gets at once. Spark's 10,000 whole texts, and as many pairs of texts, take hundreds of MB.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``; lower settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    model = langid.fit(docs)
    p = prefix(docs)
    told = langid.predict(docs, model, out=f"{p}language")
    return told.where((F.col(f"{p}language.lang_pred") != "und") & (F.col(f"{p}language.score") >= MIN_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return linededup.apply(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return simhash.keep_one(docs, classes=longhash.classes)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.apply(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("mix_sources", mix_sources),
]

#: Fingerprints and language models have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return docs
