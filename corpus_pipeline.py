"""A training corpus from raw documents: classify, deduplicate, decontaminate, mask secrets, encode.

Each stage works on all rows that the one before it kept.  Stages take
(spark, docs, sf_dir); all but the last return the columns of documents.  Each frees
what the driver holds of the one before.

Defined results, in every stage: null texts count as empty and null ids are ids like
any other; rows are kept and dropped each by itself, whatever ids they share, and of
equal rows one stays; texts are taken whole; a score equal to its limit is kept;
columns that aren't those of documents pass through all stages but the last; an empty
table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontaminate, quality_model, secret_scan, sentencepieces, simhash
from tessel.llm.common import checkpoint_folder, table, tidy
from tessel.llm.queries import VOCABULARY
from tessel.sources.files import Files

#: Likelihood of good quality below which a document goes.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier doesn't reject; it learns from the labelled source documents."""
    weights = quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    tidy(spark)
    verdict = quality_model.keep(docs, weights, LEAST_QUALITY)
    return verdict.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that have 0.8 of their five-word shingles in common."""
    tidy(spark)
    return simhash.representatives(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    tidy(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), rowwise=True).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; every document stays, with its new length."""
    tidy(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    tidy(spark)
    return sentencepieces.encode(docs, sentencepieces.load(VOCABULARY)).withColumnRenamed("__id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The stages learn a model, hash with a function that DuckDB lacks and encode with a vocabulary, so SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again.

    With a ``folder`` of one's own all stages stay there, and a run that was
    stopped goes on after the last stage that was whole; without, a stage's rows
    go when the next one's are written.
    """
    docs, files = table(spark, sf_dir, "documents"), Files(spark)
    kept, folder = folder is not None, folder or f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        if not files.exists(f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before is not None and not kept:
            files.delete(before)
        before = path
    return docs
