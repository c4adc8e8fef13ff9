"""A corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritab.llm import crf, dedup, jaccard, packing, pii
from veritab.session import remove_paths, removed_after, scratch_path

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of texts that travel to a Python worker at once. By default a batch ends after 10,000 rows only, however
#: long these are; the size of a batch changes no result.
BATCH_BYTES = 4 << 20


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with batches of texts that are bounded by their size, unless the session has its own bound."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labelled ones, scores at least 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return crf.good_documents(docs, crf.fit_on(docs, labels))


@bounded
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the smallest id stays, of those without any id one row."""
    return dedup.without_copies(docs, keep_unnamed=True)


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that shingle similarity links the smallest id stays."""
    return jaccard.one_of_each(docs)


@bounded
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced; n_chars follows the text."""
    clean = pii.sanitize(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written for itself goes once its result is written, and that once the next one is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark)
        with removed_after(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
            schema = kept.schema
        if last is not None:
            remove_paths(spark, [last])
        docs, last = spark.read.schema(schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
