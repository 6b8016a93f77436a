"""A corpus pipeline of four stages: quality classifier, SimHash near-duplicates, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landloom.llm import packing, quality, secrets, simhash
from landloom.session import forget, read, scratch_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those here that have labels, doesn't reject.

    Null and empty texts have the score of a text without features; repeated rows fare alike; without labels or documents nothing is rejected, as every score is 0.5. All columns stay.
    """
    return quality.accept(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (shingles of five words, similarity 0.8).

    Null and empty texts are copies of each other; a row that repeats stays once; rows without a doc_id stay; an empty table stays empty. All columns stay.
    """
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark. Null and empty texts, repeated rows and other columns stay; n_chars follows the text."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its bucket, batch and slot. Null texts have length 0; repeated rows each have a slot; an empty table gives none."""
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("SimHash near-dedup", dedup), ("secret scans", redact), ("packing", pack)]

#: The classifier and the dynamic programme aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; what a stage read is deleted once it is done."""
    docs, behind = read(spark, sf_dir, "documents"), None
    path = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{path}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if behind:
            forget(spark, behind)
        docs, behind = spark.read.parquet(out), out
    return docs
