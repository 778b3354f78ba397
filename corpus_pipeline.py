"""The training-data pipeline: STAGES in order, each from the documents that the one before kept.

All stages but the last return the columns of documents. A stage's decisions hold for whole rows: rows that share an id and
differ in text are judged one by one, but for near-duplicates, where rows that share an id are one document.

Null and empty texts: the quality classifier scores them by its bias, language ID rejects them, the later stages keep them as
they are. Null ids are judged like others and are never near copies. Equal rows get the same decision; of rows tied as near
copies the least id stays. Very long texts are read whole. Empty tables give empty tables. Columns beside those of documents
go through unchanged whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datagrove.llm import language, near_duplicates, packing, quality, suffix_dedup
from datagrove.llm.common import table, written

#: An exact SQL twin would need the classifier's weights and the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _any_columns(stage):
    """stage, with the further columns of docs under names that meet none of its own, and put back afterwards."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"__further_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return call


@_any_columns
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").select(*docs.columns)


@_any_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with text whose language is settled; lang is declared evidence, source the host."""
    hashed = F.xxhash64(F.col("text").cast("string"), language.declared_language(F.col("lang")), F.col("source").cast("string"))
    evidence = language.from_documents(docs.select("doc_id", "text", "lang", "source")).withColumn("row", F.xxhash64("text", "declared", "host"))
    # A row is known by its id and a hash of what decides: rows of other ids never meet.
    rejected = language.identify(evidence).where("not kept").select(F.col("doc_id").alias("__rejected"), "row").distinct()
    found = docs.withColumn("__row", hashed).join(rejected, F.col("doc_id").cast("long").eqNullSafe(F.col("__rejected")) & (F.col("__row") == F.col("row")), "left_anti")
    return found.select(*docs.columns)


@_any_columns
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    found = near_duplicates.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti").select(*docs.columns)


@_any_columns
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes and more that an earlier document has; characters cut in half go too."""
    found = suffix_dedup.deduplicate(docs, as_text=True).withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows."""
    import public_tokenizers

    return packing.pack(packing.tokens(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
