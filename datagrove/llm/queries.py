"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, hamming, language, near_duplicates, packing, quality, scoring, suffix_dedup, token_files, vectors
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokens(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language, source) and pages (markup, address suffix, host) together; doc_id or page_id is null."""
    rows = language.from_documents(table(spark, sf_dir, "documents")).unionByName(language.from_pages(table(spark, sf_dir, "pages")))
    return language.identify(rows).select("doc_id", "page_id", "declared", "text_language", "language", "probability", "kept")


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 50, among all vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"), F.col("embedding").isNull().alias("none"))
    rows = rows.where("not none").select("id", "code")
    return hamming.top_k(rows, rows.where("id % 50 = 0"), 10)


def op8_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=2)


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_hamming_top_k": op7_hamming_top_k,
    "op8_vector_near_duplicates": op8_vector_near_duplicates,
    "op9_token_files": op9_token_files,
    "op10_minhash": op10_minhash,
}
ORACLE_SQL = {
    "op7_hamming_top_k": """
        WITH signs AS (SELECT vec_id, [coalesce(embedding[i] > 0, false) FOR i IN range(1, 65)] AS s FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        pairs AS (
            SELECT DISTINCT q.vec_id AS query_id, r.vec_id, CAST(list_sum([CAST(q.s[i] <> r.s[i] AS INT) FOR i IN range(1, 65)]) AS INT) AS distance
            FROM signs q, signs r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM pairs)
        SELECT query_id, vec_id, distance, rank FROM ranked WHERE rank <= 10
    """,
}
