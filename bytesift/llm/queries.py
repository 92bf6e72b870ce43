"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytesift.llm import licenses
from bytesift.llm.common import crc_bucket_col, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into few sequences of at most 2048 tokens."""
    from bytesift.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates found in every whole text."""
    from bytesift.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    from bytesift.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    from bytesift.llm.language import predict, train, training_rows

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(*training_rows(docs))
    held = (crc_bucket_col("doc_id", 3) == 1).alias("held_out")
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held, "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds a passage of."""
    from bytesift.llm.decontamination import leak_rows

    return leak_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_embedding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector."""
    from bytesift.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two thirds of them."""
    from bytesift.llm.toxicity import fit, score_toxicity, training_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*training_texts(docs, table(spark, sf_dir, "labels")))
    held = (crc_bucket_col("doc_id", 3) == 1).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held, "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    from bytesift.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token ids of every document to files and read them back."""
    from bytesift.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from six sevenths of them."""
    from bytesift.llm.katz import score_documents

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_bucket_col("doc_id", 7) != 2)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_join": op2_license_join,
    "op3_simhash_bktree": op3_simhash_bktree,
    "op4_language_gru": op4_language_gru,
    "op5_decontamination": op5_decontamination,
    "op6_embedding_passes": op6_embedding_passes,
    "op7_toxicity_compression": op7_toxicity_compression,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_katz_backoff": op10_katz_backoff,
}
ORACLES: dict[str, str] = {"op2_license_join": licenses.ORACLE}
