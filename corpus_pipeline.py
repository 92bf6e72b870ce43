"""From raw documents to packed sequences: toxicity, language, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a
DataFrame with the columns of documents; the last one returns the packed pieces. ``run`` writes
each stage as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesift.llm import decontamination, language, packing, simhash, toxicity
from bytesift.llm.common import table
from bytesift.storage import materialise

#: A document whose language is less sure than this is rejected.
LANGUAGE_SCORE = 0.4


def _kept(marked: DataFrame, columns: list[str], keep) -> DataFrame:
    return marked.where(keep).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as a struct beside its text, so no column's name clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


# What holds for all stages: extra columns pass through whatever their names; a null text counts as empty; rows that
# repeat are judged each; whole texts are judged, however long; an empty table gives an empty one.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labels of sf_dir. Without labels, and for empty texts, nothing is toxic."""
    model = toxicity.fit(*toxicity.training_texts(docs, table(spark, sf_dir, "labels")))
    return _kept(toxicity.score_toxicity(_whole(docs), model), docs.columns, F.col("predicted") == 0)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or whose language isn't sure, go. With no language to learn all go."""
    net = language.train(*language.training_rows(docs))
    return _kept(language.predict(_whole(docs), net), docs.columns, (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest doc_id stays, null ids last; of rows with that same id, one. Texts without words are one group."""
    rows = _whole(docs).select("row", "text", F.col("row.doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("number"))
    rows = materialise(rows, "rows")
    keep = simhash.first_of_groups(rows.select(F.col("number").alias("row"), "doc_id", "text")).select(F.col("row").alias("first"))
    return _kept(rows.join(keep, F.col("number") == F.col("first"), "left_semi"), docs.columns, F.lit(True))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that matches a benchmark item go. Null items, and an empty benchmark, match nothing."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequence and offset; an empty text is one piece of the end id."""
    return packing.pack_documents(docs, cached=150_000)  # workers still hold what earlier stages left


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained models and SimHash can't be put in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
