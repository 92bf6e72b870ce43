"""Counts and choices over decoded tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytesift.functions.blocks import HEAD, entropy_bits


def class_counts(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def dead_percent(zero: Column, ff: Column, blocks: Column) -> Column:
    return (zero + ff) * 100.0 / F.greatest(blocks, F.lit(1))


def best_by(df: DataFrame, by: list[str], score: str, rank: str, value: str) -> DataFrame:
    """The value of the highest score in each group; of equal scores the lowest rank."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(F.col(score), -F.col(rank))).alias(value), F.max(score).alias(score))


def byte_entropy(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, entropy) of the first 4096 bytes of a binary column, row by row in Arrow batches: no row is cut into bytes and nothing is shuffled."""

    @F.pandas_udf("double")
    def bits(blobs: pd.Series) -> pd.Series:
        return blobs.map(entropy_bits)

    return df.select(key, bits(F.substring(F.coalesce(data, F.lit(b"")), 1, HEAD)).alias("entropy"))


def record_counters(manifest: DataFrame) -> DataFrame:
    """How many records were listed, resident, recovered from clusters, and found wiped."""
    return manifest.agg(
        F.count("*").alias("listed"),
        F.count_if(F.col("storage") == "resident").alias("resident"),
        F.count_if((F.col("storage") == "non-resident") & F.col("recovered").startswith("yes")).alias("targeted"),
        F.count_if(F.col("note").contains("TRIM")).alias("wiped"),
    )


def journal_counters(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_if(F.col("reason").contains("FILE_DELETE")).alias("deletes"))


def result_cards(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(card, n): for each card the rows of its table that meet its condition."""
    out = None
    for card, (df, keep) in tables.items():
        one = df.agg(F.count_if(keep).alias("n")).select(F.lit(card).alias("card"), "n")
        out = one if out is None else out.unionByName(one)
    return out
