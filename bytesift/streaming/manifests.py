"""Live figures while a recovery runs: manifests are read as a stream of files and their cards kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_manifest(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of CSV manifests as their files arrive; a file is read once."""
    return spark.readStream.schema(schema).option("header", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(folder)


def running_cards(rows: DataFrame, cards: dict[str, Column]) -> DataFrame:
    """(card, n): for each card the rows so far that meet its condition; the state has one row a card."""
    named = F.filter(F.array(*[F.when(keep, F.lit(card)) for card, keep in cards.items()]), lambda c: c.isNotNull())
    return rows.select(F.explode(named).alias("card")).groupBy("card").agg(F.count("*").alias("n"))


def start(cards: DataFrame, checkpoint: str, on_batch) -> StreamingQuery:
    """Hand each batch's changed cards to ``on_batch(df, batch_id)``; the checkpoint folder lets a restart go on."""
    return cards.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()
