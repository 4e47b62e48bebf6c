"""Relations that arrive as a stream, merged as they come.

The batch merge is a sum and a first by seq, both of which combine: merging merged parts again gives the merge of the
whole. Each micro-batch is merged and written under its number, so a batch that is replayed replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import merge_relations


def merge_into(stream: DataFrame, path: str, checkpoint: str):
    """Start writing each micro-batch's merged relations below ``path``; returns the streaming query."""

    def write(batch: DataFrame, number: int) -> None:
        merge_relations(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The relations of all batches so far."""
    return merge_relations(spark.read.parquet(path).drop("batch"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """``start, event_type, n`` of a stream or table of events (ts, event_type); what is later than ``late`` is dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
