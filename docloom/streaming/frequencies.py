"""Running frequency tables as a structured stream: one row per key with its count and last time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frequencies(events: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """Counts and last times by key, of a stream or a table alike."""
    return events.groupBy(*keys).agg(F.count("*").alias("frequency"), F.max(at).alias("last_asked"))


def tumbling_counts(events: DataFrame, key: str, width: str, late: str, at: str = "ts") -> DataFrame:
    """Counts by key and window; rows later than ``late`` are dropped, and closed windows leave the state."""
    return events.withWatermark(at, late).groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def run_available(spark: SparkSession, counted: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a counted stream over all that is there now; ``out`` holds the table as of the last batch.

    Each batch writes the whole table under its own number, so a batch that is run again after a failure
    replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    last = stream.lastProgress
    batches = spark.read.parquet(out)
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).first()[0]).drop("batch") if last is not None else batches.drop("batch")
