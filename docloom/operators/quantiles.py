"""Exact order statistics of very large groups, found by narrowing value ranges in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage

BUCKETS = 1024
LAST_ROWS = 200_000  # distinct values of a range that one task may order


def values_at(counts: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, place, value): the value at each place (from 1) of a key's ordered values.

    ``counts``: key, value (double, not null) and how often it occurs (c); ``places``: key and place. Each round
    counts a range's values in ``BUCKETS`` equal parts and goes on with the part that holds the place, until
    its distinct values are few; no group is ever sorted whole.
    """
    ends = counts.groupBy(key).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    spans = cut_lineage(places.join(ends, key).withColumn("before", F.lit(0).cast("long")))
    while True:
        inside = counts.join(spans, key).where("value between low and high")
        most = spans.join(inside.groupBy(key, "place").agg(F.count("*").alias("n")), [key, "place"]).where("low < high").agg(F.max("n")).first()[0]
        if (most or 0) <= LAST_ROWS:
            break
        part = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1))
        parts = inside.withColumn("part", F.coalesce(part, F.lit(0))).groupBy(key, "place", "before", "part").agg(F.sum("c").alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(key, "place").orderBy("part"))
        held = parts.withColumn("upto", upto).where("place <= upto and place > upto - c")
        spans = cut_lineage(held.select(key, "place", "low", "high", (F.col("upto") - F.col("c")).alias("before")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(key, "place").orderBy("value"))
    return inside.withColumn("upto", upto).where("upto >= place").groupBy(key, "place").agg(F.min("value").alias("value"))
