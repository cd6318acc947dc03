"""Latest notice per topic over a stream. An extension: batch results come from `operators.freshness`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(topic, latest_id, latest_at, posts) kept up to date; repeated ids within the delay count once.

    The state is one row for each topic, and ids for the time of the delay.
    """
    once = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy("topic").agg(F.max_by("id", F.struct("at", -F.col("id"))).alias("latest_id"), F.max("at").alias("latest_at"), F.count("*").alias("posts"))
