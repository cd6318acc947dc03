"""Bounded samples for fitting: chosen by a hash of the id, so that they are spread over the table and the same each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` distinct ids (one column, `doc_id`)."""
    return ids.where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def labelled(labels: DataFrame, name: str, train: Column) -> DataFrame:
    """(doc_id, y) of the training rows: 1 if any label of the id says so; null labels are left out."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(name).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(train)
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, y) for the ids of `chosen` (doc_id, y): of repeated ids the text with the smallest hash.

    `chosen` is bounded by the caller, so that it can be broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
