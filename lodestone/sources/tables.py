"""Loaders: the plain tables, and the collection of chunks that searches run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def collection(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with vectors and flat metadata: a vector's text is the document and its address the page of its number."""
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("title"))
    pages = load(spark, folder, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source_url"))
    vectors = load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("category"))
    return vectors.join(docs, "id", "left").join(pages, "id", "left").withColumn("published_at", F.lit(None).cast("string"))
