"""Audit of posts: what is missing, undated, misfiled, empty or stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.freshness import competes, latest_id_per_topic, stale


def sources(posts: DataFrame) -> DataFrame:
    return posts.groupBy("source").agg(F.count("*").alias("posts"))


def missing_sources(spark: SparkSession, posts: DataFrame, required: tuple[str, ...]) -> DataFrame:
    wanted = spark.createDataFrame([(s,) for s in required], "source string")
    return wanted.join(posts.select("source").distinct(), "source", "left_anti")


def topics(spark: SparkSession, posts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(topic, posts, latest_id, latest_at[, latest_title, latest_url]) of every topic of the catalog, empty ones too; of
    posts that have a `title` and a `url` also those of the latest."""
    catalog = spark.createDataFrame([(k,) for k in keys], "topic string")
    found = latest_id_per_topic(posts)
    out = catalog.join(found, "topic", "left").select("topic", F.coalesce("posts", F.lit(0)).alias("posts"), "latest_id", "latest_at")
    if not {"title", "url"} <= set(posts.columns):
        return out
    of = posts.select(F.col("topic").alias("_t"), F.col("id").alias("_id"), F.struct("title", "url").alias("_p"), F.col("ordinal").alias("_o"))
    named = out.join(of, (F.col("topic") == F.col("_t")) & (F.col("latest_id") == F.col("_id")), "left")
    return named.groupBy("topic", "posts", "latest_id", "latest_at").agg(F.min_by("_p", "_o").alias("_p")).select("topic", "posts", "latest_id", "latest_at", F.col("_p.title").alias("latest_title"), F.col("_p.url").alias("latest_url"))


def issues(spark: SparkSession, posts: DataFrame, keys: tuple[str, ...], required: tuple[str, ...], ruled: Column, now: Column, days: int = 180) -> DataFrame:
    """(code, source, topic, post_id) of posts (id, source, topic, document_type, published, crawled, ordinal): `ruled` is
    the topic that the rules give."""
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, code, source, topic, post: df.select(F.lit(code).alias("code"), source.alias("source"), topic.alias("topic"), post.alias("post_id"))
    summary = topics(spark, posts, keys)
    latest = summary.where(stale(F.col("latest_at"), now, days)).join(posts.select("id", "source"), F.col("latest_id") == F.col("id"))
    kind = posts.schema["id"].dataType
    return (
        row(missing_sources(spark, posts, required), "missing_source", F.col("source"), none("string"), none(kind))
        .unionByName(row(posts.where(F.col("published").isNull() & competes(F.col("document_type"))), "missing_published_at", F.col("source"), F.col("topic"), F.col("id")))
        .unionByName(row(posts.where(F.col("topic").isin(*keys) & (ruled != F.col("topic"))), "topic_override_mismatch", F.col("source"), F.col("topic"), F.col("id")))
        .unionByName(row(summary.where("latest_id IS NULL"), "empty_topic", none("string"), F.col("topic"), none(kind)))
        .unionByName(row(latest, "stale_topic", F.col("source"), F.col("topic"), F.col("latest_id")))
    )
