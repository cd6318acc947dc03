"""Latest notices: by topic, over all, by intent, and what counts as stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competes(document_type: Column) -> Column:
    """Static and historical documents never compete for latest or recent; a null type is a notice's."""
    return F.coalesce(~document_type.isin("static", "historical"), F.lit(True))


def _competing(rows: DataFrame) -> Column:
    """`competes`, where the rows have a type; rows without that column are notices."""
    return competes(F.col("document_type")) if "document_type" in rows.columns else F.lit(True)


def _freshness() -> Column:
    """Dated posts first, then the later date (crawl time without one), then the later crawl; of equals the earlier row."""
    return F.struct(F.col("published").isNotNull(), F.coalesce("published", "crawled"), F.col("crawled"), (-F.col("ordinal")).alias("o"))


def latest_per_topic(posts: DataFrame) -> DataFrame:
    """Posts (topic, id, published timestamp or null, crawled, ordinal[, document_type]) with `is_latest`: one post of each
    topic that has any that competes.

    An aggregate of structs is combined in every task before the shuffle, so that a hot topic is no single task.
    """
    best = posts.where(_competing(posts)).groupBy("topic").agg(F.max_by("id", _freshness()).alias("latest_id"))
    flag = F.coalesce(F.col("id") == F.col("latest_id"), F.lit(False)) & _competing(posts)
    return posts.join(best, "topic", "left").withColumn("is_latest", flag).drop("latest_id")


def latest_id_per_topic(posts: DataFrame) -> DataFrame:
    """(topic, latest_id, latest_at, posts): all posts count, only those that compete can be latest; null if none does."""
    rank = F.when(_competing(posts), _freshness())
    return posts.groupBy("topic").agg(F.max_by("id", rank).alias("latest_id"), F.max_by("published", rank).alias("latest_at"), F.count("*").alias("posts"))


def recent(posts: DataFrame, related: str | None, limit: int = 3) -> DataFrame:
    """At most `limit` dated notices (topic, id, url, published): the related topic first, then the newest, addresses
    distinct; posts without an address are distinct by themselves."""
    first = F.when(F.col("topic") == F.lit(related), 0).otherwise(1)
    rank = F.struct(-first, F.col("published"), -F.col("id"))
    dated = posts.where(F.col("published").isNotNull() & _competing(posts))
    one = dated.groupBy("url", F.when(F.col("url").isNull(), F.col("id")).alias("_own")).agg(F.max_by(F.struct("topic", "id", "published"), rank).alias("p")).select("url", "p.*")
    return one.orderBy(F.when(F.col("topic") == F.lit(related), 0).otherwise(1), F.desc("published"), "id").limit(limit)


def freshest_per_intent(candidates: DataFrame) -> DataFrame:
    """Of each (qid, intent) the row of the freshest address: dated first, later date, better score, smaller id.

    Static and historical rows (`document_type`) take no part, nor do undated rows of a question that asks for recent
    ones (`recency`); both columns are optional.
    """
    rows = candidates.where(_competing(candidates))
    if "recency" in candidates.columns:
        rows = rows.where(F.col("published").isNotNull() | ~F.coalesce("recency", F.lit(False)))
    by = Window.partitionBy("qid", "intent").orderBy(F.col("published").isNull(), F.desc("published"), F.desc("score"), "id")
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def stale(published: Column, now: Column, days: int = 180) -> Column:
    """Whether a time is more than `days` days before `now`; null without one."""
    return F.unix_timestamp(now) - F.unix_timestamp(published) > days * 86_400


def best_per_url(found: DataFrame) -> DataFrame:
    """Of each (qid, url) the row with the best score, of equals the smallest id: one chunk stands for its page."""
    best = found.groupBy("qid", "url").agg(F.max_by(F.struct(*found.columns), F.struct("score", -F.col("id"))).alias("row"))
    return best.select("row.*")


def latest_urls(posts: DataFrame) -> DataFrame:
    """(topic, urls): the distinct addresses of each topic's latest posts (`is_latest`), in order; topic null has all."""
    latest = posts.where("is_latest AND url IS NOT NULL")
    both = latest.select("topic", "url").unionByName(latest.select(F.lit(None).cast("string").alias("topic"), "url"))
    return both.groupBy("topic").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def latest_of_all(posts: DataFrame) -> DataFrame:
    """(topic, id, url) of the freshest of the topics' latest posts: dated first, then the later date, then the later
    crawl; of equals the earlier row."""
    return posts.where(F.col("is_latest") & _competing(posts)).agg(F.max_by(F.struct("topic", "id", "url"), _freshness()).alias("p")).where("p IS NOT NULL").select("p.*")
