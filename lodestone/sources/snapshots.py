"""Readers of JSON snapshots, with schemas of their own, so that nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.evaluate import faulty_cases

POSTS = (
    "id string, source string, title string, content string, author string, published_at string, llm_category string, document_type string, url string, attachments array<string>, "
    "crawled_at string, topic_key string, topic_label string, category_key string, category_label string, intent_key string, notice_kind string, is_latest_topic boolean"
)
CASES = (
    "id string, question string, category string, expected_topic_key string, confirmed_intent_key string, expected_intent_key string, expected_grounded boolean, expected_latest_only boolean, "
    "expected_source_title_contains array<string>, notes string"
)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a JSON array; absent fields are null, and a file that is no JSON fails when it is read."""
    return _read(spark, path, POSTS)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array. None at all, or one that breaks a rule of `faulty_cases`, is an error."""
    cases = _read(spark, path, CASES)
    bad = faulty_cases(cases.select("id", "question", "expected_grounded", F.coalesce("expected_source_title_contains", F.array().cast("array<string>")).alias("expected_titles"))).limit(1).collect()
    if bad or cases.isEmpty():
        raise ValueError(f"case {bad[0]['id']}: {bad[0]['rule']}" if bad else "there are no cases")
    return cases


def listed(pages: DataFrame, allowed: DataFrame, denied: DataFrame | None = None, key: str = "url") -> DataFrame:
    """Pages whose `key` is in `allowed` (key) and, where there is one, not in `denied` (key). By address, pages of one address
    are listed or not together; by another key each for itself."""
    kept = pages.join(allowed.select(key).distinct(), key, "left_semi")
    return kept if denied is None else kept.join(denied.select(key).distinct(), key, "left_anti")
