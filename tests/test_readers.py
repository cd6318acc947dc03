"""Readers, settings, catalog parts and the whole way to an answer."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import accuracy, classify, fusion
from lodestone.operators.classify import Catalog, Rule
from lodestone.settings import Settings, embed, first_set
from lodestone.sources import snapshots


def test_posts_and_cases(spark, tmp_path):
    posts = tmp_path / "posts.json"
    posts.write_text(json.dumps([{"id": "a", "title": "T", "attachments": [], "is_latest_topic": True}, {"id": "b", "url": "https://x"}]))
    got = {r.id: r for r in snapshots.read_posts(spark, str(posts)).collect()}
    assert got["a"].attachments == [] and got["a"].is_latest_topic and got["b"].title is None
    case = {"id": "one-case", "question": "what now", "expected_grounded": True, "expected_source_title_contains": ["x"]}
    path = tmp_path / "cases.json"
    for cases, fault in (([case], None), ([], "no cases"), ([case, case], "repeated_id"), ([case | {"id": "No"}], "id"), ([case | {"question": "?"}], "question")):
        path.write_text(json.dumps(cases))
        if fault is None:
            assert snapshots.read_cases(spark, str(path)).count() == 1
        else:
            with pytest.raises(ValueError, match=fault):
                snapshots.read_cases(spark, str(path))


def test_settings():
    env = {"A": " ", "B": " key ", "K": "7"}
    assert first_set(("A", "B"), env) == "key" and first_set(("A", "C"), env) is None
    s = Settings.read({"embedding_key": ("A", "B"), "top_k": ("K",)}, env)
    assert (s.embedding_key, s.top_k, s.probe_k, s.keys_present) == ("key", 7, 20, False)
    with pytest.raises(ValueError):
        embed("q", lambda q: [[1.0]], s)
    whole = Settings("a", "b")
    assert embed("q", lambda q: [[1, 2]], whole) == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        embed("q", lambda q: [], whole)


def test_catalog_kinds_and_intents(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"default_topic_key": "g", "default_notice_kind_key": "information", "notice_kinds": [{"key": "information", "keywords": ["info"]}, {"key": "event", "keywords": ["fair"]}], "topics": [{"key": "g", "keywords": ["x"], "intents": [{"key": "g.change", "keywords": ["change"]}, {"key": "g.main", "keywords": ["sign up"]}]}]}))
    c = classify.read_catalog(spark, str(path))
    assert [k.key for k in c.kinds] == ["information", "event"] and c.default_kind == "information"
    rows = spark.createDataFrame([("Fair", "info"), ("none", "a job. fair of jobs. info"), ("none", "fa\nir")], "t string, b string")
    assert [r.k for r in rows.select(classify.notice_kind(F.col("t"), F.col("b"), c.kinds, c.default_kind).alias("k")).collect()] == ["event", "event", "information"]
    said = rows.select(classify.intent(F.lit("Sign  up now"), F.lit("change"), F.lit("g"), c).alias("a"), classify.intent(F.lit(""), F.lit("change"), F.lit("g"), c).alias("b"), classify.intent(F.lit(""), F.lit(""), F.lit("g"), c, F.lit("g.main")).alias("c"), classify.intent(F.lit(""), F.lit(""), F.lit("z"), c).alias("d"), classify.intent(F.lit(""), F.lit(""), F.lit("g"), c, F.lit("no")).alias("e")).first()
    assert tuple(said) == ("g.main", "g.change", "g.main", None, "g.change")


def test_listed(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert {r.url for r in snapshots.listed(pages, pages.where("url < 'c'"), pages.where("url = 'b'")).collect()} == {"a"}


def test_the_way_to_an_answer(spark):
    chunks = spark.createDataFrame(
        [(1, "Tuition refund dates. The refund opens in May.", "Tuition refund 2024", "u1", "2024-05-01 00:00:00", "i"), (2, "Tuition refund of old. Refund dates.", "Tuition refund 2023", "u2", "2023-05-01 00:00:00", "i"), (3, "Nothing alike", "Cafeteria", "u3", "2024-06-01 00:00:00", "j")],
        "id int, text string, title string, url string, published string, intent string",
    ).withColumn("published", F.to_timestamp("published"))
    asked = spark.createDataFrame([(0, "tuition refund dates", False)], "qid int, text string, general boolean")
    ranks = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid int, id int, rank int")
    catalog = Catalog((Rule("other", ("lorem",)),), "other")
    got = accuracy.supported(fusion.rrf(ranks, ranks), chunks, asked, catalog).collect()
    assert [(r.intent, r.id, r.relevance) for r in got] == [("i", 1, "relevant")] and got[0].context.startswith("Tuition refund dates.")


def test_only_relevant_candidates_reach_the_newest(spark):
    rows = [
        (1, "Tuition refund dates here.", "Tuition refund dates", "u1", "2024-05-01", "i", "notice"),
        (2, "Something else entirely.", "Cafeteria", "u2", "2024-09-01", "i", "notice"),  # newer, ambiguous: evicts nothing
        (3, "Tuition refund dates page.", "Tuition refund dates", "u3", None, "i", "static"),
        (4, "Tuition refund dates undated.", "Tuition refund dates", "u4", None, "k", "notice"),
        (5, "Tuition refund dates of others.", "Tuition refund dates", "u5", "2024-08-01", "m", "notice"),
    ]
    chunks = spark.createDataFrame(rows, "id int, text string, title string, url string, published string, intent string, document_type string").withColumn("published", F.to_timestamp("published"))
    asked = spark.createDataFrame([(0, "tuition refund dates", False, None, False), (1, "latest tuition refund dates", False, None, None), (2, "tuition refund dates", True, "i", False)], "qid int, text string, general boolean, intent string, recency boolean").drop("recency")
    ranks = spark.createDataFrame([(q, i, i) for q in range(3) for i in range(1, 6)], "qid int, id int, rank int")
    catalog = Catalog((Rule("other", ("lorem",)),), "other", recency=("latest",))
    got = sorted((r.qid, r.intent, r.id, r.evidence) for r in accuracy.supported(fusion.rrf(ranks, ranks), chunks, asked, catalog).collect())
    assert got == [(0, "i", 1, "newest"), (0, "i", 3, "reference"), (0, "k", 4, "newest"), (0, "m", 5, "newest"), (1, "i", 1, "newest"), (1, "m", 5, "newest"), (2, "i", 1, "newest"), (2, "i", 3, "reference")]


def test_pages_of_one_address_are_listed_each_for_itself(spark, tmp_path):
    """Larger tables repeat addresses; the SQL of `listed_pages` looks at numbers."""
    from lodestone.plans.queries import listed_pages

    spark.createDataFrame([(i, f"http://a/{i % 2}", "") for i in range(24)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(r.page_id for r in listed_pages(spark, str(tmp_path)).collect())
    assert got == [i for i in range(24) if i % 3 < 2 and i % 4]
