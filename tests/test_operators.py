"""Operators on inline rows: limits, drops, votes, fallbacks, freshness, storage."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, chunking, classify, compress, evaluate, freshness, fusion, gate, lexical, readiness, routing, search
from lodestone.sources import store

ROW = "id long, text string, embedding array<double>, title string, source_url string, source string, published_at string, category string"


def rows(spark, *items):
    return spark.createDataFrame([(i, t, e, None, u, "", " ", c) for i, t, e, u, c in items], ROW)


def test_search_order_and_filter(spark):
    c = rows(spark, (1, "first", [1.0, 0.0], "https://a/1", "academic"), (2, "second", [0.0, 1.0], "https://a/2", "employment"))
    got = search.checked(search.nearest(c, [1.0, 0.0])).orderBy("rank").collect()
    assert [(r.id, r.title, r.source, r.published_at, r.score) for r in got] == [(1, "Untitled notice", "Chroma data", None, 1.0), (2, "Untitled notice", "Chroma data", None, 0.0)]
    assert [r.id for r in search.nearest(c, [1.0, 0.0], category="employment").collect()] == [2]
    assert search.nearest(c, [1.0, 0.0], category="").count() == 2


def test_limits(spark):
    c = rows(spark, *[(i, "t", [1.0, i / 10], "https://a", "c") for i in range(8)])
    assert search.nearest(c, [1.0, 0.0], 0).count() == 5 and search.nearest(c, [1.0, 0.0], 99).count() == 8
    with pytest.raises(ValueError):
        search.nearest(c, [1.0, 0.0], -1)


def test_drops_are_not_refilled(spark):
    bad = [(1, " ", "https://a"), (2, None, "https://a"), (3, "t", None), (4, "t", "ftp://a"), (5, "t", "HTTP://a"), (6, "t", "https://a")]
    c = rows(spark, *[(i, t, [1.0, i / 100], u, "c") for i, t, u in bad])
    assert [r.id for r in search.checked(search.nearest(c, [1.0, 0.0], 5)).collect()] == []
    assert [r.id for r in search.checked(search.nearest(c, [1.0, 0.0], 6)).collect()] == [6]


def test_the_plan_filters_before_the_limit(spark, sf):
    c = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("category"))
    plan = search.nearest(c, [1.0] * 64, category="3")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(label)" in plan


def vote_of(spark, items):
    df = spark.createDataFrame([(0, p, s, c) for p, (s, c) in enumerate(items, 1)], "qid int, place int, score double, category string")
    return [r.category for r in routing.elected(routing.vote(df)).collect()]


def test_votes(spark):
    assert vote_of(spark, [(0.9, "academic"), (0.8, "employment")]) == ["academic"]
    assert vote_of(spark, [(0.5, "b"), (1.0, "a")]) == ["b"]  # equal sums: the one seen first
    assert vote_of(spark, [(0.9, None), (0.0, "a")]) == ["a"]
    assert vote_of(spark, [(0.9, None)]) == []


def test_routing_and_fallback(spark):
    near = [(i, "t", [1.0, i / 100], "https://a", "x") for i in range(1, 4)]
    dropped = [(i, " ", [1.0, i / 1000], "https://a", "y") for i in range(10, 16)]
    c = rows(spark, *near, *dropped, (30, "far", [0.9, 0.5], "https://a", "y"))
    q = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], "y"), (3, [1.0, 0.0], "none")], "qid int, vector array<double>, explicit string")
    got = {}
    for r in routing.routed(c, q).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append((r.stage, r.id))
    assert got[1] == [(1, 1), (1, 2), (1, 3)]  # elected x
    assert got[2] == [(2, 1)]  # the five nearest of y have no text; of the five nearest of all one has
    assert got[3] == got[2]
    more = spark.createDataFrame([(4, [0.6, 0.8], "none")], q.schema)
    assert [(r.stage, r.id) for r in routing.routed(c, more).orderBy("place").collect()] == [(2, 30), (2, 3), (2, 2)]
    only = rows(spark, *dropped, near[2])
    assert routing.routed(only, more.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))).count() == 0  # not refilled
    said = {r.qid: r for r in routing.respond(routing.answers(q, routing.routed(c, q)), lambda ctx: F.substring(ctx, 1, 6)).collect()}
    assert said[1].grounded and said[1].n_sources == 3 and said[1].answer.startswith("- [자료")


def test_no_answer(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], None)], "qid int, vector array<double>, explicit string")
    r = routing.respond(routing.answers(q, routing.routed(rows(spark), q)), lambda ctx: ctx).first()
    assert (r.response_type, r.grounded, r.n_sources, r.answer) == ("no_answer", False, 0, routing.NO_ANSWER)


def test_strict_reasons_in_order(spark):
    flags = [True, 5, True, True, True, True, 5]
    reason = lambda f: spark.range(1).select(readiness.strict_reason(*[F.lit(x) for x in f]).alias("r")).first().r
    assert reason(flags) == "compatible"
    for k, (bad, name) in enumerate([(False, "index_unavailable"), (0, "empty_index"), (False, "missing_manifest"), (False, "invalid_manifest"), (False, "settings_mismatch"), (False, "content_mismatch"), (6, "chunk_count_mismatch")]):
        assert reason([*flags[:k], bad, *flags[k + 1 :]]) == name


CATALOG = classify.Catalog((classify.Rule("a", ("수강신청", "신청"), action_markers=("변경",), evidence_markers=("수강신청",)), classify.Rule("b", ("장학금 신청",), title_markers=("장학",)), classify.Rule("general", ())), "general", ("최근",), ("안내",), (("수강신청", "수강 신청"),))


def test_classification(spark):
    df = spark.createDataFrame([(1, "장학금  신청 방법"), (2, "수강신청"), (3, "기타"), (4, "신청")], "id int, text string")
    assert [r.t for r in df.orderBy("id").select(classify.topic(F.col("text"), CATALOG).alias("t")).collect()] == ["b", "a", "general", "a"]
    titled = spark.createDataFrame([("장학 소식", "x"), ("소식", "신청 기간. 수강신청 변경 안내."), ("소식", "신청. 변경.")], "t string, b string")
    assert [r.t for r in titled.select(classify.topic_title_first(F.col("t"), F.col("b"), CATALOG).alias("t")).collect()] == ["b", "a", "general"]
    with pytest.raises(ValueError):
        classify.Catalog((classify.Rule("a", ("x", "x")),), "a")
    with pytest.raises(ValueError):
        classify.Catalog((classify.Rule("a", ()),), "b")


def test_catalog_file(spark, tmp_path):
    p = tmp_path / "rules.json"
    p.write_text(json.dumps({"default_topic_key": "g", "topics": [{"key": "g", "keywords": ["k"]}], "retrieval_policy": {"recency_terms": ["now"], "alias_groups": [["a", "b"]]}}))
    assert classify.read_catalog(spark, str(p)) == classify.Catalog((classify.Rule("g", ("k",)),), "g", ("now",), (), (("a", "b"),))


def test_evidence(spark):
    question, title = F.lit("2026학년도 1학기 수강신청 변경기간"), F.col("t")
    titles = ["수강신청 안내", "2025학년도 수강신청", "2026학년도 수강신청", "2026학년도 2학기 수강신청", "2026학년도 1학기 수강신청", "2026 1학기 변경기간 공지", "2026 1학기 변경"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    reason = gate.evidence(question, title, F.lit(False), F.lit(False), gate.match_terms(question, CATALOG), gate.distinctive(question, ("수강신청",)), F.array(F.lit("수강신청")))
    assert [r.r for r in df.orderBy("i").select("i", reason.alias("r")).collect()] == ["missing_temporal_evidence", "year_mismatch", "missing_temporal_evidence", "semester_mismatch", "accepted_topic_marker", "accepted_title_overlap", "insufficient_title_evidence"]


def test_freshness(spark):
    t = lambda d: datetime(2026, 1, d)
    posts = spark.createDataFrame([("x", 1, t(5), t(9), 1, "u1"), ("x", 2, t(7), t(8), 2, "u2"), ("x", 3, t(7), t(8), 3, "u2"), ("x", 4, None, t(20), 4, "u4"), ("y", 5, None, t(3), 5, "u5"), ("y", 6, None, t(4), 6, "u6")], "topic string, id int, published timestamp, crawled timestamp, ordinal int, url string")
    assert {r.topic: r.latest_id for r in freshness.latest_id_per_topic(posts).collect()} == {"x": 2, "y": 6}
    assert [r.id for r in freshness.latest_per_topic(posts).where("is_latest").orderBy("id").collect()] == [2, 6]
    assert [r.id for r in freshness.recent(posts, "y").collect()] == [2, 1]


def test_static_and_historical_posts_do_not_compete(spark):
    t = lambda d: datetime(2026, 1, d)
    kind = "topic string, id int, published timestamp, crawled timestamp, ordinal int, url string, document_type string, qid int, intent string, score double, recency boolean"
    row = lambda topic, i, day, url, kind, recent: (topic, i, day and t(day), t(9), i, url, kind, 0 if recent else 1, topic, 0.5, recent)
    posts = spark.createDataFrame([row("x", 1, 20, "u1", "static", False), row("x", 2, 5, None, "notice", False), row("x", 3, 4, None, None, False), row("y", 4, 6, "u4", "historical", False), row("z", 5, None, "u5", "notice", True), row("z", 6, None, "u6", "notice", False)], kind)
    latest = {r.topic: (r.latest_id, r.posts) for r in freshness.latest_id_per_topic(posts).collect()}
    assert latest == {"x": (2, 3), "y": (None, 1), "z": (6, 2)} or latest == {"x": (2, 3), "y": (None, 1), "z": (5, 2)}
    flagged = freshness.latest_per_topic(posts)
    assert flagged.count() == 6 and [r.id for r in flagged.where("is_latest").orderBy("id").collect()] == [2, 5]
    assert [r.id for r in freshness.recent(posts, None).collect()] == [2, 3]  # without an address each is its own
    assert sorted((r.qid, r.intent, r.id) for r in freshness.freshest_per_intent(posts).collect()) == [(1, "x", 2), (1, "z", 6)]
    assert freshness.latest_of_all(flagged).first().id == 2
    assert [r.topic for r in audit.issues(spark, posts.withColumn("source", F.lit("s")), ("x", "y"), (), F.col("topic"), F.lit(t(9))).where("code = 'empty_topic'").collect()] == ["y"]


def test_audit(spark):
    t = datetime(2026, 1, 1)
    posts = spark.createDataFrame([(1, "s", "x", "notice", t, t, 1), (2, "s", "x", "static", None, t, 2), (3, "s", "x", "notice", None, t, 3)], "id int, source string, topic string, document_type string, published timestamp, crawled timestamp, ordinal int")
    got = audit.issues(spark, posts, ("x", "z"), ("s", "w"), F.lit("x"), F.lit("2026-12-01").cast("timestamp")).collect()
    assert sorted((r.code, r.source, r.topic, r.post_id) for r in got if r.code != "missing_source") == [("empty_topic", None, "z", None), ("missing_published_at", "s", "x", 3), ("stale_topic", "s", "x", 1)]
    assert [r.source for r in got if r.code == "missing_source"] == ["w"]


def test_lexical_and_fusion(spark):
    chunks = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky")], "id int, text string")
    asked = spark.createDataFrame([(0, "Apple red")], "qid int, text string")
    found = lexical.bm25(chunks, asked)
    assert [(r.id, r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    dense = spark.createDataFrame([(0, 3, 1), (0, 2, 2)], "qid int, id int, rank int")
    fused = fusion.rrf(found, dense).orderBy("place").collect()
    assert [(r.id, r.signals) for r in fused] == [(2, 2), (1, 1), (3, 1)] and fused[0].fused == pytest.approx(2 / 62)
    assert lexical.bm25(chunks, asked, grams=True).count() == 2
    assert lexical.wide(3) == 50 and lexical.wide(9) == 90


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "abc")], "id int, text string")
    assert [(r.id, r.start, r.text) for r in chunking.windows(docs, 4, 1).orderBy("id", "chunk_no").collect()] == [(1, 0, "abcd"), (1, 3, "defg"), (1, 6, "ghij"), (3, 0, "abc")]
    assert [(r.id, r.text) for r in chunking.bounded_windows(docs, 4, 0).where("id = 3").collect()] == [(3, "abc")]
    assert [c for _, c in chunking.cut("one two. three four", 12, 0, 0.5)] == ["one two. ", "three four"]


def test_compression_and_repeated_lines(spark):
    row = spark.createDataFrame([(0, 1, "One cat. Two dogs. A cat and a dog. Nothing here. The dog.", ["cat", "dog"])], "qid int, id int, text string, terms array<string>")
    assert compress.compressed(row).first().context == "One cat. A cat and a dog. The dog."
    a = spark.createDataFrame([(1, "the office opens at nine in the morning daily"), (2, "nothing like it at all")], "id int, line string")
    b = spark.createDataFrame([(7, "The office opens at nine in the morning, daily."), (8, "other words")], "id int, line string")
    assert [(r.a_id, r.b_id, r["share"]) for r in compress.repeated_lines(a, b).collect()] == [(1, 7, 1.0)]
    one = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj")], "id int, line string")
    often = spark.createDataFrame([(7, "aa bb cc dd ee ff gg hh ii kk")] * 3, "id int, line string")
    assert [round(r["share"], 3) for r in compress.repeated_lines(one, often).collect()] == [0.818]


def test_evaluation(spark):
    df = spark.createDataFrame([(True, True, None, True), (True, False, True, None)], "topic_match boolean, grounded_match boolean, latest_only_match boolean, source_title_match boolean")
    assert [r.p for r in df.select(evaluate.passed().alias("p")).collect()] == [True, False]
    got = {r.metric: (r.passed, r.total, r.rate) for r in evaluate.metrics(df).collect()}
    assert got == {"topic_match": (2, 2, 1.0), "grounded_match": (1, 2, 0.5), "latest_only_match": (1, 1, 1.0), "source_title_match": (1, 1, 1.0)}
    assert [evaluate.exit_code(*x) for x in ((0, 0), (3, 0), (3, 1))] == [2, 0, 1] and "| a | 1 | 2 | 50.00% |" in evaluate.report([("a", 1, 2, 0.5)], "t")


def test_store(spark, tmp_path):
    path, df = str(tmp_path / "c"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    with pytest.raises(store.StoreError):
        store.open_collection(spark, path)
    assert store.read_manifest(spark, path) is None
    made = store.rebuild(df, path, {"model": "m"})
    assert made["count"] == 2 and store.read_manifest(spark, path) == made and store.open_collection(spark, f"{path}/{made['folder']}").count() == 2
    with pytest.raises(store.StoreError):
        store.rebuild(df, path, {"model": "m"})
    assert store.rebuild(df.limit(1), path, {"model": "m"}, reset=True)["count"] == 1
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, text string, ordinal int")
    assert sorted(map(tuple, store.upsert(df, new).collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_reports_replace_together(tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "none" / "b.md"
    good.write_text("old")
    with pytest.raises(OSError):
        store.write_reports({str(good): "new", str(bad): "x"})
    assert good.read_text() == "old"
    store.write_reports({str(good): "new", str(tmp_path / "b.md"): "x"})
    assert good.read_text() == "new" and sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.md"]


def test_latest_stream(spark, tmp_path):
    from lodestone.streaming.latest import latest_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([("x", 1, datetime(2026, 1, 1)), ("x", 2, datetime(2026, 1, 1, 0, 30)), ("x", 2, datetime(2026, 1, 1, 0, 30)), ("y", 3, datetime(2026, 1, 1))], "topic string, id long, at timestamp").write.parquet(src)
    q = latest_stream(spark.readStream.schema("topic string, id long, at timestamp").parquet(src)).writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.topic: (r.latest_id, r.posts) for r in spark.table("latest").collect()} == {"x": (2, 2), "y": (3, 1)}
