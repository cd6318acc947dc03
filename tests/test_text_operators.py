"""Hashed vectors, the phrase automaton, posts from pages, JSON kinds, rerank order, consistency and extractive answers."""

import math
import random
import re
from collections import Counter
from datetime import datetime
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import contract, json
from lodestone.operators import answers, automaton, classify, fusion, hashing, lexical, posts, search


def test_hashed_vectors(spark):
    rows = [(0, "Fair", "Jobs at the fair, jobs!"), (1, None, "jobs at a FAIR"), (2, "Lunch", "rice and soup"), (3, None, None), (4, "", "jobs at a fair " * 2000)]
    got = {r.id: r.embedding for r in hashing.text_vectors(spark.createDataFrame(rows, "id long, title string, text string"), 64).collect()}
    for i, title, text in rows:
        want = np.zeros(64)
        for part, weight in ((title, 3.0), (text, 1.0)):
            words = "".join(c if c.isascii() and c.isalnum() else " " for c in (part or "").lower()).split()
            flat = "".join(words)
            for f in ["w" + w for w in words] + ["g" + flat[k : k + n] for n in (2, 3, 4) for k in range(len(flat) - n + 1)]:
                h = int.from_bytes(blake2b(f.encode(), digest_size=8).digest(), "little")
                want[h % 64] += -weight if h >> 63 else weight
        size = np.linalg.norm(want)
        assert np.allclose(got[i], want / size if size else want)
    vectors = hashing.text_vectors(spark.createDataFrame(rows[:3], "id long, title string, text string"))
    asked = hashing.text_vectors(spark.createDataFrame([(9, None, "a job fair")], "id long, title string, text string")).select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    assert search.nearest_of_each(vectors, asked, 3).where("rank = 3").first().id == 2


def test_automaton_equals_case(spark):
    rules = (classify.Rule("a", ("one", "two  words", "Ⅸ")), classify.Rule("b", ("one two", "STRASSE")), classify.Rule("c", ("one", "words x")))
    texts = ["one", "ONE TWO", "two\nwords x", "straße", "none", "", None, "xonex", "two words", "ⅸ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(automaton.longest_match(F.col("t"), rules).alias("a"), classify.longest_match(F.col("t"), rules).alias("b")).collect()
    assert all(r.a == r.b for r in got) and got[1].a == "b" and got[7].a == "a"
    assert df.select(automaton.longest_match(F.col("t"), ()).alias("a")).first().a is None


def test_automaton_of_many_phrases(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 9)))) for _ in range(10_000)]
    rules = tuple(classify.Rule(f"k{i}", (w,)) for i, w in enumerate(dict.fromkeys(words)))
    texts = ["".join(rng.choice(list("abcdefgh"), 200)) for _ in range(20)] + ["abcdefgh" * 20_000]
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(automaton.longest_match(F.col("t"), rules).alias("k")).collect()]
    for text, key in zip(texts, got):
        found = [(-len(r.keywords[0]), n, r.key) for n, r in enumerate(rules) if r.keywords[0] in text]
        assert key == (min(found)[2] if found else None)


PAGE = """<html><head><title>A &amp; B</title><meta property="article:published_time" content="2026-02-11T09:00:00Z"><style>p{}</style>
<body><nav>menu <a href="/x.pdf">x</a></nav><!-- <p>gone</p> --><script>var t = "</p><p>no";</script>
<div>One<p>two <b>three</b> &lt;4&gt;&#x2f;<br>five<p>six<ul><li>a<li>b</ul></div><a href="../f/Plan.PDF?v=1">the  plan</a> <a href="mailto:x@y.z">mail</a><a href="https://e.org/q">q</a>
<table><tr><td>c1<td>c2</table><p>end &nosuch; <unclosed"""


def test_board_posts(spark):
    rows = [(1, "https://b.org/d/p.html", PAGE), (2, None, None), (3, "https://b.org", "<h1>Head</h1>text <time datetime='bad'>x</time>"), (4, "u", "< & > plain"), (5, "u", "")]
    got = {r.id: r for r in posts.board_posts(spark.createDataFrame(rows, "page_id int, url string, html string"), "s").collect()}
    one = got[1]
    assert one.title == "A & B" and one.document_type == "notice" and one.published_at == datetime(2026, 2, 11, 9)
    assert one.content.split("\n")[:7] == ["One", "two three <4>/", "five", "six", "a", "b", "the plan mailq"]
    assert "c1\nc2\nend &nosuch;" in one.content and "gone" not in one.content and "menu" not in one.content and "var" not in one.content
    assert [tuple(a) for a in one.attachments] == [("the plan", "https://b.org/f/Plan.PDF?v=1")] and one.links == ["https://b.org/f/Plan.PDF?v=1", "https://e.org/q"]
    assert (got[2].title, got[2].content, got[2].document_type) == (None, "", "static")
    assert (got[3].title, got[3].content, got[3].published_at) == ("Head", "Head\ntext x", None)
    assert got[4].content == "< & > plain" and got[5].content == ""


def test_json_kinds(spark):
    texts = ['{"a": 1}', "[1]", "1", '"x"', "true", "null", "{", "", None, " {} ", "[] x", "1],[2", '1},{"v":2', "1, 2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(json.json_kind(F.col("t")).alias("k"), json.object_or_null(F.col("t")).isNotNull().alias("o")).collect()
    assert [r.k for r in rows] == ["object", "array", "scalar", "scalar", "scalar", "null", "broken", "broken", None, "object", *["broken"] * 4]
    assert [r.o for r in rows] == [True] + [False] * 8 + [True] + [False] * 4


def test_rerank_order(spark):
    kind = "qid int, id int, score double, title_marker boolean, body_marker boolean, temporal boolean, conflict boolean, published int"
    rows = [(0, 1, 0.9, True, True, True, True, 9), (0, 2, 0.1, True, False, True, False, 1), (0, 3, 0.1, True, False, True, False, 2), (0, 4, 0.8, False, True, True, False, 9), (0, 5, 0.1, True, False, True, None, None), (0, 6, 0.2, True, False, True, False, 0), (0, 7, 0.9, True, None, False, False, 9)]
    assert [r.id for r in fusion.reranked(spark.createDataFrame(rows, kind)).orderBy("place").collect()] == [6, 3, 2, 5, 7, 4, 1]


def test_inconsistent_candidates_fail_closed(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, meta string")
    assert sorted(tuple(r) for r in fusion.consistent(rows((1, "a"), (2, None)), rows((1, "a"), (2, None))).collect()) == [(1, "a"), (2, None)]
    assert [r.id for r in fusion.inconsistent(rows((1, "a"), (2, None)), rows((1, None), (2, None))).collect()] == [1]
    with pytest.raises(Exception, match="metadata differ"):
        fusion.consistent(rows((1, "a")), rows((1, None))).collect()


def test_extractive_answers(spark):
    context = "The fair opens in May. The fair opens in May! Lunch is at noon. Register for the fair by April."
    df = spark.createDataFrame([(0, context, ["fair", "may", "register"]), (1, "No word of it. Nor here.", ["fair"]), (2, "", ["x"]), (3, None, None), (4, "x" * 900, ["x"])], "i int, c string, t array<string>")
    got = {r.i: r.a for r in df.select("i", answers.extractive(F.col("c"), F.col("t"), 60).alias("a")).collect()}
    assert got == {0: "The fair opens in May.\nRegister for the fair by April.", 1: "No word of it.", 2: None, 3: None, 4: None}
    assert df.where("i = 0").select(answers.required(answers.extractive(F.col("c"), F.col("t"))).alias("a")).first().a
    with pytest.raises(Exception, match="empty"):
        df.where("i = 2").select(answers.required(answers.extractive(F.col("c"), F.col("t"))).alias("a")).collect()


def test_nfkc_changes_matches(spark):
    import unicodedata

    from lodestone.functions.unicode import nfkc
    from lodestone.operators import lexical

    texts = ["ＡＢＣ　ｄｅｆ", "ﬁle ①", "\u1100\u1161", "plain", "", None, "½ x²"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.t for r in df.orderBy("id").select(nfkc("text").alias("t")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    asked = spark.createDataFrame([(0, "abc file 가")], "qid int, text string")
    assert lexical.bm25(df, asked).count() == 0
    assert sorted(r.id for r in lexical.bm25(df.withColumn("text", nfkc("text")), asked).collect()) == [0, 1, 2]


def test_endpoints_that_a_message_may_name(spark):
    fine = ["/api/health 확인", "서버는 /api/live에서 확인", "보기: /api/health.", "/api/live, 그리고 /api/health를", "/api/health,다음"]
    bad = ["/api/healthz 확인", "/api/live/x 확인", "/api/health/api/live", "/api/other 확인", "/api/health,next", "길 /etc/passwd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(fine + bad)], "i int, t string").orderBy("i")
    got = [r.u for r in df.select(contract.first_unsafe(F.col("t")).alias("u")).collect()]
    assert got == [None] * len(fine) + ["posix_path"] * len(bad)


@pytest.mark.parametrize("grams", [False, True])
def test_bm25_equals_plain_sums_without_shuffling_terms(spark, grams):
    """Copies tie by id, words and character runs that are the same term count together, and no term leaves its task."""
    rng = random.Random(5)
    kinds = ["ab", "abc", "공지", "공지사항", "Straße", "x", "12", "longer", "ab공", "e-f"]
    texts = [" ".join(rng.choice(kinds) for _ in range(rng.randrange(12))) for _ in range(80)]
    rows = [(i, texts[i % 70]) for i in range(300)] + [(900, ""), (901, None)]
    asks = [(f"q{i}", " ".join(rng.choice(kinds) for _ in range(1 + i))) for i in range(6)] + [("none", "unknown?"), ("null", None)]

    def terms_of(x):
        folded = (x or "").lower().replace("ß", "ss")
        flat = re.sub("[^0-9a-z가-힣]", "", folded)
        return folded.split() + [flat[i : i + n] for n in (2, 3, 4) for i in range(len(flat) - n + 1) if grams]

    said = {i: Counter(terms_of(t)) for i, t in rows}
    mean = sum(c.total() for c in said.values()) / len(rows)
    df = Counter(t for c in said.values() for t in c)
    want = []
    for q, text in asks:
        scores = {}
        for i, c in said.items():
            parts = [math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t in set(terms_of(text)) if c[t]]
            scores[i] = round(sum(parts), 6)
        want += [(q, i, s, n + 1) for n, (i, s) in enumerate(sorted(((i, s) for i, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:9])]
    chunks, asked = spark.createDataFrame(rows, "id long, text string").repartition(3), spark.createDataFrame(asks, "qid string, text string")
    for block in (100, 3):
        found = lexical.bm25(chunks, asked, 9, grams, 6, block=block)
        assert sorted((r.qid, r.id, r.score, r["rank"]) for r in found.collect()) == sorted(want)
    assert "explode" not in lexical.bm25(chunks, asked, 9, grams, 6)._jdf.queryExecution().toString()


def test_a_task_remembers_few_features():
    """What a worker keeps does not grow with what it has seen."""
    vector = hashing.hashed("", " ".join(f"w{i}" for i in range(60_000)), 64, 3.0)
    assert np.isclose(np.linalg.norm(vector), 1) and len(hashing._features) <= 50_000
