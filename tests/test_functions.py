"""Column functions on inline rows that the driver's tables cannot reach."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import contract, rows, text, vector


def values(spark, kind, items, make):
    df = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_score(spark):
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.5, 0.0, 0.4, 1.0, 2.0]
    assert values(spark, "double", odd, vector.score) == [0, 0, 0, 0, 1, 1, 0.6, 0, 0]


def test_whole_number(spark):
    assert values(spark, "string", ["500", " 500 ", "-5", "5.0", "", "true", None, "²"], rows.whole_number) == [500, 500, None, None, None, None, None, None]


def test_questions(spark):
    assert values(spark, "string", ["a", "ab", "a" * 500, "a" * 501, "   ", " a ", " ab ", None, " " * 499 + "ab"], rows.valid_question) == [False, True, True, False, False, False, True, False, False]


def test_explicit_category(spark):
    asked = ["이현아교수님의 평가가 어때?", "강 의 평", "수강신청 언제", "강의 시간", None]
    assert values(spark, "string", asked, rows.explicit_category) == ["강의평", "강의평", None, None, None]


def test_bullets(spark):
    said = ["첫 번째 안내\n둘째 안내", "- 첫 번째\n- 둘째", "-\n- \n•• x\n* y\n\n-z", ""]
    assert values(spark, "string", said, text.bullets) == ["- 첫 번째 안내\n- 둘째 안내", "- 첫 번째\n- 둘째", "- x\n- y\n- z", ""]


def test_white_space(spark):
    assert values(spark, "string", ["　a b　", " x"], text.strip) == ["a b", "x"]
    assert values(spark, "string", ["　a b\tc"], text.squeeze) == ["abc"]


def test_tokens(spark):
    assert values(spark, "string", ["장학금을 신청하는 방법은 ABC에서 가"], text.tokens) == [["장학금", "신청하", "방법", "abc"]]
    assert values(spark, "string", ["2026학년도 1 학기", "12026", "겨울계절 수업", "여름 계절학기"], text.year) == [2026, None, None, None]
    assert values(spark, "string", ["2026학년도 1 학기", "x", "겨울계절 수업", "여름 계절학기"], text.term) == ["first", None, "winter", "summer"]


def test_published(spark):
    given = ["2026-02-11", "2026-02-11T08:00:00Z", "2026.02.11", "2026", "08:00", "2026-2-1", "", None]
    got = values(spark, "string", given, lambda x: F.unix_timestamp(text.published(x)))
    assert got == [1770768000, 1770796800, None, None, None, None, None, None]


def test_line_classes(spark):
    lines = ["", "핵심 내용", "1. 제목", "분류 · 학사", "- a", "출처 · b", "plain"]
    assert values(spark, "string", lines, contract.line_class) == ["spacer", "section", "notice", "meta", "bullet", "citation", "line"]


@pytest.mark.parametrize(
    ("message", "safe"),
    [("잠시 후 다시 시도하세요.", True), ("no hangul", False), ("경로 /etc/passwd", False), ("오류 ValueError: x", False), ("키 API_KEY=abc", False), ("둘째\n줄", False), ("", False), ("주소 https://a.b/c 확인", True), ("주소 https://a.b/c?d=1 확인", False), ("상태는 /api/health에서 확인하세요.", True), ("가" * 501, False)],
)
def test_safe_messages(spark, message, safe):
    assert values(spark, "string", [message], contract.safe_message) == [safe]


def test_web_urls(spark):
    urls = ["http://a.b", "https://a.b/c d", "HTTP://a.b", "ftp://a", "http://u:p@a.b", "", None, "https://a.b/x"]
    got = values(spark, "string", urls, contract.web_url)
    assert [got[i] for i in (0, 2, 3, 4, 5, 6, 7)] == [True, True, False, False, False, False, True]


def test_response_faults(spark):
    source = "array(named_struct('title', 't', 'url', 'https://a.b', 'source', 's', 'published_at', cast(null as string), 'score', 0.5D))"
    none = "cast(array() as array<struct<title:string,url:string,source:string,published_at:string,score:double>>)"
    cases = [
        ("answer", "x", True, source, "i", 1, None), (None, "x", True, source, None, 0, None), ("other", "x", True, source, "i", 1, "type"), ("answer", " ", True, source, "i", 1, "answer"),
        ("clarification", "x", False, none, "i", 1, None), ("clarification", "x", True, none, "i", 1, "clarification"), ("clarification", "x", False, none, None, 1, "clarification"), ("clarification", "x", False, none, "i", 0, "clarification"),
        ("no_answer", "x", False, none, None, 0, None), ("no_answer", "x", False, source, None, 0, "no_answer"), ("answer", "x", True, source.replace("https", "ftp"), "i", 1, "source"),
    ]
    for kind, answer, grounded, sources, intent, options, fault in cases:
        row = spark.range(1).select(contract.response_fault(F.lit(kind), F.lit(answer), F.lit(grounded), F.expr(sources), F.lit(intent), F.array(*[F.lit("o")] * options)).alias("f")).first()
        assert row.f == fault


def test_error_text(spark):
    df = spark.createDataFrame([('{"detail": "다시 시도하세요"}', "application/json"), ("다시 시도", "text/plain"), ("다시 시도", "application/json"), ('{"detail": "Traceback 오류"}', "application/json"), ("[1]", "application/json")], "b string, c string")
    assert [r.m for r in df.select(contract.error_text(F.col("b"), F.col("c"), "f").alias("m")).collect()] == ["다시 시도하세요", "다시 시도", "f", "f", "f"]
