"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import embdup, lm, mixing, packing, pii, quality, simhash, substring, topk, toxicity
from lodestone.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta. " * 4000
ROWS = [
    (0, "one two three four five six. seven eight nine ten eleven", "en", "a", 10),
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, "text without a number, mail a@b.cc", "en", None, 5),
    (3, LONG, "en", "b", len(LONG)),
    (0, "one two three four five six. seven eight nine ten eleven", "en", "a", 10),
    (4, "one two three four five six. seven eight nine ten eleven", "en", "a", 10),
    (5, " \t\n ", "de", "c", 4),
    (None, None, None, None, None),
]
#: Names that operators use inside.
CLASHING = ("key", "_row", "_text", "spans", "_spans", "fp", "node", "score", "t", "h1", "chunk", "sid", "taken", "ids", "_key", "_id", "_fp", "y", "_clean", "nth", "size", "a.b", "c`d")


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (2, 0, 1), (3, 1, 0), (4, None, None), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "packing": lambda s, d: packing.pack(d, tokenizer_path()),
    "lm": lambda s, d: lm.score(d),
    "quality": lambda s, d: quality.score(d, quality.fit(d, labels(s))),
    "pii": lambda s, d: pii.digest(pii.scan(d)),
    "mixing": lambda s, d: mixing.mix(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "substring": lambda s, d: substring.dedup(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
}
STAGES = {
    "clean": lambda s, d: toxicity.clean(d, toxicity.fit(d, labels(s))),
    "keep_one": lambda s, d: simhash.keep_one(d),
    "redact": lambda s, d: pii.redact(d),
    "mixed": lambda s, d: mixing.mixed_documents(d),
}


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, clashing(spark.createDataFrame(ROWS, DOCS)))
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 5, None}
    else:
        assert len(rows) == len(ROWS)
        same = [r.asDict() for r in rows if r.doc_id == 0]
        assert name == "mixing" or same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    docs = clashing(spark.createDataFrame(ROWS, DOCS))
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns
    assert out.count() > 0
    assert STAGES[name](spark, spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one_keeps_one_of_each_group(spark):
    got = simhash.keep_one(spark.createDataFrame(ROWS, DOCS)).select("doc_id", "text").collect()
    ids = [r.doc_id for r in got]
    assert ids.count(0) == 1 and 4 not in ids and 3 in ids
    assert sorted(i for i in ids if i is not None) == [0, 1, 3]  # 1, 2, 5 and the null text have no words


def test_rows_of_one_id_do_not_take_each_others_place(spark):
    a, b = "one two three four five six", "entirely other words stand in this text here"
    got = simhash.keep_one(spark.createDataFrame([(5, b), (5, a), (3, b), (7, a), (7, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, b), (5, a)]
    same = simhash.keep_one(spark.createDataFrame([(5, a), (5, a), (None, b), (None, b)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.text) for r in same) == [(False, a), (True, b)]


VECTORS = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.0, 0.0]), (7, []), (100, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [2.0, 0.01]), (9, [1.0])]


def test_vectors(spark):
    df = clashing(spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")).withColumn("label", F.lit(1))
    top = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert top[:3] == [(0, 1, 8, 2048 * 1024), (0, 2, 9, 1024 * 1024), (0, 3, 100, 1024 * 1024)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdup.near_duplicates(df).collect()}
    assert got[0] == (5, 0, True) and got[8] == (5, 0, False) and got[9] == (5, 0, False)
    assert got[1] == (0, 1, True)
    assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 7))
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert embdup.near_duplicates(empty).count() == 0


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
