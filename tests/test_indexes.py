"""Stored indexes: the partition index of vectors and the inverted index, against the searches without them."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.vector import cosine_distance
from lodestone.operators import inverted, ivf, lexical, search
from lodestone.sources.shared import shared_folder


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in middles[i % 30] + 0.4 * rng.normal(size=16)], "ab"[i % 7 == 0], "text") for i in range(3000)]
    rows += [(5000, None, "a", ""), (5001, [0.0] * 16, "a", ""), (5002, [1.0], "b", ""), (5003, [None] * 16, "a", ""), (5004, rows[3][1], "a", "")]
    return spark.createDataFrame(rows, "id long, embedding array<double>, category string, text string")


@pytest.fixture(scope="module")
def index(spark, vectors):
    return ivf.build(vectors, shared_folder(spark, "ivf"), cells=40, sample=1000, files=2)


@pytest.fixture(scope="module")
def questions(vectors):
    return vectors.where("id % 100 = 3 AND id < 3000").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"), "category")


def rows_of(df):
    return sorted((r.qid, r["rank"], r.id, None if r.distance is None else round(r.distance, 9)) for r in df.collect())


def test_partition_index_holds_every_row(spark, vectors, index):
    stored = spark.read.parquet(f"{index.path}/rows")
    assert stored.count() == vectors.count() and index.rows.sum() == vectors.count() - 4
    assert stored.where("cell = -1").count() == 4


def test_probing_finds_most_rows(spark, vectors, index, questions):
    truth = search.nearest_of_each(vectors, questions, 10)
    found = ivf.search(spark, index, questions, 10, probe=6)
    assert ivf.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.95
    assert ivf.search(spark, index, questions, 10, probe=1).count() <= truth.count()


def test_probing_reads_folders_of_its_cells(spark, index, questions):
    plan = ivf.search(spark, index, questions.limit(1), 5, probe=2)._jdf.queryExecution().toString()
    filters = plan[plan.rindex("PartitionFilters") :].split("]")[0]
    assert "cell" in filters


@pytest.mark.parametrize("by_category", [False, True])
def test_exact_search_equals_brute_force(spark, vectors, index, questions, by_category):
    for some, limit in ((questions, 7), (questions.limit(2), 4000)):
        got = ivf.search(spark, index, some, limit, probe=2, exact=True, by_category=by_category, block=8)
        assert rows_of(got) == rows_of(search.nearest_of_each(vectors, some, limit, by_category))


def test_index_without_vectors(spark, vectors):
    with pytest.raises(ValueError):
        ivf.build(vectors.limit(0), shared_folder(spark, "ivf"))


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


@pytest.mark.parametrize("grams", [False, True])
def test_inverted_index_equals_bm25(spark, grams):
    rng = np.random.default_rng(9)
    texts = [(i, " ".join(rng.choice(WORDS, int(rng.integers(1, 30)), p=np.array([55, 38, 27, 18, 13, 9, 6, 4, 2, 1]) / 173))) for i in range(600)]
    chunks = spark.createDataFrame([*texts, (900, ""), (901, None), (902, texts[5][1]), (903, "Kappa KAPPA")], "id long, text string")
    asked = spark.createDataFrame([(0, "alpha kappa"), (1, "beta beta eta iota"), (2, "unknown"), (3, ""), (4, "alpha"), (5, "theta kappa unknown alpha beta")], "qid int, text string")
    index = inverted.build(chunks, shared_folder(spark, "bm25"), grams, block=16, salt_rows=200, buckets=8)
    got = [tuple(r) for r in inverted.search(spark, index, asked, 10, block=4).select("qid", "rank", "id", "score").orderBy("qid", "rank").collect()]
    known = chunks.withColumn("text", F.coalesce("text", F.lit("")))
    assert got == [tuple(r) for r in lexical.bm25(known, asked, 10, grams).select("qid", "rank", "id", "score").orderBy("qid", "rank").collect()]
    if not grams:
        skipped = {r.qid: (r.blocks, r.live) for r in inverted.blocks_read(spark, index, asked).collect()}
        assert skipped[0][1] < skipped[0][0]


def test_inverted_index_does_not_shuffle_entries_to_join_them(spark):
    """However large its tables are, a search keeps the lists of entries in the tasks that read them."""
    chunks = spark.createDataFrame([(i, f"{WORDS[i % 10]} {WORDS[i % 3]} alpha") for i in range(300)], "id long, text string")
    asked = spark.createDataFrame([(0, "alpha kappa"), (1, "beta eta")], "qid int, text string")
    index = inverted.build(chunks, shared_folder(spark, "bm25"), block=16, salt_rows=200, buckets=2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = inverted.search(spark, index, asked, 10)
        got = [tuple(r) for r in found.select("qid", "rank", "id", "score").orderBy("qid", "rank").collect()]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [x for x in plan.splitlines() if "SortMergeJoin [bucket" in x]
    assert got == [tuple(r) for r in lexical.bm25(chunks, asked, 10).select("qid", "rank", "id", "score").orderBy("qid", "rank").collect()]


def test_inverted_index_of_an_empty_table(spark):
    index = inverted.build(spark.createDataFrame([], "id long, text string"), shared_folder(spark, "bm25"))
    assert index.n == 0
    assert inverted.search(spark, index, spark.createDataFrame([(0, "a")], "qid int, text string")).count() == 0


def test_batched_search_keeps_ties_copies_and_odd_vectors(spark):
    """Against every pair's distance by the expression: copies tie by id, NaN comes after numbers and null last."""
    rng = np.random.default_rng(4)
    base = [[float(x) for x in v] for v in rng.normal(size=(12, 4))]
    odd = [None, [0.0] * 4, [1.0], [float("nan")] * 4, [None, 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0]]
    rows = spark.createDataFrame([(i, base[i % 12], "ab"[i % 2]) for i in range(60)] + [(100 + i, v, "a") for i, v in enumerate(odd)] + [(200, base[0], None)], "id int, embedding array<double>, category string")
    asked = spark.createDataFrame([(f"q{i}", v, "a") for i, v in enumerate([base[0], base[5], *odd])] + [("n", base[1], None)], "qid string, vector array<double>, category string")
    for n, by_category in ((7, False), (63, False), (500, False), (4, True)):
        pairs = rows.crossJoin(asked.withColumnRenamed("category", "wanted")).where(F.col("category") == F.col("wanted") if by_category else F.lit(True))
        pairs = pairs.withColumn("distance", cosine_distance(F.col("embedding"), F.col("vector")))
        want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "id"))).where(F.col("rank") <= n)
        of = lambda df: sorted((r.qid, r["rank"], r.id, str(r.distance)) for r in df.collect())
        assert of(search.nearest_of_each(rows, asked, n, by_category)) == of(want)


def test_batched_search_computes_few_distances_row_by_row(spark, vectors, questions):
    """Vectors meet in products of matrices; the expression sees only what they find."""
    plan = search.nearest_of_each(vectors, questions, 10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
