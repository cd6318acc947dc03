"""Fusing two rankings, and reranking by title evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lexical import bm25, wide
from lodestone.operators.search import nearest_of_each

RRF_K = 60


def rrf(lexical: DataFrame, dense: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, id, lexical_rank, dense_rank, fused, signals, place): sums of 1 / (k + rank) over both rankings."""
    a = lexical.select("qid", "id", F.col("rank").alias("lexical_rank"))
    b = dense.select("qid", "id", F.col("rank").alias("dense_rank"))
    both = a.join(b, ["qid", "id"], "full_outer")
    fused = fused_score(F.col("lexical_rank"), F.col("dense_rank"), k)
    signals = F.col("lexical_rank").isNotNull().cast("int") + F.col("dense_rank").isNotNull().cast("int")
    by = Window.partitionBy("qid").orderBy(F.desc(F.round("fused", 12)), "id")
    return both.withColumn("fused", fused).withColumn("signals", signals).withColumn("place", F.row_number().over(by))


def fused_score(lexical_rank: Column, dense_rank: Column, k: int = RRF_K) -> Column:
    part = lambda r: F.coalesce(F.lit(1.0) / (k + r), F.lit(0.0))
    return part(lexical_rank) + part(dense_rank)


def forged(claimed: Column, lexical_rank: Column, dense_rank: Column, k: int = RRF_K) -> Column:
    """Whether a claimed score is not the one that its ranks give."""
    return claimed.isNull() | F.isnan(claimed) | (F.abs(claimed - fused_score(lexical_rank, dense_rank, k)) > 1e-12)


def inconsistent(*paths: DataFrame) -> DataFrame:
    """Ids whose rows (id, meta) differ between retrieval paths; a null on one and a value on another differ, too."""
    rows = paths[0]
    for p in paths[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("id").agg(F.count_distinct(F.struct("meta")).alias("versions")).where("versions > 1").select("id", "versions")


def consistent(*paths: DataFrame) -> DataFrame:
    """(id, meta) of all retrieval paths, one row an id. Ids whose rows differ between paths end the job (fail closed)."""
    rows = paths[0]
    for p in paths[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy("id").agg(F.count_distinct(F.struct("meta")).alias("_n"), F.any_value("meta").alias("meta"))
    fault = F.raise_error(F.concat(F.lit("metadata differ between retrieval paths: "), F.col("id").cast("string")))
    return one.select("id", F.when(F.col("_n") == 1, F.col("meta")).otherwise(fault).alias("meta"))


def reranked(candidates: DataFrame) -> DataFrame:
    """Candidates (qid, id, score, title_marker, body_marker, temporal, conflict, published) with `place`: those without a
    conflict first, then a title's marker, a body's marker, the right time, the score, and the date only between equals."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    order = [flag("conflict"), *[~flag(c) for c in ("title_marker", "body_marker", "temporal")], F.desc("score"), F.col("published").desc_nulls_last(), F.col("id")]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def title_boost(score: Column, distinct_hits: Column, policy_hits: Column) -> Column:
    """A score raised by title hits: 0.08 for each distinctive word, 0.12 for each policy phrase up to 0.24; 1 at most."""
    return F.least(F.lit(1.0), score + 0.08 * distinct_hits + F.least(F.lit(0.24), 0.12 * policy_hits))


def hits(words: Column, title: Column, least: int = 1) -> Column:
    """How many of the words the title contains; both compact."""
    return F.size(F.filter(words, lambda w: (F.length(w) >= least) & (F.length(w) <= F.length(title)) & F.contains(title, w)))


def hybrid(chunks: DataFrame, asked: DataFrame, collection: DataFrame, questions: DataFrame, top_k: int = 10) -> DataFrame:
    """The `top_k` best rows of `rrf` for each question, of the `wide(top_k)` best of either retriever.

    `chunks` (id, text) and `asked` (qid, text) are matched by words and 2 to 4 character runs, `collection` and
    `questions` (qid, vector) by `nearest_of_each`.
    """
    many = wide(top_k)
    found = rrf(bm25(chunks, asked, many, grams=True, score_digits=6), nearest_of_each(collection, questions, many))
    return found.where(F.col("place") <= top_k)
