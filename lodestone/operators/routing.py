"""Category-routed search: probe, vote, second search, fallback, and the answer's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import bullets
from lodestone.operators.search import PROBE_K, TOP_K, checked, nearest_of_each, places
from lodestone.sources.shared import shared_folder

#: Fixed values of answers.
NO_ANSWER = "Chroma 데이터에서 질문과 관련된 안내를 찾지 못했습니다."
NO_DATE = "알 수 없음"


def vote(candidates: DataFrame) -> DataFrame:
    """(qid, category, votes, first): each category's sum of max(score, 0.01) / place; rows without one do not vote."""
    share = F.greatest(F.col("score"), F.lit(0.01)) / F.col("place")
    return candidates.where("category IS NOT NULL").groupBy("qid", "category").agg(F.sum(share).alias("votes"), F.min("place").alias("first"))


def elected(votes: DataFrame) -> DataFrame:
    """(qid, category) with the most votes; of equals the one seen first."""
    by = Window.partitionBy("qid").orderBy(F.desc(F.round("votes", 12)), "first")
    return votes.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("qid", "category")


def _stored(df: DataFrame, kind: str) -> DataFrame:
    """A table that several steps read, written once."""
    df.write.parquet(folder := shared_folder(df.sparkSession, kind))
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def routed(collection: DataFrame, questions: DataFrame, top_k: int = TOP_K, probe_k: int = PROBE_K) -> DataFrame:
    """Rows found for each question (qid, vector, explicit): qid, stage, place and the checked row.

    A question with an explicit category is searched in it. Others probe all rows, vote, and search the elected
    category; without one they keep the probe's first rows. A question left with nothing falls back: to the probe's first
    rows if it probed, and after an explicit category to an unfiltered search of `top_k` rows, of which those that fail
    the checks are not replaced.
    """
    asked = questions.select("qid", "vector", "explicit")
    probe = _stored(places(checked(nearest_of_each(collection, asked, probe_k)), "qid"), "probe")
    chosen = asked.join(elected(vote(probe.where("explicit IS NULL"))), "qid", "left")
    chosen = _stored(chosen.select("qid", "vector", F.coalesce("explicit", "category").alias("category")), "chosen")
    second = places(checked(nearest_of_each(collection, chosen.where("category IS NOT NULL"), top_k, by_category=True)), "qid")
    first = probe.where(F.when(F.col("explicit").isNull(), F.col("place")).otherwise(F.col("rank")) <= top_k).drop("explicit")
    both = second.withColumn("stage", F.lit(1)).unionByName(first.withColumn("stage", F.lit(2)))
    best = both.withColumn("_stage", F.min("stage").over(Window.partitionBy("qid")))
    return best.where("stage = _stage").drop("_stage")


def answers(questions: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each question: response_type, grounded, n_sources, sources in order, and the context to answer from."""
    item = F.struct("place", "title", "url", "source", "published_at", "score", "text")
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = questions.select("qid").join(lists, "qid", "left")
    items = F.coalesce("items", F.array().cast(lists.schema["items"].dataType))
    return out.select(
        "qid",
        F.when(F.size(items) > 0, "answer").otherwise("no_answer").alias("response_type"),
        (F.size(items) > 0).alias("grounded"),
        F.size(items).alias("n_sources"),
        context(items).alias("context"),
        F.transform(items, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["source"].alias("source"), x["published_at"].alias("published_at"), x["score"].alias("score"))).alias("sources"),
    )


def context(items):
    """Numbered blocks of title, date and text, joined by blank lines; `items` is an array of structs in order."""
    block = lambda x, i: F.concat(F.lit("[자료 "), (i + 1).cast("string"), F.lit("]\n제목: "), x["title"], F.lit("\n게시일: "), F.coalesce(x["published_at"], F.lit(NO_DATE)), F.lit("\n내용:\n"), x["text"])
    return F.array_join(F.transform(items, block), "\n\n")


def respond(answered: DataFrame, write) -> DataFrame:
    """The answers' texts: `write` gives a text column from the context column; without sources it is not used."""
    return answered.withColumn("answer", F.when(F.col("grounded"), bullets(write(F.col("context")))).otherwise(F.lit(NO_ANSWER)))
