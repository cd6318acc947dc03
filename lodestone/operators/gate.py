"""Which candidates may support an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import compact, term, tokens, year
from lodestone.operators.classify import Catalog

#: Words that name a term and distinguish nothing.
TERM_WORDS = ("학년도", "학기", "여름계절", "겨울계절")
#: Fixed value: what a rewritten query ends with.
OFFICIAL = "공식 공지"


def score_gate(candidates: DataFrame, least: float = 0.10, share: float = 0.75) -> DataFrame:
    """Candidates (qid, score) of at least `least` and at least `share` of their question's best."""
    best = F.max("score").over(Window.partitionBy("qid"))
    return candidates.where(F.col("score") >= least).withColumn("_best", best).where(F.col("score") >= share * F.col("_best")).drop("_best")


def relevance(conflict: Column, temporal: Column, title_marker: Column, body_marker: Column, signals: Column, lexical_rank: Column) -> Column:
    """relevant, ambiguous or irrelevant."""
    return (
        F.when(conflict | ~temporal, "irrelevant").when((title_marker | body_marker) & (signals >= 2), "relevant")
        .when(title_marker & lexical_rank.isNotNull(), "relevant").otherwise("ambiguous")
    )


def match_terms(question: Column, catalog: Catalog) -> Column:
    """The question's words, the whole question, and every phrase of an alias group of which it has one; compact."""
    whole, out = compact(question), F.array_union(tokens(question), F.array(compact(question)))
    for group in catalog.aliases:
        phrases = F.array(*[compact(F.lit(p)) for p in group])
        out = F.array_union(out, F.when(F.exists(phrases, lambda p: F.contains(whole, p)), phrases).otherwise(F.array().cast("array<string>")))
    return out


def distinctive(question: Column, ignored: tuple[str, ...]) -> Column:
    """The question's words without ignored phrases' words, numbers and words that name a term."""
    parts = [tokens(F.lit(p)) for p in ignored] + [F.array(compact(F.lit(p))) for p in ignored] + [F.array(*map(F.lit, TERM_WORDS))]
    drop = F.concat(*parts)
    return F.filter(F.array_except(F.array_distinct(tokens(question)), drop), lambda w: ~w.rlike("^[0-9]+$"))


def evidence(question: Column, title: Column, general: Column, recency: Column, matched: Column, distinct: Column, markers: Column) -> Column:
    """The reason for which a title is accepted or rejected as evidence for a question.

    `matched` and `distinct` are the question's match terms and distinctive words, `markers` the topic's markers.
    """
    flat = compact(title)
    marker_hit = F.exists(F.transform(markers, compact), lambda m: (m != "") & F.contains(flat, m) & F.exists(matched, lambda t: (F.length(t) >= 2) & (F.contains(t, m) | F.contains(m, t))))
    over = F.filter(distinct, lambda t: (F.length(t) >= 2) & F.contains(flat, compact(t)))
    return (
        F.when(year(question).isNotNull() & year(title).isNull(), "missing_temporal_evidence").when(year(question) != year(title), "year_mismatch")
        .when(term(question).isNotNull() & term(title).isNull(), "missing_temporal_evidence").when(term(question) != term(title), "semester_mismatch")
        .when(general & recency, "accepted_general_latest").when(marker_hit, "accepted_topic_marker")
        .when((F.size(over) >= 2) | F.exists(over, lambda t: F.length(compact(t)) >= 5), "accepted_title_overlap").otherwise("insufficient_title_evidence")
    )


def query_variants(question: Column, label: Column, example: Column) -> Column:
    """The question, its rewriting by year, term and intent, and a made-up notice; distinct, in this order."""
    plain = F.concat_ws(" ", year(question).cast("string"), term(question), label, F.lit(OFFICIAL))
    return F.array_distinct(F.array(question, plain, F.concat(F.lit("제목: "), plain, F.lit("\n본문: "), example)))


def supported_newest(freshest: DataFrame) -> DataFrame:
    """Only questions whose newest document is itself relevant; an older one never takes its place."""
    return freshest.where("relevance = 'relevant'")


def asks_for_recent(question: Column, catalog: Catalog) -> Column:
    """Whether a question has one of the catalog's words for recent."""
    whole = compact(question)
    return F.exists(F.array(*[compact(F.lit(t)) for t in catalog.recency]).cast("array<string>"), lambda t: F.contains(whole, t))


def intent_conflict(asked: Column, intent: Column, title: Column, catalog: Catalog) -> Column:
    """Whether a candidate's intent is another than the asked one (null conflicts with none), or its title has a marker
    that the asked intent excludes."""
    flat = compact(title)
    out = F.coalesce(asked != intent, F.lit(False))
    for rule in (i for some in catalog.intents.values() for i in some if i.exclusion_markers):
        hit = F.exists(F.array(*[compact(F.lit(m)) for m in rule.exclusion_markers]), lambda m: F.contains(flat, m))
        out = out | (F.coalesce(asked == rule.key, F.lit(False)) & F.coalesce(hit, F.lit(False)))
    return out


def supports(distinct: Column, title: Column, text: Column) -> Column:
    """Whether a document says one of the words that distinguish a question, if it has any."""
    flat = F.concat(compact(title), F.lit(" "), compact(text))
    return (F.size(distinct) == 0) | F.exists(distinct, lambda t: F.contains(flat, t))
