"""The whole way from both retrievers' candidates to what may support an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import compact
from lodestone.operators import compress, freshness, fusion, gate
from lodestone.operators.classify import Catalog
from lodestone.operators.search import blocks_of
from lodestone.sources.shared import shared_folder


def _with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """`df` with the columns that it lacks."""
    return df.select("*", *[c.alias(n) for n, c in defaults.items() if n not in df.columns])


def _stored(df: DataFrame, kind: str) -> DataFrame:
    """A table that several steps read, written once."""
    df.write.parquet(folder := shared_folder(df.sparkSession, kind))
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def named_rows(rows: DataFrame, ids: DataFrame, block: int = 1 << 17) -> DataFrame:
    """The rows (id, ...) with an id of `ids` (id, distinct, stored).

    Ids go in blocks of about `block`, which the tasks get, so that no other row is shuffled, however long its text is."""
    count, out = blocks_of(ids, block), None
    for k in range(count):
        some = ids.where(F.pmod(F.xxhash64("id"), F.lit(count)) == k) if count > 1 else ids
        found = rows.join(F.broadcast(some), "id", "left_semi")  # a block of ids
        out = found if out is None else out.unionByName(found)
    return out


def judged(fused: DataFrame, chunks: DataFrame, asked: DataFrame, catalog: Catalog) -> DataFrame:
    """Candidates with `score` (a fused score as its share of the best possible one, raised by title hits) and `relevance`.

    A candidate is irrelevant if its intent or its title conflicts with the asked intent, or its time with the asked time.
    """
    asked = _with_defaults(asked, intent=F.lit(None).cast("string"), recency=gate.asks_for_recent(F.col("text"), catalog))
    q = asked.select("qid", F.col("text").alias("question"), "general", F.col("intent").alias("asked_intent"), F.coalesce("recency", F.lit(False)).alias("recency"))
    rows = fused.select("qid", "id", "fused", "signals", "lexical_rank").join(_with_defaults(chunks, document_type=F.lit("notice")), "id").join(q, "qid")
    rows = rows.withColumn("terms", gate.match_terms(F.col("question"), catalog)).withColumn("distinct", gate.distinctive(F.col("question"), (*catalog.recency, *catalog.generic)))
    title = compact(F.col("title"))
    best = 2.0 / (fusion.RRF_K + 1)
    rows = rows.withColumn("score", fusion.title_boost(F.col("fused") / best, fusion.hits(F.col("distinct"), title, 4), fusion.hits(F.col("terms"), title, 2)))
    markers = F.array(*[F.lit(m) for r in catalog.rules for m in r.evidence_markers]).cast("array<string>")
    reason = gate.evidence(F.col("question"), F.col("title"), F.col("general"), F.col("recency"), F.col("terms"), F.col("distinct"), markers)
    in_body = F.exists("distinct", lambda t: F.contains(compact(F.col("text")), t))
    rows = rows.withColumn("reason", reason)
    temporal = ~F.col("reason").isin("missing_temporal_evidence", "year_mismatch", "semester_mismatch")
    conflict = gate.intent_conflict(F.col("asked_intent"), F.col("intent"), F.col("title"), catalog)
    return rows.withColumn("relevance", gate.relevance(conflict, temporal, F.col("reason").startswith("accepted"), in_body, F.col("signals"), F.col("lexical_rank")))


def supported(fused: DataFrame, chunks: DataFrame, asked: DataFrame, catalog: Catalog, least: float = 0.10, share: float = 0.75) -> DataFrame:
    """(qid, intent, id, url, score, relevance, evidence, context): of each question and intent the freshest notice
    (`newest`), and the static and historical pages that a question which is not for recent ones may refer to (`reference`).

    `fused` is `fusion.rrf`'s result, `chunks` has (id, text, title, url, published, intent[, document_type]), `asked`
    (qid, text, general[, intent, recency]). In this order: only relevant candidates go on, the score gate, one chunk for
    each page, the freshest notice of each intent (undated ones only where recency is not asked for), and for general
    questions the test whether that notice itself says what was asked. An older one never takes its place. Contexts are
    compressed to the sentences that the question's words occur in.

    Candidates and pages are written once below the shared folder; of `chunks` only the rows of candidates leave their task.
    """
    fused = _stored(fused.select("qid", "id", "fused", "signals", "lexical_rank"), "fused")
    chunks = named_rows(chunks, _stored(fused.select("id").distinct(), "ids"))
    relevant = judged(fused, chunks, asked, catalog).where("relevance = 'relevant'")
    kept = gate.score_gate(relevant, least, share)
    pages = _stored(freshness.best_per_url(kept.select("qid", "id", "url", "intent", "published", "score", "relevance", "title", "text", "terms", "distinct", "general", "recency", "document_type")), "pages")
    newest = freshness.freshest_per_intent(pages).where(~F.col("general") | gate.supports(F.col("distinct"), F.col("title"), F.col("text"))).withColumn("evidence", F.lit("newest"))
    reference = pages.where(~freshness.competes(F.col("document_type")) & ~F.col("recency")).withColumn("evidence", F.lit("reference"))
    return compress.compressed(newest.unionByName(reference)).select("qid", "intent", "id", "url", "score", "relevance", "evidence", "context")
