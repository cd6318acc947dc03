"""Checks of answers against expected results, and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKS = ("topic_match", "grounded_match", "latest_only_match", "source_title_match")


#: Fixed value: what a case's id looks like.
CASE_ID = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def faulty_cases(cases: DataFrame) -> DataFrame:
    """Cases (id, question, expected_grounded, expected_titles) that break a rule, with the rule."""
    counted = cases.groupBy("id").agg(F.count("*").alias("n"))
    rule = (
        F.when(~F.col("id").rlike(CASE_ID), "id").when(F.col("n") > 1, "repeated_id")
        .when(~F.length("question").between(2, 500), "question").when(~F.col("expected_grounded") & (F.size("expected_titles") > 0), "titles")
    )
    return cases.join(counted, "id").withColumn("rule", rule).where("rule IS NOT NULL").select("id", "rule")


def grounded_match(expected: Column, actual: Column, n_sources: Column) -> Column:
    return (expected == actual) & (actual == (n_sources > 0))


def latest_only_match(asked: Column, grounded: Column, urls: Column, allowed: Column) -> Column:
    """Null if not asked; all addresses are allowed ones, and an answer that should be grounded has some."""
    return F.when(asked, (F.size(F.array_except(urls, allowed)) == 0) & ~(grounded & (F.size(urls) == 0)))


def source_title_match(fragments: Column, titles: Column) -> Column:
    """Null without fragments; every fragment is in some title."""
    return F.when(F.size(fragments) > 0, F.forall(fragments, lambda f: F.exists(titles, lambda t: F.contains(t, f))))


def intent_match(expected: Column, sources: Column) -> Column:
    """Null without an expected intent; every source's intent is the expected one, and there is a source."""
    return F.when(expected.isNotNull(), (F.size(sources) > 0) & F.forall(sources, lambda s: s.eqNullSafe(expected)))


def passed() -> Column:
    """Whether no check failed; checks that do not apply are null."""
    return F.least(*[F.coalesce(F.col(c), F.lit(True)) for c in CHECKS])


def metrics(results: DataFrame, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """(metric, passed, total, rate) of each check, over the rows to which it applies."""
    one = results.agg(*[f(c).alias(f"{c}_{n}") for c in checks for n, f in (("p", lambda c: F.count_if(F.col(c))), ("t", lambda c: F.count(c)))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_p").alias("passed"), F.col(f"{c}_t").alias("total")) for c in checks]))
    return one.select(rows.alias("m")).select("m.*", F.round(F.try_divide("m.passed", "m.total"), 4).alias("rate"))


def summary(results: DataFrame) -> DataFrame:
    """(total, passed, failed) over all cases; `results` has the column `passed`."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def exit_code(total: int, failed: int) -> int:
    """0 if all passed, 1 if some failed, 2 if nothing ran."""
    return 2 if not total else 1 if failed else 0


def report(summary: list[tuple[str, int, int, float | None]], title: str) -> str:
    """The rates as a Markdown table."""
    rows = [f"| {m} | {p} | {t} | {'-' if r is None else f'{r:.2%}'} |" for m, p, t, r in summary]
    return "\n".join([f"# {title}", "", "| metric | passed | total | rate |", "| --- | --- | --- | --- |", *rows, ""])
