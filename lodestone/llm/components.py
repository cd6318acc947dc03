"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import checkpoint


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); a component is named by its smallest node.

    Links stay distributed: each step replaces every link by one to the smallest neighbour and is written to the
    shared checkpoint folder. Only a count and a digest reach the driver, to see that nothing changes any more.
    Nulls, self-links and repeated links add nothing; an empty table gives an empty table.
    """
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table of its own, dealt anew, so that the skew join splits the links of a large group's centre.
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def named_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component, component_id) for every class (node long, rep long): the smallest `rep` of the classes that
    links join. `component` tells components apart, also those whose `rep` is the same or null.

    Both sides of the last join are tables of their own, dealt anew, so that the skew join splits a large component.
    """
    found = connected_components(links)
    named = checkpoint(classes.join(found.hint("merge"), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")))
    ids = checkpoint(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    return named.join(ids.hint("merge"), "component").select("node", "component", "component_id")
