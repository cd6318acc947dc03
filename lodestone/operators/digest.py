"""A content fingerprint of a whole table: an order-independent tree of digests.

A row's digest is SHA-256 of its fields as one JSON object, sorted by name. Rows fall into ranges by the first digits of
their digests; a range's digest covers its rows' digests in order, a group's digest its ranges', the root's its groups'. So
the root depends on the rows alone, repeated rows count, and two tables are compared range by range without reading both.
With four digits a leaf holds a 65,536th of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(*fields: str) -> Column:
    """SHA-256 of the fields as a JSON object in order of their names, nulls included; times in UTC."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false", "timeZone": "UTC"}).cast("binary"), 256)


def _over(digests: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(digests), "").cast("binary"), 256)


def leaves(rows: DataFrame, digits: int = 4, digest: Column | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """([key,] range, rows, digest): a row for each range of digests that is not empty; `digest` defaults to all columns'.
    With `key` every value of these columns is a table of its own."""
    d = rows.select(*key, (row_digest(*rows.columns) if digest is None else digest).alias("_d"))
    return d.groupBy(*key, F.substring("_d", 1, digits).alias("range")).agg(F.count("*").alias("rows"), _over(F.collect_list("_d")).alias("digest"))


def tree(found: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """([key,] level, range, rows, digest) of `leaves`: the ranges (2), their groups by the first half of the digits (1),
    and the root (0), which an empty table has as well if there is no key."""
    half = F.expr("substring(range, 1, greatest(1, length(range) DIV 2))")

    def up(df: DataFrame, by: Column | None) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda r: r["digest"])
        grouped = df.groupBy(*key, *([] if by is None else [by.alias("_up")]))
        out = grouped.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.array_join(parts, "").cast("binary"), 256).alias("digest"))
        return out.select(*key, (F.lit("") if by is None else F.col("_up")).alias("range"), "rows", "digest")

    groups = up(found, half)
    level = lambda df, n: df.select(*key, F.lit(n).alias("level"), "range", "rows", "digest")
    return level(found, 2).unionByName(level(groups, 1)).unionByName(level(up(groups, None), 0))


def root(rows: DataFrame, digits: int = 4) -> tuple[str, int]:
    """(digest, rows) of a whole table."""
    r = tree(leaves(rows, digits)).where("level = 0").first()
    return r["digest"], r["rows"]


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(range, rows_a, rows_b) of the ranges in which two tables' `leaves` differ."""
    x, y = a.select("range", F.col("rows").alias("rows_a"), F.col("digest").alias("_a")), b.select("range", F.col("rows").alias("rows_b"), F.col("digest").alias("_b"))
    both = x.join(y, "range", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("range", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"))
