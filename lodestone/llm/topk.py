"""Exact top-k inner products by multi-resolution segment statistics.

For a segmentation of the components, with m and s a segment's mean and standard deviation and w its width,
    distance(q, c)^2 >= sum over segments of w * ((m_q - m_c)^2 + (s_q - s_c)^2),
and the inner product is (|q|^2 + |c|^2 - distance^2) / 2, so that a lower bound of the distance is an upper bound of the
score. Bounds go from coarse to fine segments; candidates whose bound is below a query's k-th best exact score so far are
dropped at each level, and only survivors are scored exactly, in integers.

Queries and candidates meet in a grid of bounded blocks (candidate block i, query block j): a cell keeps k rows for each of
its queries, and the cells' rows are ranked by a window with a limit. No side is broadcast or collected.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
an empty vector is the zero vector, and shorter vectors count as if they ended in zeros; a query's own id is no candidate,
repeated candidate rows are candidates each, repeated query ids count once (their smallest vector); an empty table gives
no rows; other columns are ignored. Scores beyond a long's range stop at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Segments at each level, coarse to fine.
LEVELS = (2, 8, 32)
_LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def _floored(x: Column) -> Column:
    """Floor of a double, as a double; those of 2^53 and more are whole already."""
    return F.when(F.abs(x) < 2.0**53, F.floor(F.when(F.abs(x) < 2.0**53, x).otherwise(0.0)).cast("double")).otherwise(x)


def _statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(width) times each segment's mean and standard deviation: their products bound the inner product."""
    parts = np.array_split(v, min(segments, max(1, v.shape[1])), axis=1)
    cols = [np.sqrt(p.shape[1]) * f(p, axis=1) for p in parts for f in (np.mean, np.std)]
    return np.stack(cols, axis=1) if v.shape[1] else np.zeros((len(v), 2))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of one vector with many, as floats that are whole if small enough, else Python integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, len(q))
    if most < 2**52:
        return c @ q
    big = np.array([[int(x) for x in row] for row in c.tolist()], dtype=object).reshape(len(c), -1) @ np.array([int(x) for x in q.tolist()], dtype=object)
    return np.array([max(-_LONG - 1, min(_LONG, x)) for x in np.atleast_1d(big)], dtype=object)


def cell_top_k(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """For each query its candidates' ids and scores, the k best by score and then smaller id, of one block."""
    stats = [(_statistics(q, s), _statistics(c, s)) for s in LEVELS]
    norm_q, norm_c = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    for i in range(len(q)):
        slack = 1e-9 * norm_q[i] * norm_c + 1e-6
        rest = np.flatnonzero(c_ids != q_ids[i])
        best, at = float("-inf"), 0
        for sq, sc in stats:
            bound = sc[rest] @ sq[i] + slack[rest]
            if len(rest) > k:
                first = rest[np.argpartition(-bound, k - 1)[:k]]
                best = max(best, float(min(_exact(q[i], c[first]))))
                rest = rest[bound >= best]
        scores = _exact(q[i], c[rest])
        if scores.dtype == object:
            order = sorted(range(len(rest)), key=lambda j: (-scores[j], c_ids[rest[j]]))[:k]
        else:
            order = np.lexsort((c_ids[rest], -scores))[:k]
        yield i, c_ids[rest[order]], [int(scores[j]) for j in order]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, query_block: int = 2048, candidate_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates of `vectors` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: _floored(x * float(scale))).alias("v"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_c, n_q = rows.count(), queries.count()
    i_blocks, j_blocks = max(1, -(-n_c // candidate_block)), max(1, -(-n_q // query_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", deal(i_blocks).alias("i"), F.lit(False).alias("is_query")).select("*", every(j_blocks).alias("j"))
    right = queries.select("vec_id", "v", deal(j_blocks).alias("j"), F.lit(True).alias("is_query")).select("*", every(i_blocks).alias("i"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf.is_query], pdf[~pdf.is_query]
        width = int(pdf.v.map(len).max())
        ids = q.vec_id.to_numpy()
        out = [(ids[n], c_id, score) for n, c_ids, scores in cell_top_k(ids, _matrix(q.v, width), c.vec_id.to_numpy(), _matrix(c.v, width), k) for c_id, score in zip(c_ids, scores)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, i_blocks * j_blocks))
    cells = left.unionByName(right).repartition(parts, "i", "j").groupBy("i", "j").applyInPandas(cell, "query_id long, vec_id long, score long")
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
