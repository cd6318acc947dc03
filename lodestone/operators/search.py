"""Exact nearest neighbours with a pre-filter, and the row checks that follow the limit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rows import NO_SOURCE, NO_TITLE, has_text, has_web_address, or_default, or_null
from lodestone.functions.text import strip
from lodestone.functions.vector import as_vector, cosine_distance, score

TOP_K, PROBE_K = 5, 20
#: How far rounding may move a distance, and what stands for distances that are NaN and null: they come last, in this order.
_SLACK, _NAN, _NULL = 1e-9, 1e6, 2e6


def wanted(limit: int | None, top_k: int = TOP_K) -> int:
    """The number of rows to return: the default for none or 0; a negative limit is an error."""
    n = limit or top_k
    if n < 1:
        raise ValueError("the limit must be positive")
    return n


def nearest(collection: DataFrame, vector: Sequence[float], limit: int | None = None, category: str | None = None) -> DataFrame:
    """The nearest rows by cosine with `distance` and `rank`. The category filters before the limit, so that the plan
    pushes it to the scan; the limit is a bounded heap in each task (TakeOrderedAndProject)."""
    n = wanted(limit)
    rows = collection.where(F.col("category") == category) if category else collection
    near = rows.withColumn("distance", cosine_distance(F.col("embedding"), as_vector(vector))).orderBy(F.col("distance").asc_nulls_last(), "id").limit(n)
    by = Window.orderBy(F.col("distance").asc_nulls_last(), "id")
    return near.withColumn("rank", F.row_number().over(by))


def blocks_of(questions: DataFrame, block: int = 4096) -> int:
    """How many blocks of about `block` questions there are."""
    return max(1, -(-questions.count() // block))


def _keys(c: np.ndarray, c_odd: np.ndarray, q: np.ndarray, q_odd: np.ndarray) -> np.ndarray:
    """Distances of questions x rows as `cosine_distance` defines them, up to rounding; NaN is `_NAN`, null is `_NULL`."""
    with np.errstate(all="ignore"):
        sizes = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))[None, :]
        out = q @ c.T
        out /= sizes
        np.subtract(1, out, out=out)
    out[np.isnan(out)] = _NAN
    out[(sizes == 0) | q_odd[:, None] | c_odd[None, :]] = _NULL
    return out


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x width, and which rows are null, hold nulls or are of another width."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
    flat, out, odd = vectors.flatten(), np.zeros((len(vectors), width)), lengths != width
    values, gaps = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(vectors)), np.maximum(lengths, 0))
    odd[at[gaps]] = True
    whole = lengths == width
    out[whole] = values[whole[at]].reshape(whole.sum(), width)
    out[odd] = 0
    return out, odd


def _cell(table: pa.Table, n: int) -> pa.Table:
    """(qid, id, key) of one cell's rows that may be among the `n` nearest to its questions: the `n` first by key and id, and
    what is as near up to rounding. Of rows with the same vector the `n` smallest ids are enough."""
    asked = table.column("asked")
    q, c = table.filter(asked), table.filter(pc.invert(asked))
    out = [(q.column("qid").slice(0, 0), c.column("id").slice(0, 0), np.zeros(0))]
    if q.num_rows and c.num_rows:
        c = c.take(pc.sort_indices(c.column("id"), null_placement="at_start"))
        whole = [pa.concat_arrays(t.column("v").chunks) for t in (c, q)]
        for width in set(pc.fill_null(pc.list_value_length(whole[1]), -1).to_pylist()):
            some = np.flatnonzero(pc.fill_null(pc.list_value_length(whole[1]), -1).to_numpy() == width)
            v, v_odd = _matrix(whole[0], max(width, 0))
            w, w_odd = _matrix(whole[1].take(pa.array(some)), max(width, 0))
            _, same = np.unique(np.concatenate((v, v_odd[:, None]), axis=1).view(np.int64), axis=0, return_inverse=True)
            order = np.argsort(same, kind="stable")
            first = np.flatnonzero(np.diff(same[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
            rows = np.sort(order[place < n])
            v, v_odd = v[rows], v_odd[rows]
            step = max(1, (1 << 21) // len(rows))
            for at in range(0, len(some), step):
                keys = _keys(v, v_odd, w[at : at + step], w_odd[at : at + step])
                last = np.partition(keys, n - 1, axis=1)[:, n - 1] if len(rows) > n else np.full(len(keys), _NULL)
                keep = (keys <= last[:, None] + _SLACK) & (keys < _NAN)
                for k in np.flatnonzero(last >= _NAN):
                    keep[k, np.argsort(keys[k], kind="stable")[:n]] = True
                x, y = np.nonzero(keep)
                out.append((q.column("qid").take(pa.array(some[at + x])), c.column("id").take(pa.array(rows[y])), keys[x, y]))
    qids, ids, keys = ([o[k] for o in out] for k in range(3))
    return pa.table({"qid": pa.chunked_array([x for a in qids for x in a.chunks], qids[0].type), "id": pa.chunked_array([x for a in ids for x in a.chunks], ids[0].type), "key": np.concatenate(keys)})


def near_in_cells(rows: DataFrame, questions: DataFrame, cell: Sequence[str], n: int, row_block: int = 8192, question_block: int = 2048) -> DataFrame:
    """(qid, id): what may be among the `n` nearest rows (id, v, ...) to each question (qid, v, ...), of those rows that
    share its `cell` columns. A superset by rounding only; distances are to be computed of what is found.

    Rows and questions meet in a grid of bounded blocks, in which products of matrices give the distances; a block leaves
    about `n` rows a question. Neither side is broadcast or collected.
    """
    most = lambda df: (df.groupBy(*cell).count() if cell else df.agg(F.count("*").alias("count"))).agg(F.max("count")).first()[0] or 0
    i_blocks, j_blocks = max(1, -(-most(rows) // row_block)), max(1, -(-most(questions) // question_block))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", *cell)} | {"qid": questions.schema["qid"].dataType.simpleString()}
    v = F.col("v").cast("array<double>").alias("v")
    left = rows.select(*cell, "id", F.lit(None).cast(kinds["qid"]).alias("qid"), v, F.lit(False).alias("asked"), deal("id", i_blocks).alias("_i")).select("*", every(j_blocks).alias("_j"))
    right = questions.select(*cell, F.lit(None).cast(kinds["id"]).alias("id"), "qid", v, F.lit(True).alias("asked"), deal("qid", j_blocks).alias("_j")).select("*", every(i_blocks).alias("_i"))
    cells = left.unionByName(right).groupBy(*cell, "_i", "_j").applyInArrow(lambda t: _cell(t, n), f"qid {kinds['qid']}, id {kinds['id']}, key double")
    ranked = cells.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("key", "id")))
    last = F.max(F.when(F.col("_n") <= n, F.col("key"))).over(Window.partitionBy("qid"))
    return ranked.withColumn("_last", last).where((F.col("_n") <= n) | ((F.col("key") < _NAN) & (F.col("key") <= F.col("_last") + _SLACK))).select("qid", "id").distinct()


def nearest_of_each(collection: DataFrame, questions: DataFrame, limit: int | None = None, by_category: bool = False) -> DataFrame:
    """The nearest rows of each question (qid, vector[, category]), with `distance` and `rank`.

    Vectors meet in `near_in_cells`; other columns are joined to what it finds, of which distances are computed and ranked.
    `questions` is read several times.
    """
    n = wanted(limit)
    cell = ["_category"] if by_category else []
    some = questions.withColumnRenamed("category", "_category") if by_category else questions.drop("category")
    rows = collection.select("id", F.col("embedding").alias("v"), *([F.col("category").alias("_category")] if by_category else []))
    asked = some.select("qid", F.col("vector").alias("v"), *cell)
    if by_category:
        rows, asked = rows.where("_category IS NOT NULL"), asked.where("_category IS NOT NULL")
    near = measured(collection, some, near_in_cells(rows, asked, cell, n), by_category).drop("_category")
    by = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def measured(rows: DataFrame, questions: DataFrame, found: DataFrame, by_category: bool = False) -> DataFrame:
    """The rows (id, embedding, ...) and questions (qid, vector, ...) of `found` (qid, id), with `distance` for vectors.

    With `by_category` only those whose `category` is the question's `_category`."""
    found = found.select(F.col("qid").alias("_qid"), F.col("id").alias("_id"))
    pairs = rows.join(found, F.col("id").eqNullSafe(F.col("_id"))).join(questions, F.col("qid").eqNullSafe(F.col("_qid")))
    if by_category:
        pairs = pairs.where(F.col("category") == F.col("_category"))
    return pairs.withColumn("distance", cosine_distance(F.col("embedding"), F.col("vector"))).drop("vector", "embedding", "_qid", "_id")


def checked(found: DataFrame) -> DataFrame:
    """Found rows that have a text and a web address, with defaults and score. Rows that fail are not replaced."""
    good = found.where(has_text(F.col("text")) & has_web_address(F.col("source_url")))
    return good.select(
        *[c for c in found.columns if c not in {"text", "title", "source", "source_url", "published_at", "category", "distance", "embedding"}],
        strip(F.col("text")).alias("text"),
        or_default(F.col("title"), NO_TITLE).alias("title"),
        strip(F.col("source_url")).alias("url"),
        or_default(F.col("source"), NO_SOURCE).alias("source"),
        or_null(F.col("published_at")).alias("published_at"),
        or_null(F.col("category")).alias("category"),
        score(F.col("distance")).alias("score"),
    )


def places(found: DataFrame, *keys: str, by: Column | str = "rank") -> DataFrame:
    """A new `place` from 1 by the old rank, after rows have gone."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
