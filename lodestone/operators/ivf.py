"""A partition index for vector search: rows lie in folders by their nearest centroid, and a search reads a few of them.

Centroids are fitted on a bounded sample; every row is assigned and written. A cell knows its radius, the largest distance
between its centroid and a row's direction, so that the triangle inequality bounds what a cell can hold: the exact search
reads first the cells nearest to a question, then only those that may hold something nearer than its k-th row so far.

Rows without a direction (null, zero or non-finite vectors) lie in cell -1; they have no distance and come last.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodestone.operators.search import blocks_of, measured, near_in_cells, wanted


@dataclass(frozen=True)
class PartitionIndex:
    """An index that was written: its folder, and its centroids with radius and number of rows (a row a cell)."""

    path: str
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


def _directions(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows x width of unit vectors; NaN where there is no direction."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    right = np.asarray(vectors.is_valid()) & (lengths == width)
    out = np.full((len(vectors), width), np.nan)
    if right.all():
        out[:] = flat.reshape(-1, width)
    else:
        starts = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(right):
            out[i] = flat[starts[i] : starts[i] + width]
    with np.errstate(all="ignore"):
        out = out / np.sqrt((out * out).sum(axis=1, keepdims=True))
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def _fit(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means of unit vectors from evenly spaced first centroids."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        near = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    return centroids


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch with `cell` and `away`, the distance between the row's direction and the centroid."""
    for batch in batches:
        v = _directions(batch.column("_v"), centroids.shape[1])
        ok = ~np.isnan(v[:, 0])
        cell, away = np.full(len(v), -1, "i4"), np.zeros(len(v))
        if ok.any():
            dots = v[ok] @ centroids.T
            cell[ok] = dots.argmax(axis=1)
            away[ok] = np.sqrt(((v[ok] - centroids[cell[ok]]) ** 2).sum(axis=1))
        out = batch.append_column("cell", pa.array(cell)).append_column("away", pa.array(away))
        yield out.drop_columns(["_v"])


def build(rows: DataFrame, path: str, cells: int = 64, sample: int = 50_000, rounds: int = 10, files: int = 1) -> PartitionIndex:
    """Write an index of `rows` (id, embedding, and any other columns but `cell`, `away` and `_v`) at a path.

    Centroids come from at most `sample` rows, the ones of the smallest hashes of their ids; `files` is the number of files
    that a cell is split into, so that a large cell is no single task.
    """
    spark = rows.sparkSession
    vectors = F.col("embedding").cast("array<double>")
    some = rows.select(vectors.alias("v"), F.xxhash64("id").alias("h")).where("v IS NOT NULL AND size(v) > 0").orderBy("h", "v").limit(sample).select("v").toArrow()
    if not len(some):
        raise ValueError("an index needs vectors")
    flat = pa.concat_arrays(some.column("v").chunks)
    width = int(np.bincount(np.diff(flat.offsets.to_numpy())).argmax())
    unit = _directions(flat, width)
    unit = unit[~np.isnan(unit[:, 0])]
    if not len(unit):
        raise ValueError("an index needs vectors that have a direction")
    centroids = _fit(unit, cells, rounds)
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("away", DoubleType())])
    found = rows.withColumn("_v", vectors).mapInArrow(lambda b: _assign(b, centroids), schema)
    found.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files))).write.partitionBy("cell").parquet(f"{path}/rows")
    stats = {r["cell"]: r for r in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}  # a row a cell
    table = [(k, centroids[k].tolist(), stats[k]["radius"] if k in stats else 0.0, stats[k]["n"] if k in stats else 0) for k in range(len(centroids))]
    spark.createDataFrame(table, "cell int, centroid array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PartitionIndex:
    """The index at a path. Only its cells are read."""
    got = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return PartitionIndex(path, np.array([r["centroid"] for r in got]), np.array([r["radius"] for r in got]), np.array([r["n"] for r in got]))


def _cells(batches: Iterator[pa.RecordBatch], index: PartitionIndex, most: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """(qid, cell) of the cells to read: the `most` nearest; with `exact` instead all others whose bound does not exceed
    the question's `least`, its k-th distance so far (null: everything)."""
    for batch in batches:
        v = _directions(batch.column("vector"), index.centroids.shape[1])
        gap = np.sqrt(np.maximum(0, 2 - 2 * (v @ index.centroids.T)))
        near = np.argsort(np.where(np.isnan(gap), 0, gap), axis=1, kind="stable")[:, :most]
        picked = np.zeros(gap.shape, bool)
        np.put_along_axis(picked, near, True, axis=1)
        if exact:
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)[:, None]
            bound = np.maximum(0, gap - index.radius[None, :] - 1e-9) ** 2 / 2
            picked = ~picked & (np.isnan(least) | np.isnan(bound) | (bound <= least + 1e-9))
        picked &= (index.rows > 0)[None, :]
        q, c = np.nonzero(picked)
        yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(q)), pa.array(c.astype("i4"))], ["qid", "cell"])


def _read(spark: SparkSession, index: PartitionIndex, wanted_cells: DataFrame, questions: DataFrame, by_category: bool, with_rest: bool, n: int) -> DataFrame:
    """Of the rows of the cells that each question asks for, what may be among its `n` nearest, with distances. The list of
    cells, which the index bounds, becomes a filter on the folders."""
    cells = [r["cell"] for r in wanted_cells.select("cell").distinct().collect()]  # a row a cell at most
    rows = spark.read.parquet(f"{index.path}/rows").drop("away")
    rows = rows.where(F.col("cell").isin(cells + ([-1] if with_rest else [])))
    asked = wanted_cells.unionByName(questions.select("qid", F.lit(-1).alias("cell"))) if with_rest else wanted_cells
    q = questions.select("qid", "vector", *([F.col("category").alias("_category")] if by_category else []))
    keys = ["cell", *(["_category"] if by_category else [])]
    left = rows.select("id", F.col("embedding").alias("v"), "cell", *([F.col("category").alias("_category")] if by_category else []))
    right = asked.join(q, "qid").select("qid", F.col("vector").alias("v"), *keys)
    if by_category:
        left, right = left.where("_category IS NOT NULL"), right.where("_category IS NOT NULL")
    # A question takes rows of its cells only, so that its pairs are those of one cell each.
    return measured(rows, q, near_in_cells(left, right, keys, n), by_category).drop("_category", "cell")


def search(spark: SparkSession, index: PartitionIndex, questions: DataFrame, limit: int | None = None, probe: int = 8, exact: bool = False, by_category: bool = False, block: int = 65_536) -> DataFrame:
    """The nearest rows of each question (qid, vector[, category]), with `distance` and `rank`.

    The `probe` nearest cells are read. With `exact` further cells follow, as far as their bounds ask for it, and the result
    is that of `nearest_of_each` over all rows. Questions go in blocks of about `block`; rows and
    questions of a cell meet in bounded parts of it (`search.near_in_cells`).
    """
    n = wanted(limit)
    count, out = blocks_of(questions, block), None
    kind = f"qid {questions.schema['qid'].dataType.simpleString()}, cell int"
    by = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "id")
    for k in range(count):
        some = questions.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == k) if count > 1 else questions
        q = some.select("qid", F.col("vector").cast("array<double>").alias("vector"), *(["category"] if by_category else []))
        first = q.select("qid", "vector").mapInArrow(lambda b: _cells(b, index, probe, False), kind)
        found = _read(spark, index, first, q, by_category, False, n).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
        if exact:
            found.write.parquet(part := f"{index.path}/found-{uuid.uuid4().hex}")
            found = spark.read.parquet(part)
            least = found.groupBy("qid").agg(F.when(F.count("distance") >= n, F.max("distance")).alias("least"))
            more = q.join(F.broadcast(least), "qid", "left").select("qid", "vector", "least").mapInArrow(lambda b: _cells(b, index, probe, True), kind)
            rest = _read(spark, index, more, q, by_category, True, n)
            found = found.drop("rank").unionByName(rest.select(*[c for c in found.columns if c != "rank"])).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
        out = found if out is None else out.unionByName(found)
    return out


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, recall): the share of each question's true rows (qid, id) that were found."""
    both = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("_hit")), ["qid", "id"], "left")
    return both.groupBy("qid").agg((F.count("_hit") / F.count("*")).alias("recall"))
