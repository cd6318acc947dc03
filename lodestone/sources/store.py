"""Collection storage: opening, counting, rebuilding with a manifest, upserts and two-file reports."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class StoreError(RuntimeError):
    """A collection that cannot be read or written as asked."""


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection at a path, by Spark's reader."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise StoreError(f"no collection can be read at {path}") from e


def list_chunks(collection: DataFrame, **equal: str) -> DataFrame:
    """All chunks whose metadata fields have the given values."""
    for name, value in equal.items():
        collection = collection.where(F.col(name) == value)
    return collection


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `new` replace those of the same key in `old`; of repeated keys in `new` the last by `ordinal` stays."""
    last = Window.partitionBy(key).orderBy(F.desc("ordinal"))
    fresh = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "ordinal")
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def rebuild(chunks: DataFrame, path: str, manifest: dict, reset: bool = False) -> dict:
    """Write the whole collection anew, check its count, and write the manifest last.

    A collection that has rows is replaced only with `reset`. Rows go to a new folder first, so that a failed run leaves
    the old collection as it was; the manifest names the folder that holds.
    """
    spark = chunks.sparkSession
    current = read_manifest(spark, path)
    if current and current.get("count") and not reset:
        raise StoreError("the collection is not empty; ask for a reset")
    folder = f"rows-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{path}/{folder}")
    stored = spark.read.parquet(f"{path}/{folder}").count()
    full = {**manifest, "count": stored, "folder": folder}
    spark.createDataFrame([(json.dumps(full, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return full


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest; None where there is none. One that is no JSON object raises StoreError."""
    try:
        lines = [r["value"] for r in spark.read.text(f"{path}/manifest").take(2)]
    except AnalysisException:
        return None
    try:
        got = json.loads(lines[0])
    except (IndexError, ValueError) as e:
        raise StoreError("the manifest cannot be read") from e
    if not isinstance(got, dict):
        raise StoreError("the manifest is no object")
    return got


def write_reports(files: dict[str, str]) -> None:
    """Replace several local report files together: all are staged first, and all go back if one cannot be replaced."""
    staged = {Path(p): Path(f"{p}.{uuid.uuid4().hex}.new") for p in files}
    kept: dict[Path, bytes | None] = {}
    try:
        for p, tmp in staged.items():
            tmp.write_text(files[str(p)], encoding="utf-8")
        for p, tmp in staged.items():
            kept[p] = p.read_bytes() if p.exists() else None
            os.replace(tmp, p)
    except OSError:
        for p, old in kept.items():
            if old is None:
                p.unlink(missing_ok=True)
            else:
                p.write_bytes(old)
        raise
    finally:
        for tmp in staged.values():
            tmp.unlink(missing_ok=True)
