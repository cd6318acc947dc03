"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: the text between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task. It keeps one such thing, the last one asked for."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what `held` keeps. Spark hands workers on to the stages that follow, so that operators that keep nothing of
    their own begin with this; else a tokenizer with its remembered words would stay beside their work."""
    if _held:
        _held.clear()
        gc.collect()  # it may hold itself


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by Spark's reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; set one only where none is named, on one machine.

    On a cluster a temporary folder would be another on each machine, so that the session has to name one.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder; it outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def row_of(docs: DataFrame) -> Column:
    """All columns of `docs` as one struct, whatever their names."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
