"""Text vectors by signed feature hashing: words and runs of 2 to 4 characters, titles with more weight, of unit length.

A feature's Blake2b digest of 64 bits gives its component and its sign. Texts are folded by Spark; tasks hash Arrow batches and
remember the digests of frequent features within a bound. A text without features is the zero vector, which has no neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import TOKEN, fold_case

_WORDS = re.compile(TOKEN).findall
_KEPT = 50_000
#: Rows of a batch that are taken apart at a time.
_STEP = 256


class _Features(dict):
    """Digests of features as signed numbers."""

    def __missing__(self, feature: str) -> int:
        number = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "little")
        if len(self) < _KEPT:
            self[feature] = number
        return number


_features = _Features()


def _feature_runs(text: str, least: int = 2, most: int = 4) -> Iterator[str]:
    """As `features`, one by one, so that a long text's features are never held together."""
    words = _WORDS(text)
    flat = "".join(words)
    yield from ("w" + w for w in words)
    for n in range(least, most + 1):
        yield from ("g" + flat[i : i + n] for i in range(len(flat) - n + 1))


def features(text: str, least: int = 2, most: int = 4) -> list[str]:
    """The words of a folded text, marked w, and the character runs of all its words together, marked g."""
    return list(_feature_runs(text, least, most))


def hashed(title: str, text: str, dims: int, title_weight: float) -> np.ndarray:
    out = np.zeros(dims)
    for part, weight in ((title, title_weight), (text, 1.0)):
        found = np.fromiter(map(_features.__getitem__, _feature_runs(part)), np.uint64)
        if len(found):
            signs = np.where(found >> np.uint64(63), -weight, weight)
            out += np.bincount((found % np.uint64(dims)).astype(np.int64), weights=signs, minlength=dims)
    size = np.sqrt((out * out).sum())
    return out / size if size else out


def text_vectors(rows: DataFrame, dims: int = 256, title_weight: float = 3.0) -> DataFrame:
    """(id, embedding) of rows (id, title, text), as `search.nearest_of_each` takes them; nulls are empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                b = batch.slice(at, _STEP)
                vectors = [hashed(t.as_py(), x.as_py(), dims, title_weight) for t, x in zip(b.column("title"), b.column("text"))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype="i4") * dims), pa.array(np.concatenate(vectors)))
                yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["id", "embedding"])

    folded = rows.select("id", *[fold_case(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "text")])
    return folded.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>")
