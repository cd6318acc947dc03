"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found through lower bounds.

Components become whole numbers, floor(scale * x), and vectors are cut into equal consecutive parts. For a cut of a part
into blocks of width w, with m a block's mean and r the norm of what is left after the mean is taken off,
    distance^2 >= sum over blocks of w * (m_q - m_e)^2 + (r_q - r_e)^2.
Bounds go from coarse blocks to finer ones. At each level the entry of the smallest bound is measured exactly; entries
whose bound is above the best distance so far are dropped (with slack for rounding, so that no nearest one is lost), and
only survivors get exact integer distances.

Codebooks are learned in rounds: every task sums the parts that it assigned to each entry (a row an entry and task leaves
it), and the sums of all tasks replace the entries. Only codebooks (parts x entries) reach the driver; vectors are read
again in each round and never shuffled.

Defined results: vectors that are null or hold null or non-finite components are dropped; shorter vectors count as if
they ended in zeros, and so do all where the width is no multiple of the parts; rows without an id are coded as well, and
come after all others when the first entries are chosen; repeated ids are rows each, in order of their vectors; with fewer
rows than entries there are fewer entries; an empty table gives no rows; other columns are ignored. Whole numbers stop
where squared distances of a part would leave a long (2^28 for parts of 16), sums of errors at a long's ends.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import checkpoint
from lodestone.llm.topk import usable

#: Blocks of a part at each level, coarse to fine; levels finer than a part's components are left out.
LEVELS = (1, 4)
_CHUNK = 4096
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """Entries as whole numbers: parts x entries x width of a part."""

    entries: np.ndarray
    scale: int = 1024

    def sha256(self) -> str:
        """Digest of all components in order of part, entry and position, as decimal numbers between commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(vectors: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """rows x parts x width of floor(scale * x)."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale))
    out = np.zeros((len(vectors), parts * width))
    if len(flat):
        rows = np.repeat(np.arange(len(vectors)), lengths)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    most = math.isqrt(2**62 // max(1, width)) // 2
    return np.clip(out, -most, most).astype(np.int64).reshape(len(vectors), parts, width)


def _statistics(v: np.ndarray, blocks: int) -> np.ndarray:
    """sqrt(width) times each block's mean, and the norm of what is left of each block."""
    cols = []
    for b in np.array_split(v.astype(float), blocks, axis=1):
        mean = b.mean(axis=1)
        cols += [math.sqrt(b.shape[1]) * mean, np.sqrt(((b - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(cols, axis=1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def nearest_entries(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `v` (whole numbers) the nearest row of `book` and the squared distance; ties to the lower number."""
    index, error = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    if not v.shape[1]:
        return index, error
    levels = [(n, _statistics(book, n)) for n in LEVELS if n <= v.shape[1]]
    for at in range(0, len(v), _CHUNK):
        q = v[at : at + _CHUNK]
        best = np.full(len(q), np.iinfo(np.int64).max)
        alive = np.ones((len(q), len(book)), bool)
        for blocks, of_book in levels:
            of_q = _statistics(q, blocks)
            sizes = (of_q**2).sum(axis=1)[:, None] + (of_book**2).sum(axis=1)[None, :]
            bound = sizes - 2.0 * (of_q @ of_book.T)
            best = np.minimum(best, _squared(q, book[bound.argmin(axis=1)]))
            alive &= bound <= best[:, None] + 1e-9 * sizes + 1e-6
        i, j = np.nonzero(alive)  # in order of rows, then entries; each row keeps its nearest entry at least
        exact = np.concatenate([_squared(q[i[k : k + (1 << 17)]], book[j[k : k + (1 << 17)]]) for k in range(0, len(i), 1 << 17)])
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        least = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == least[i])
        first = hits[np.flatnonzero(np.diff(i[hits], prepend=-1))]
        index[at : at + _CHUNK], error[at : at + _CHUNK] = j[first], least
    return index, error


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums) of the rows that a task assigned to each entry."""
    parts, entries, width = books.shape
    total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        v = whole_numbers(batch.column(0), parts, width, scale)
        for p in range(parts):
            index, _ = nearest_entries(v[:, p], books[p])
            n[p] += np.bincount(index, minlength=entries)
            for d in range(width):  # sums of a batch are whole in a double
                total[p, :, d] += np.bincount(index, weights=v[:, p, d], minlength=entries).astype(np.int64)
    p, e = np.nonzero(n)
    lists = pa.array(total[p, e].tolist(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(p.astype("i4")), pa.array(e.astype("i4")), pa.array(n[p, e]), lists], ["part", "entry", "n", "sums"])


def _kept(vectors: DataFrame, *more: str) -> DataFrame:
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("v"), *more)
    return rows.where(usable(F.col("v")))


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of `vectors` (vec_id, embedding): the first entries are the rows of the smallest ids; each round replaces
    an entry by the floor of its rows' mean, and entries without rows stay. None for a table without usable vectors."""
    if entries > 256:
        raise ValueError("a code holds two hexadecimal digits a part: 256 entries at most")
    rows = _kept(vectors, "vec_id")
    first = rows.orderBy(F.col("vec_id").cast("long").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        return None
    width = -(-longest // parts)
    start = pa.concat_arrays(first.column("v").chunks)
    books = whole_numbers(start, parts, width, scale).transpose(1, 0, 2)
    for _ in range(rounds if width else 0):
        found = rows.select("v").mapInArrow(lambda b, k=books: _sums(b, k, scale), "part int, entry int, n long, sums array<long>")
        added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(width)]).alias("sums"))
        books = books.copy()
        for r in added.toLocalIterator():  # a row an entry
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return Codebooks(books, scale)


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        v = whole_numbers(batch.column(0), parts, width, scale)
        found = [nearest_entries(v[:, p], books[p]) for p in range(parts)]
        index = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
        # Parts' distances fit a long each; their sum stops at its end.
        error = np.minimum(np.sum([f[1].astype(float) for f in found], axis=0), 9e18)
        exact = np.where(error < 9e18, np.sum([f[1] for f in found], axis=0), _LONG)
        yield pa.RecordBatch.from_arrays([pa.array([bytes(r).hex() for r in index]), pa.array(exact), *batch.columns[1:]], ["code", "error", *batch.schema.names[1:]])


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits a part, and the squared distance to the entries coded."""
    kind = vectors.schema["label"].dataType.simpleString()
    rows = _kept(vectors, F.col("vec_id").cast("long").alias("vec_id"), "label")
    coded = rows.mapInArrow(lambda b: _codes(b, books.entries, books.scale), f"code string, error long, vec_id long, label {kind}")
    return coded.select("vec_id", "label", "code", "error")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """`codes` with `vector`: the entries that the code names, as components again (array<double>)."""
    parts = len(books.entries)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = [bytes.fromhex(c) for c in batch.column("code").to_pylist()]
            got = [np.concatenate([books.entries[p, d[p]] for p in range(parts)]) / books.scale for d in digits]
            yield batch.append_column("vector", pa.array([g.tolist() for g in got], pa.list_(pa.float64())))

    return codes.mapInArrow(one, codes.schema.simpleString()[7:-1] + ",vector:array<double>")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector; `label_error` is the errors' sum over
    rows of its label, null labels together. Codes are cut off in the shared folder before labels are summed; Spark picks
    the join by the size of the labels' table, and splits a hot label."""
    books = fit(vectors, parts, entries, rounds)
    if books is None:
        return vectors.limit(0).select(F.col("vec_id").cast("long"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = checkpoint(encode(vectors, books))
    sums = coded.groupBy(F.col("label").alias("_of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("_of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
