"""Substring dedup by line hashing.

A text's units are its sentences, which also end with the line; shorter ones than `least_words` go with the next of
their line, a run of them is a unit of its own, and so is a run of short lines. What is longer than three times
`least_words` is cut where a hash of the two words at the cut is the highest within `least_words`. Whole lines that are short are units, too. So no border depends on
what is far before it, and a passage set into another text has the same units there but for those at its ends. Units are
normalised (lower case, single spaces) and hashed to 128 bits. All digests are grouped globally, pre-aggregated before the
shuffle; of a digest that occurs more than once the earliest occurrence (by doc_id, then place) stays and all others are
removed. Offsets of what is removed refer to the original text, in code points, ends exclusive.

Only digests that repeat are joined back to the units, and a very frequent line is split by the skew join, since nothing
above the join needs its rows together.

Defined results: a null text has no units and stays null; less than `least_words` words of a line beside a longer
sentence of it go with that or, at the line's end, are no unit and stay; rows without an id rank last; repeated rows of one id and text count as one document, and
each gets its result; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import checkpoint

_ENDS = re.compile(r"\n+|(?<=[.!?])[ \t]+")
_WORD = re.compile(r"\S+")


def _stretches(text: str, least_words: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences and of the runs of short ones, in order."""
    begin, line, run, run_words = 0, 0, None, 0  # short sentences of this line, and where it begins
    lines, lines_end, lines_words = None, 0, 0  # short lines before it
    for m in [*_ENDS.finditer(text), None]:
        end, after = (m.start(), m.end()) if m else (len(text), len(text))
        n = len(text[begin:end].split())
        over = not m or m[0][0] == "\n"
        found = []
        if n >= least_words:
            if run_words >= least_words:
                found = [(run, run_end), (begin, end)]
            else:
                found = [(begin if run is None else run, end)]
            run, run_words = None, 0
        elif n:
            run, run_end, run_words = begin if run is None else run, end, run_words + n
        if over and run_words >= least_words:
            found.append((run, run_end))
            run, run_words = None, 0
        if found:
            if lines is not None:
                yield lines, lines_end
            lines, lines_words = None, 0
            yield from found
        if over and run is not None and (run_words >= least_words or run == line):
            lines, lines_end, lines_words = run if lines is None else lines, run_end, lines_words + run_words
        if over:
            run, run_words, line = None, 0, after
        begin = after
    if lines is not None:
        yield lines, lines_end


def _cuts(stretches: list[list[str]], least_words: int) -> Iterator[list[int]]:
    """Where long stretches are cut: before which words of each."""
    r, at, starts = least_words, [], []
    size = r
    for words in stretches:
        h = np.fromiter(map(zlib.crc32, map(str.encode, words)), np.uint64, len(words))
        place = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
        at += [np.zeros(r, np.uint64), place + np.uint64(1)]  # of one stretch, with nothing around it
        starts.append(size)
        size += len(place) + r
    at = np.concatenate([*at, np.zeros(r, np.uint64)])
    inner, around = at[r:-r], np.zeros(len(at) - 2 * r, np.uint64)
    for d in range(1, r + 1):
        np.maximum(around, at[r - d : len(at) - r - d], out=around)
        np.maximum(around, at[r + d : len(at) - r + d], out=around)
    highest = np.flatnonzero(inner > around) + r
    for words, start, some in zip(stretches, starts, np.split(highest, np.searchsorted(highest, starts[1:]))):
        n, out, last = len(words), [], 0
        for cut in [*(some - start + 1).tolist(), n]:
            if cut < n and (cut < r or n - cut < r):
                continue
            while cut - last >= 5 * r:  # hardly but for repeating words
                last += 4 * r
                out.append(last)
            out.append(cut)
            last = cut
        yield out[:-1]


def units(text: str, least_words: int = 5) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of each unit.

    >>> list(units("One two three four five. Six.  seven Eight nine ten!\\nrest", 5))
    [(0, 24, 'one two three four five.'), (25, 52, 'six. seven eight nine ten!')]
    """
    stretches = [(a, b, text[a:b].lower().split()) for a, b in _stretches(text, least_words)]
    long = [words for _, _, words in stretches if len(words) > 3 * least_words]
    cuts = iter(_cuts(long, least_words) if long else ())
    for begin, end, words in stretches:
        if len(words) <= 3 * least_words:
            yield begin, end, " ".join(words)
            continue
        spans = [m.span() for m in _WORD.finditer(text, begin, end)]
        at = [0, *next(cuts), len(words)]
        for a, b in zip(at, at[1:]):
            yield spans[a][0] if a else begin, spans[b - 1][1] if b < len(words) else end, " ".join(words[a:b])


def _unit_rows(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            row, place, start, end, digests = [], [], [], [], []
            for r, text in enumerate(part.column(2)):
                for n, (a, b, unit) in enumerate(units(text.as_py() or "", least_words)):
                    row.append(r)
                    place.append(n)
                    start.append(a)
                    end.append(b)
                    digests.append(xxhash.xxh3_128_digest(unit.encode()))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            which = pa.array(row, pa.int64())
            ints = [pa.array(x, pa.int32()) for x in (place, start, end)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(which), part.column(1).take(which), *ints, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "key", "place", "start", "end", "h1", "h2"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row of compressed bytes."""
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["rows"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column(0):
            yield from pa.ipc.open_stream(rows.as_py())


def unit_digests(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """(doc_id, key, place, start, end, h1, h2) for every unit; key tells texts of the same id apart.

    Units are found once; packed, they lie in the checkpoint folder.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))
    packed = checkpoint(rows.mapInArrow(lambda b: _packed(_unit_rows(b, least_words)), "rows binary"))
    return packed.mapInArrow(_unpacked, "doc_id long, key long, place int, start int, end int, h1 long, h2 long")


def removed_spans(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """(doc_id, key, spans, kept_in): what to remove of each text, as (start, end) in order, and where it stays."""
    found = unit_digests(docs, least_words)
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key", "place")
    firsts = found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    firsts = checkpoint(firsts)  # a table of its own, so that both sides of the join are dealt anew and a hot digest is split
    later = found.join(firsts, ["h1", "h2"]).where(rank > F.col("first"))
    holder = F.when(~F.col("first.nameless"), F.col("first.id"))
    one = later.select("doc_id", "key", F.struct("start", "end").alias("span"), holder.alias("holder"))
    grouped = one.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("holder")).alias("kept_in"))
    return grouped


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans, in one walk through each."""
    for b in batches:
        texts = []
        for text, spans in zip(b.column(1), b.column(2)):
            t = text.as_py()
            if t is not None and spans.is_valid and len(spans.values):
                start, end = (np.asarray(x).tolist() for x in spans.values.flatten())
                t = "".join(t[a:z] for a, z in zip([0, *end], [*start, len(t)]))
            texts.append(t)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3)], ["doc_id", "text", "spans", "kept_in"])


def dedup(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """(doc_id, text, n_removed, removed, kept_in) for every row: the text that is left, the spans removed from it as
    start:end, and the ids of the documents that keep them."""
    spans = removed_spans(docs, least_words).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans", "kept_in")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("key"))
    joined = rows.join(spans, rows.doc_id.eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    cut = joined.select("doc_id", "text", "spans", "kept_in").mapInArrow(_left, "doc_id long, text string, spans array<struct<start:int,end:int>>, kept_in array<bigint>")
    written = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return cut.select("doc_id", "text", F.when(F.col("spans").isNotNull(), F.size("spans")).otherwise(0).cast("long").alias("n_removed"), F.coalesce(written, F.lit("")).alias("removed"), F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"))
