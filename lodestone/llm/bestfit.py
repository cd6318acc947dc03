"""Best-fit packing of documents into as few fixed-length sequences as possible, in bulk-synchronous rounds.

Every task tokenises its own documents and writes their pieces once, with each piece's number among the task's pieces of
its length. Counts of (length, task) then give every piece its rank among all pieces of its length, so that documents are
sorted by length without being moved, and pieces of one length are a run of ranks. Sequences with equal room left whose
numbers follow each other are runs, too. The rounds work on runs, of which there are no more than lengths and splits,
however many documents there are:

* runs of documents and of gaps are range-sorted by size and dealt into ranges of bounded size;
* a task sweeps its range from large to small: documents take their successor, the smallest gap that holds them (a gap as
  many documents of a length as it has room for). Documents that want the same gap are served by rank, longest first;
* gaps are updated, and the task sweeps again until nothing in its range matches;
* what is left goes into wider ranges, until one range holds all; documents longer than every gap open new sequences,
  half as many as their tokens would fill, the longest ones first; and the next round begins.

Longer documents are settled before shorter ones start: (1/2, 1], (1/4, 1/2], (1/8, 1/4] of a sequence, then the rest. At
last every piece finds its sequence by its length and rank in the table of matches.

Defined results: a null text counts as empty (its document is the end id alone); repeated rows and null ids are packed row
by row; a document of more than `seq_len` tokens is cut into whole sequences, before which its first piece takes what is
over; an empty table gives no rows; columns other than `doc_id` and `text` are ignored. A task that is run again gives its
pieces the same numbers, since they are written with them. Tokens may differ from run to run in nothing; which of equal
pieces goes to which sequence may.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import checkpoint
from lodestone.llm.bytebpe import encoder

END_ID = 0
#: Runs that a task sweeps at once.
RANGE_RUNS = 512
#: The part of the sequences that their tokens would fill which documents without a gap open at once, unless there are
#: few (a 256th of all): opened slowly, long documents meet long ones.
OPENED = 2
_RUN = pa.schema([("range", pa.int32()), ("gap", pa.bool_()), ("size", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
#: A match: `n` documents of `size` from rank `first` on go to sequences from `seq` on, `per` to each, from `offset` on.
_MATCH = pa.schema([("kind", pa.string()), ("size", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("seq", pa.int64()), ("per", pa.int64()), ("offset", pa.int64())])

Run = tuple[int, int, int]  # size, first rank or sequence, how many


def sweep(docs: list[Run], gaps: list[Run], seq_len: int) -> tuple[list[Run], list[Run], list[tuple[int, ...]]]:
    """Documents without a gap, gaps as they are now, and matches (size, first, n, seq, per, offset).

    >>> sweep([(5, 0, 3)], [(11, 7, 1), (6, 8, 1)], 16)
    ([], [(1, 8, 1), (1, 7, 1)], [(5, 0, 1, 8, 1, 10), (5, 1, 2, 7, 2, 5)])
    """
    left, stack, out, matches = [], [], [], []
    waiting = sorted(gaps)
    for size, first, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        while waiting and waiting[-1][0] >= size:
            stack.append(waiting.pop())
        while n and stack:
            room, seq, m = stack.pop()
            per = min(room // size, n)
            used = min(m, n // per)
            matches.append((size, first, used * per, seq, per, seq_len - room))
            out.append((room - per * size, seq, used))
            if used < m:
                stack.append((room, seq + used, m - used))
            first, n = first + used * per, n - used * per
        if n:
            left.append((size, first, n))
    return left, out + stack + waiting, matches


def settle(docs: list[Run], gaps: list[Run], seq_len: int) -> tuple[list[Run], list[Run], list[tuple[int, ...]]]:
    """Sweeps until no document finds a gap. Gaps without room are gone."""
    found = []
    while docs:
        docs, gaps, matches = sweep(docs, gaps, seq_len)
        gaps = [g for g in gaps if g[0]]
        if not matches:
            break
        found += matches
    return docs, gaps, found


def _settle_range(rows: pa.Table, seq_len: int) -> pa.Table:
    runs = list(zip(*(rows.column(c).to_pylist() for c in ("gap", "size", "first", "n"))))
    docs, gaps, matches = settle([r[1:] for r in runs if not r[0]], [r[1:] for r in runs if r[0]], seq_len)
    out = [("doc", *d, 0, 0, 0) for d in docs] + [("gap", *g, 0, 0, 0) for g in gaps] + [("match", *m) for m in matches]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_MATCH), _MATCH)], schema=_MATCH)


def _superstep(spark, docs: list[Run], gaps: list[Run], ranges: int, seq_len: int) -> tuple[list[Run], list[Run], list[tuple[int, ...]]]:
    """All ranges settle at once, a task each. What comes back is bounded by lengths and splits, not by documents."""
    both = sorted([(d[0], False, d) for d in docs] + [(g[0], True, g) for g in gaps])
    per = -(-len(both) // ranges)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((k // per, gap, *run) for k, (_, gap, run) in enumerate(both))), _RUN)], schema=_RUN)
    schema = "kind string, size long, first long, n long, seq long, per long, offset long"
    got = spark.createDataFrame(table).groupBy("range").applyInArrow(lambda t: _settle_range(t, seq_len), schema).collect()
    rows = {k: [tuple(r)[1:] for r in got if r["kind"] == k] for k in ("doc", "gap", "match")}
    return [r[:3] for r in rows["doc"]], [r[:3] for r in rows["gap"]], rows["match"]


def open_sequences(docs: list[Run], count: int, seq: int, seq_len: int) -> tuple[list[Run], list[Run], list[tuple[int, ...]]]:
    """The `count` longest documents begin sequences of their own, numbered from `seq` on."""
    left, gaps, matches = [], [], []
    for size, first, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        used = min(n, count)
        if used:
            matches.append((size, first, used, seq, 1, 0))
            gaps.append((seq_len - size, seq, used))
            seq, count = seq + used, count - used
        if used < n:
            left.append((size, first + used, n - used))
    return left, [g for g in gaps if g[0]], matches


def match_all(spark, counts: dict[int, int], seq_len: int, range_runs: int = RANGE_RUNS) -> list[tuple[int, ...]]:
    """Matches that place every piece; `counts` has the number of pieces of each length."""
    whole = counts.get(seq_len, 0)
    found = [(seq_len, 0, whole, 0, 1, 0)] if whole else []
    gaps: list[Run] = []
    least_opened = sum(s * n for s, n in counts.items() if s < seq_len) // seq_len // 256
    seq, top = whole, seq_len
    while top:
        low = top // 2 if top * 8 > seq_len * 2 else 0
        docs = [(s, 0, counts[s]) for s in range(min(top, seq_len - 1), low, -1) if counts.get(s)]
        while docs:
            most = max((g[0] for g in gaps), default=0)
            lost = [d for d in docs if d[0] > most]
            if lost:
                filled = -(-sum(s * n for s, _, n in lost) // seq_len)
                if filled > least_opened:
                    filled = -(-filled // OPENED)
                count = max(filled, sum(n for s, _, n in lost if s > seq_len // 2))
                rest, fresh, matches = open_sequences(lost, count, seq, seq_len)
                seq += count
                docs, gaps, found = [d for d in docs if d[0] <= most] + rest, gaps + fresh, found + matches
            ranges = -(-(len(docs) + len(gaps)) // range_runs)
            while docs:
                # Gaps smaller than every document wait outside.
                least = min(d[0] for d in docs)
                docs, used, matches = _superstep(spark, docs, [g for g in gaps if g[0] >= least], ranges, seq_len)
                gaps, found = [g for g in gaps if g[0] < least] + used, found + matches
                if ranges == 1:
                    break
                ranges = max(1, ranges // 4)
        top = low
    return found


def _pieces(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]) of a task's documents."""
    encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
    task, seen = TaskContext.get().partitionId(), [0] * (seq_len + 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if keep_ids else [])]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else [])]
    cols: list[list] = [[] for _ in names]
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal held
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        for c in cols:
            c.clear()
        held = 0
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "") + end
            total = len(ids) // 4
            at, number = 0, 0
            while at < total:
                n = (total - at) % seq_len or seq_len
                part = ids[4 * at : 4 * (at + n)]
                row = (doc_id, number, at, n, zlib.crc32(part), task, seen[n])
                for c, v in zip(cols, (*row, np.frombuffer(part, "<u4").astype("i4")) if keep_ids else row):
                    c.append(v)
                seen[n] += 1
                at, number, held = at + n, number + 1, held + n
            if held >= 2_000_000 or len(cols[0]) >= 50_000:
                yield flush()
    if cols[0]:
        yield flush()


def _places(batches: Iterator[pa.RecordBatch], matches: np.ndarray) -> Iterator[pa.RecordBatch]:
    """`sequence_id` and `offset` in place of `rank`, by the match that covers a piece's length and rank."""
    size, first, _, seq, per, offset = matches.T
    keys = (size.astype(object) << 44) + first if len(size) and size.max() >= 1 << 18 else (size << 44) + first
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        i = rank - first[k]
        cols = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
        cols |= {"sequence_id": pa.array(seq[k] + i // per[k]), "offset": pa.array(offset[k] + i % per[k] * length)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = END_ID, keep_ids: bool = False, range_runs: int = RANGE_RUNS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every document.

    `keep_ids` adds the piece's token ids; `range_runs` bounds what a task sweeps at once.
    """
    if not 1 <= seq_len < 1 << 18:
        raise ValueError("seq_len must be between 1 and 262143")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + (", ids array<int>" if keep_ids else "")
    pieces = checkpoint(rows.mapInArrow(lambda b: _pieces(b, tokenizer_path, seq_len, end_id, keep_ids), schema))
    by = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counted = checkpoint(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    before = counted.select("length", "task", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # seq_len rows at most
    matches = np.array(sorted(match_all(spark, counts, seq_len, range_runs)), np.int64).reshape(-1, 6)
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    names = [c.split()[0] for c in columns.split(", ")]
    return ranked.select(*names, "rank").mapInArrow(lambda b: _places(b, matches), columns + ", sequence_id long, offset long")
