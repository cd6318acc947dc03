"""Chunks of long texts: fixed windows, and windows that end at a boundary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(docs: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """(id, chunk_no, start, text): windows of `size` characters that share `overlap`, until the text's end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    n, step = F.length("text"), size - overlap
    last = F.floor((F.greatest(n - overlap, F.lit(1)) - 1) / step)
    rows = docs.where(F.length("text") > 0).select("id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    start = (F.col("chunk_no") * step).cast("int")
    return rows.select("id", "chunk_no", start.alias("start"), F.substring("text", start + 1, F.lit(size)).alias("text"))


def headed(chunk_id: Column, title: Column, topic: Column, published: Column, text: Column) -> Column:
    """A chunk's text under a header of its metadata."""
    return F.concat_ws("\n", F.concat(F.lit("title: "), title), F.concat(F.lit("topic: "), topic), F.concat(F.lit("published: "), published), text)


#: The header's labels, and the mark of documents whose figures are of the past.
TITLE, PUBLISHED, STATE, BODY = "제목: ", "작성일: ", "문서 상태: 역사 정보 (현재 수치·현황 아님)", "본문: "


def with_header(title: Column, published: Column, document_type: Column, text: Column) -> Column:
    """A chunk's text below the header that is embedded with it; historical documents carry a mark, and a null title or
    date is left empty."""
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("")))
    mark = F.when(document_type == "historical", F.lit(STATE))
    return F.concat_ws("\n", line(TITLE, title), line(PUBLISHED, published), mark, line(BODY, text))


def cut(text: str, size: int, overlap: int, slack: float = 0.2) -> Iterator[tuple[int, str]]:
    """Windows that end at a line's end, else a sentence's, else a space, within the last `slack` of the window.

    >>> [c for _, c in cut("one two. three four", 12, 0, 0.5)]
    ['one two. ', 'three four']
    """
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            least = at + max(overlap + 1, int(size * (1 - slack)))
            for mark in ("\n", ". ", " "):
                found = text.rfind(mark, least - len(mark), end)
                if found >= 0:
                    end = found + len(mark)
                    break
        yield at, text[at:end]
        if end >= len(text):
            return
        at = max(at + 1, end - overlap)


def bounded_windows(docs: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """(id, chunk_no, start, text): like `windows`, but ending at boundaries, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, n, at, part) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (at, part) in enumerate(cut(text or "", size, overlap))]
            kinds = [b.column(0).type, pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "chunk_no", "start", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, chunk_no long, start int, text string")
