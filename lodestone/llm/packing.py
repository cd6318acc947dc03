"""Cost-balanced packing of documents into fixed-length token sequences.

Each task tokenises its own documents and packs them shard by shard (a shard is a bounded number of tokens and of documents), so no
row is shuffled and memory does not grow with the input. In a shard every document first gives up its whole
`seq_len` chunks, which fill sequences of their own. The remainders go, in descending order, to the sequence with the
lowest estimated cost (linear plus quadratic in the piece's length) that still has room. A remainder that fits nowhere
is cut at a sequence's end, so that all sequences but the shard's last are full; the last is split into power-of-two
lengths, which need no padding.

Defined results: a null text counts as empty (its document is the end id alone); repeated rows and null ids are packed
row by row; an empty table gives no rows; columns other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import held

END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"

#: Of texts in which only characters of this range occur, white space, case and composition behave alike in Python and
#: in the tokenizer, so that they can be encoded word by word; other texts go to the tokenizer whole.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u017f]*").fullmatch
_CACHE_WORDS = 200_000


#: The tokenizer's own parts of a word, and the letters by which it names the 256 bytes.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Memo(dict):
    """What `make` gives for a key, remembered for the first `most` keys, which hold the frequent ones."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        out = self.make(key)
        if len(self) < self.most:
            self[key] = out
        return out


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes; remembers words within a bound."""

    def __init__(self, path: str, cache_words: int = _CACHE_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = re.compile("|".join(re.escape(t.content) for t in added), re.IGNORECASE).search if added else lambda text: None
        self._model = self._tokenizer.model
        self._part_ids = _Memo(self._encode_part, cache_words).__getitem__
        self._word_ids = _Memo(lambda word: b"".join(map(self._part_ids, _PART(word))), cache_words).__getitem__

    def _encode_part(self, part: str) -> bytes:
        shown = part.encode().decode("latin-1").translate(_BYTES)
        return np.array([t.id for t in self._model.tokenize(shown)], "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids of the text, as the tokenizer encodes it by default. Words are independent of each other in this vocabulary:
        it drops white space. Texts that name a token which the tokenizer knows beyond its words go to it whole."""
        if _PLAIN(text) and not self._added(text):
            return b"".join(map(self._word_ids, text.lower().split()))
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return held((WordEncoder, path), lambda: WordEncoder(path))


def piece_cost(length: float, seq_len: int) -> float:
    """Estimated work of a piece: its dense layers are linear, its attention quadratic in its length."""
    return length + length * length / seq_len


def pack_lengths(lengths: list[int], seq_len: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), in order of offset.

    >>> pack_lengths([5, 3], 4)
    [[(0, 0, 4)], [(1, 0, 3), (0, 4, 1)]]
    """
    out, rest = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % seq_len
        out += [[(doc, at, seq_len)] for at in range(0, whole, seq_len)]
        if n % seq_len:
            rest.append((n % seq_len, doc, whole))
    total = sum(r[0] for r in rest)
    if not total:
        return out
    count = -(-total // seq_len)
    room = np.full(count, seq_len, np.int64)
    room[-1] = total - seq_len * (count - 1)
    cost = np.zeros(count)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.flatnonzero(room >= n)
            k = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            take = int(min(n, room[k]))
            held[k].append((doc, start, take))
            room[k] -= take
            cost[k] += piece_cost(take, seq_len)
            n, start = n - take, start + take
    tail = held.pop()
    return out + held + _powers(tail)


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a sequence into sequences of power-of-two lengths, longest first."""
    left, out, todo = sum(p[2] for p in pieces), [], pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out.append([])
        while size:
            doc, start, n = todo.pop()
            take = min(n, size)
            out[-1].append((doc, start, take))
            size -= take
            if take < n:
                todo.append((doc, start + take, n - take))
    return out


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, shard_tokens: int, shard_docs: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), np.array([END_ID], "<u4").tobytes()
    base, made = TaskContext.get().partitionId() << 32, 0
    ids: list[int | None] = []
    docs: list[bytes] = []
    tokens = 0

    def flush() -> pa.RecordBatch:
        nonlocal made, tokens
        lengths = [len(d) // 4 for d in docs]
        cols: list[list] = [[] for _ in range(8)]
        parts: list[bytes] = []
        for pieces in pack_lengths(lengths, seq_len):
            offset = 0
            for doc, start, n in pieces:
                part = docs[doc][4 * start : 4 * (start + n)]
                for c, v in zip(cols, (ids[doc], start, n, zlib.crc32(part), lengths[doc], base + made, offset, piece_cost(n, seq_len))):
                    c.append(v)
                if keep_ids:
                    parts.append(part)
                offset += n
            made += 1
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.float64())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if keep_ids:
            ends = np.cumsum([0, *cols[2]], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(parts), "<i4")))
            names.append("ids")
        ids.clear()
        docs.clear()
        tokens = 0
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            got = encode(text.as_py() or "") + end
            ids.append(doc_id)
            docs.append(got)
            tokens += len(got) // 4
            if tokens >= shard_tokens or len(docs) >= shard_docs:
                yield flush()
    if docs:
        yield flush()


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, shard_tokens: int = 4_000_000, shard_docs: int = 200_000, keep_ids: bool = False) -> DataFrame:
    """Pack every document; one row for each piece.

    `shard_tokens` and `shard_docs` (many texts are tiny or empty) bound a task's memory, not what is packed. `keep_ids` adds the piece's token ids as `ids`.
    """
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: _pack_partition(b, tokenizer_path, seq_len, shard_tokens, shard_docs, keep_ids), schema)
