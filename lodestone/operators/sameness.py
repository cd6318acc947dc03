"""Which lines say the same: by words, by containment and by runs of characters, in one walk over the other side's lines.

Lines are taken apart as numbers, many at a time: a letter or digit is a number of 14 bits, so that a run of up to 4 is one
of 56, and a word is a hash. A line of the question side is looked up by some of its rarest parts, of which every line
alike must have so many; what is found is then measured on the texts themselves, so that hashes decide nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = re.compile("[0-9a-z가-힣]+")
_BITS, _SPAN, _SLOTS = 14, 4, 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Letters and digits as numbers from 1; 0 is any other character.
_SYMBOL = np.zeros(0x110000, np.uint16)
_SYMBOL[48:58], _SYMBOL[97:123], _SYMBOL[0xAC00:0xD7A4] = np.arange(1, 11), np.arange(11, 37), np.arange(37, 37 + 0xD7A4 - 0xAC00)


def grams(line: str) -> set[str]:
    """The runs of 2 to 4 characters of a folded line's letters and digits."""
    x = "".join(_WORD.findall(line))
    return {x[i : i + n] for n in (2, 3, 4) for i in range(len(x) - n + 1)}


def _symbols(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all lines, each ended by a 0, and the line of each."""
    ended = [x + "\n" for x in lines]
    return _SYMBOL[np.frombuffer("".join(ended).encode("utf-32-le"), np.uint32)].astype(np.uint64), np.repeat(np.arange(len(lines)), [len(x) for x in ended])


def _runs(symbols: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of n letters and digits, whatever stands between them, with their lines; shorter runs are smaller numbers."""
    known = symbols > 0
    s, of = symbols[known], line[known]
    many = max(0, len(s) - n + 1)
    code = np.zeros(many, np.uint64)
    for k in range(n):
        code = (code << np.uint64(_BITS)) | s[k : k + many]
    inside = of[:many] == of[n - 1 : n - 1 + many]
    return code[inside], of[:many][inside]


def _hashed(symbols: np.ndarray, line: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, with their lines: a sum over their symbols, each mixed with its place in the word."""
    known = np.concatenate(([False], symbols > 0, [False]))
    starts, ends = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    to = np.cumsum(ends - starts)
    place = np.arange(to[-1] if len(to) else 0) - np.repeat(to - (ends - starts), ends - starts)
    mixed = ((symbols[known[1:-1]] | (place.astype(np.uint64) << np.uint64(16))) ^ np.uint64(salt)) * _ODD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)))
    return sums[to] - sums[to - (ends - starts)], line[starts]


def _windows(words: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n words one after another, by the place of the first, and which of them are in one line."""
    many = max(0, len(words) - n + 1)
    code = np.full(many, n, np.uint64)
    for k in range(n):
        code = (code ^ (code >> np.uint64(31))) * _ODD + words[k : k + many]
    return code, line[:many] == line[n - 1 : n - 1 + many]


class _Table:
    """Which lines of the question side a number belongs to."""

    def __init__(self, codes: np.ndarray, of: np.ndarray):
        order = np.lexsort((of, codes))
        self.codes, at = np.unique(codes[order], return_index=True)
        self.of, self.ends = of[order], np.append(at, len(codes))
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _ODD) >> np.uint64(64 - _SLOTS)

    def hits(self, codes: np.ndarray, line: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct pair of a line and a number that is in the table: line * most + question line, and how many."""
        if not len(self.codes) or not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        may = np.flatnonzero(self.slots[self._slot(codes)])
        place = np.minimum(np.searchsorted(self.codes, codes[may]), len(self.codes) - 1)
        here = self.codes[place] == codes[may]
        pairs = np.unique(line[may[here]] * len(self.codes) + place[here])
        place = pairs % len(self.codes)
        many = self.ends[place + 1] - self.ends[place]
        at = np.repeat(self.ends[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.unique(np.repeat(pairs // len(self.codes), many) * most + self.of[at], return_counts=True)


def _rarest(codes: np.ndarray, of: np.ndarray, count: int, least: float, longest_first: bool) -> tuple[_Table, np.ndarray, np.ndarray]:
    """A table of some distinct parts of each line, how many of them a line alike must have, and how many there are: of a line's parts, all but
    `slack` are in every line alike, so that of the `slack` + n rarest n are."""
    codes, of = np.unique(np.stack([codes, of.astype(np.uint64)]), axis=1) if len(codes) else (codes, of)
    of = of.astype(np.int64)
    seen, place, times = np.unique(codes, return_inverse=True, return_counts=True)
    length = np.where(longest_first, np.searchsorted(np.array([1 << 28, 1 << 42], np.uint64), codes, side="right"), 0)
    order = np.lexsort((codes, times[place], -length, of))
    sizes = np.bincount(of, minlength=count)
    slack = sizes - np.array([math.ceil(least * n - 1e-9) for n in sizes.tolist()], np.int64)
    need = np.minimum(np.maximum(1, sizes // 8), np.maximum(1, sizes - slack))
    rank = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    taken = order[rank < (slack + need)[of[order]]]
    return _Table(codes[taken], of[taken]), need, sizes


def _kinds(codes: np.ndarray, line: np.ndarray, count: int) -> np.ndarray:
    """How many distinct numbers each line has; a line has as many parts of all kinds at least, so that longer ones differ."""
    order = np.lexsort((codes, line))
    codes, line = codes[order], line[order]
    new = np.concatenate(([True], (codes[1:] != codes[:-1]) | (line[1:] != line[:-1])))[: len(codes)]
    return np.bincount(line[new], minlength=count)


class Asked:
    """The question side's lines (folded), by which lines are looked up."""

    def __init__(self, lines: list[str], least: float):
        self.lines, self.least, n = lines, least, len(lines)
        symbols, of = _symbols(lines)
        runs = [_runs(symbols, of, k) for k in (2, 3, 4)]
        self.runs, self.runs_need, self.runs_size = _rarest(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]), n, least, True)
        self.lengths = [k for k in (2, 3, 4) if ((self.runs.codes >= 1 << (_BITS * (k - 1))) & (self.runs.codes < 1 << (_BITS * k))).any()]
        different, self.salt = len({w for x in lines for w in _WORD.findall(x)}), 0
        while len(np.unique(_hashed(symbols, of, self.salt)[0])) < different:  # words of this side keep apart
            self.salt += 1 << 56
        words, of = _hashed(symbols, of, self.salt)
        self.words, self.words_need, self.words_size = _rarest(words, of, n, least, False)
        size = np.bincount(of, minlength=n)
        first = np.diff(of, prepend=-1) != 0
        self.starts, self.within = [], []  # a line's first words, and any words of a line
        for k in range(1, _SPAN + 1):
            code, inside = _windows(words, of, k)
            of_k = of[: len(code)]
            whole = inside & first[: len(code)] & ((size[of_k] == k) | (k == _SPAN))
            self.starts.append(_Table(code[whole], of_k[whole]))
            self.within.append(_Table(code[inside], of_k[inside]))
        self.held: dict[tuple[str, int], set[str] | str] = {}

    def _parts(self, reason: str, a: int) -> set[str] | str:
        if (reason, a) not in self.held:
            self.held[reason, a] = _PARTS[reason](self.lines[a])
        return self.held[reason, a]

    def found(self, lines: list[str]) -> Iterator[tuple[int, int, str]]:
        """(place of a line, place of a line of the question side, reason) of `lines`."""
        n = len(self.lines)
        symbols, of = _symbols(lines)
        may: dict[str, np.ndarray] = {}
        runs = [_runs(symbols, of, k) for k in self.lengths]
        pairs, times = self.runs.hits(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]), n) if runs else (np.zeros(0, np.int64),) * 2
        fits = _kinds(*_runs(symbols, of, 2), len(lines))[pairs // n] * self.least <= self.runs_size[pairs % n] + 1e-9
        may["characters"] = pairs[(times >= self.runs_need[pairs % n]) & fits]
        words, of = _hashed(symbols, of, self.salt)
        pairs, times = self.words.hits(words, of, n)
        fits = _kinds(words, of, len(lines))[pairs // n] * self.least <= self.words_size[pairs % n] + 1e-9
        may["words"] = pairs[(times >= self.words_need[pairs % n]) & fits]
        size, first, some = np.bincount(of, minlength=len(lines)), np.diff(of, prepend=-1) != 0, []
        for k in range(1, _SPAN + 1):
            code, inside = _windows(words, of, k)
            of_k = of[: len(code)]
            whole = inside & first[: len(code)] & ((size[of_k] == k) | (k == _SPAN))
            some += [self.starts[k - 1].hits(code[inside], of_k[inside], n)[0], self.within[k - 1].hits(code[whole], of_k[whole], n)[0]]
        may["contained"] = np.unique(np.concatenate(some))
        for reason, pairs in may.items():
            last, parts = -1, None
            for b, a in zip((pairs // n).tolist(), (pairs % n).tolist()):
                if b != last:  # pairs stand in order of their lines
                    last, parts = b, _PARTS[reason](lines[b])
                if _holds(reason, self._parts(reason, a), parts, self.least):
                    yield b, a, reason


def _spaced(line: str) -> str:
    return f" {' '.join(_WORD.findall(line))} "


#: What a test compares; a line without words has none.
_PARTS = {"words": lambda line: set(_WORD.findall(line)), "characters": grams, "contained": lambda line: _spaced(line).strip() and _spaced(line)}


def _holds(reason: str, p: set[str] | str, q: set[str] | str, least: float) -> bool:
    if not p or not q:
        return False
    if reason == "contained":
        return p in q or q in p
    both = len(p & q)
    return both / (len(p) + len(q) - both) >= least


def walk(batches: Iterator[pa.RecordBatch], keys: list[str], lines: list[str], least: float, at_once: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(a_key, b_id, reason) of rows (b_id, folded line) that say the same as one of `lines`; equal lines of a batch are
    looked up once, lines of about `at_once` characters together."""
    asked, names = Asked(lines, least), pa.array(keys, pa.string())
    for batch in batches:
        coded = batch.column(1).dictionary_encode()
        texts, found, at, held = coded.dictionary.to_pylist(), [], 0, 0
        for i, x in enumerate(texts):
            held += len(x)
            if held >= at_once or i == len(texts) - 1:
                found += [(b + at, a, reason) for b, a, reason in asked.found(texts[at : i + 1])]
                at, held = i + 1, 0
        if found:
            rows = np.argsort(coded.indices.to_numpy(), kind="stable")
            many = np.bincount(coded.indices.to_numpy(), minlength=len(texts))
            begin = np.cumsum(many) - many
            for k in range(0, len(found), 1024):
                some = found[k : k + 1024]
                at_rows = np.concatenate([rows[begin[b] : begin[b] + many[b]] for b, _, _ in some])
                repeat = np.repeat(np.arange(len(some)), [many[b] for b, _, _ in some])
                yield pa.RecordBatch.from_arrays([names.take(pa.array([a for _, a, _ in some])).take(pa.array(repeat)), batch.column(0).take(pa.array(at_rows)), pa.array([r for _, _, r in some]).take(pa.array(repeat))], ["a_key", "b_id", "reason"])
