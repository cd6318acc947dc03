"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words (their counts, scaled to unit length), binned structure statistics (case, digits,
symbols, punctuation, line breaks, word lengths, distinct and repeated words) and its length as metadata. The score is
sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): pairwise interactions in linear time.
Scoring reads each whole text once, without a shuffle; the model is a bounded table.

Bound: the fit takes at most `most` labelled training texts, chosen by a hash of the id; every text is scored.
Defined results: a null or empty text is scored by its statistics alone; a null id is not held out; repeated rows get
equal scores; without labelled rows every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import fold
from lodestone.llm._sample import bounded, labelled, texts_of

WORDS = 1 << 16
BINS = 16
FOLDS, HELD_OUT = 5, 0
_MEMO_WORDS = 200_000
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT, _SYMBOL = b".,;:?'\"-()", b"!%$&#*|{}<>\\/=_@^~[]+`"
#: Upper ends of the bins of a share between 0 and 1.
_SHARE = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7, 0.9])
#: Statistics by name; the last two are counts, binned by powers of two.
STATISTICS = ("upper", "digit", "punctuation", "symbol", "line_break", "distinct", "repeated", "long_words", "short_words", "top_word", "words", "bytes")
DIM = WORDS + BINS * len(STATISTICS)


def statistics(text: str, words: list[str], counts: Counter) -> list[int]:
    """The bin of each statistic."""
    raw, n = text.encode(), len(words)
    size = max(1, len(raw))
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    some = max(1, n)
    shares = (share(_UPPER), share(_DIGIT), share(_PUNCT), share(_SYMBOL), share(b"\n"), len(counts) / some, sum(map(str.__eq__, words, words[1:])) / some, float((lengths > 12).sum()) / some, float((lengths < 3).sum()) / some, max(counts.values(), default=0) / some)
    return [*np.searchsorted(_SHARE, shares).tolist(), min(BINS - 1, n.bit_length()), min(BINS - 1, len(raw).bit_length() // 2)]


class Features:
    """(ids, values) of texts; remembers the ids of words within a bound."""

    def __init__(self) -> None:
        self._memo: dict[str, int] = {}

    def _word(self, word: str) -> int:
        got = self._memo.get(word)
        if got is None:
            got = crc32(word.encode()) % WORDS
            if len(self._memo) < _MEMO_WORDS:
                self._memo[word] = got
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.lower().split()
        counts = Counter(words)
        ids = np.fromiter(map(self._word, counts), np.int64, len(counts))
        values = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        if len(ids):
            values /= np.sqrt((values * values).sum())
        stats = np.array(statistics(text, words, counts)) + WORDS + BINS * np.arange(len(STATISTICS))
        return np.concatenate((ids, stats)), np.concatenate((values, np.ones(len(stats))))


class Model:
    """A factorisation machine."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors
        self._features = Features()

    def __getstate__(self) -> tuple:
        return self.bias, self.weights, self.factors

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def __call__(self, text: str | None) -> float:
        ids, x = self._features(text)
        v = self.factors[ids]
        vx = x @ v
        z = self.bias + x @ self.weights[ids] + 0.5 * (vx @ vx - (x * x) @ (v * v).sum(axis=1))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, float(z))))))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rank: int = 4, epochs: int = 40, rate: float = 0.07, l2_words: float = 3e-4, l2: float = 1e-5, seed: int = 11) -> Model:
    """Fit by Adam on the mean logistic loss over all rows."""
    w, v = np.zeros(DIM), np.random.default_rng(seed).normal(0, 0.05, (DIM, rank))
    if not len(rows):
        return Model(0.0, w, np.zeros((DIM, rank)))
    ids = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    used, col = np.unique(ids, return_inverse=True)
    sizes = np.array([len(r[0]) for r in rows])
    doc, starts = np.repeat(np.arange(len(rows)), sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(col, kind="stable")
    firsts = np.concatenate(([0], np.flatnonzero(np.diff(col[order])) + 1))
    decay = np.where(used < WORDS, l2_words, l2)
    p = np.concatenate((np.zeros((len(used), 1)), v[used]), axis=1)
    bias, m, s, mb, sb = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros_like(p), np.zeros_like(p), 0.0, 0.0
    for t in range(1, epochs + 1):
        px = p[col] * x[:, None]
        sums = np.add.reduceat(px, starts)
        squares = np.add.reduceat((px[:, 1:] ** 2).sum(axis=1), starts)
        z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        gx = (g[doc] * x)[:, None]
        each = np.concatenate((gx, gx * (sums[doc, 1:] - px[:, 1:])), axis=1)
        grad = np.add.reduceat(each[order], firsts) + decay[:, None] * p
        gb = g.sum()
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        p -= rate * (m / a) / (np.sqrt(s / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(sb / b) + 1e-8)
    v = np.zeros((DIM, rank))
    w[used], v[used] = p[:, 0], p[:, 1:]
    return Model(bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, most: int = 2000) -> Model:
    """Fit on the folds that are not held out."""
    train = labelled(labels, "quality", fold("doc_id", FOLDS) != HELD_OUT)
    chosen = bounded(train.select("doc_id"), most, 3).join(train, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            got = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["doc_id", "y", "ids", "x"])

    got = texts_of(docs, chosen).select("text", "doc_id", "y").mapInArrow(run, "doc_id long, y int, ids array<bigint>, x array<double>").toArrow().sort_by("doc_id")
    rows = [(np.asarray(i.values), np.asarray(x.values)) for i, x in zip(got["ids"], got["x"])]
    return fit_machine(rows, np.asarray(got["y"], np.float64))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    got = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
