"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic training rows are the positives; training rows of the label table, whose labels are not looked at, are
the unlabelled set, so that the class prior, the share of confirmed rows in that table, is the prior of this very set. A
linear classifier over hashed words and word beginnings is trained in numpy by the class-prior-corrected risk
prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]),  whose negative part is kept from falling below zero.
The bias is then moved so that the threshold falls where the F measure is best, as estimated from the prior on folds that
the fit did not see. Scoring reads each whole text once, without a shuffle; the model is a bounded table of weights.

Bounds: the fit, in one task, takes at most `most_positive` and `most_unlabelled` labelled rows, chosen by a hash of the
id; every text is scored.
Defined results: a null or empty text gets the score of no evidence; a null id is not held out; repeated rows get equal
scores; if there are no positives, every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lodestone.llm._common import fold, let_go, row_of
from lodestone.llm._sample import bounded, labelled, texts_of

_EDGES = ".,;:!?\"'()[]{}|*%$&#"
_MEMO_WORDS = 150_000
FOLDS, HELD_OUT = 3, 1


def word_features(word: str) -> tuple[int, ...]:
    """Hashed ids of a word and of its beginnings of 3 to 8 letters."""
    w = word.strip(_EDGES)
    return tuple(crc32(x.encode()) for x in {"w" + w, *("p" + w[:n] for n in range(3, min(9, len(w) + 1)))}) if w else ()


def text_features(text: str | None) -> set[int]:
    return {f for w in set((text or "").lower().split()) for f in word_features(w)}


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 200, rate: float = 0.1, l2: float = 1e-6, least_positive: int = 3, least_ratio: float = 4.0, least_z: float = 3.5, least_weight: float = 0.3) -> tuple[np.ndarray, np.ndarray, float]:
    """Kept feature ids (ascending), their weights, and the bias.

    Features are kept that are `least_ratio` times as frequent among the positives as in the unlabelled texts, by
    `least_z` standard deviations, and that get `least_weight` at least in a first fit: in long texts the small
    weights of chance features would add up.
    """
    if not positive or not unlabelled:
        return np.zeros(0, np.int64), np.zeros(0), -50.0
    seen_ids, seen = np.unique(np.concatenate(positive), return_counts=True)
    common = seen >= min(least_positive, len(positive))
    seen_ids, seen = seen_ids[common], seen[common]
    among = np.zeros(len(seen_ids), np.int64)
    for _, col in _found(seen_ids, unlabelled) if len(seen_ids) else ():
        among += np.bincount(col, minlength=len(seen_ids))
    expected = among * (len(positive) / len(unlabelled))
    kept = seen_ids[(seen >= least_ratio * expected) & (seen - expected >= least_z * np.sqrt(expected + 0.5))]
    if not len(kept):
        return kept, np.zeros(0), -50.0

    for again in (False, True):
        weights, bias = _descend(kept, positive, unlabelled, prior, epochs, rate, l2)
        strong = weights >= least_weight
        if again or not strong.any():
            break
        kept = kept[strong]
    return kept, weights, bias


def _found(kept: np.ndarray, docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, place in `kept`) of every kept feature, 64 documents at a time."""
    for at in range(0, len(docs), 64):
        some = docs[at : at + 64]
        found = np.concatenate(some)
        col = np.minimum(np.searchsorted(kept, found), len(kept) - 1)
        hit = kept[col] == found
        yield np.repeat(np.arange(at, at + len(some), dtype=np.int32), [len(d) for d in some])[hit], col[hit].astype(np.int32)


def _hits(kept: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, place in `kept`) of every kept feature of the documents, and the number of documents."""
    doc, col = (np.concatenate(x) for x in zip(*_found(kept, docs)))
    return doc, col, len(docs)


def risk(w: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Positive and negative part of the corrected risk (logistic loss) and their gradients; the bias is the last of `w`."""
    (pd, pc, n_p), (ud, uc, n_u) = positive, unlabelled

    def gradient(doc: np.ndarray, col: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, weights=g[doc], minlength=len(w) - 1), g.sum())

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    zp = np.bincount(pd, weights=w[pc], minlength=n_p) + w[-1]
    zu = np.bincount(ud, weights=w[uc], minlength=n_u) + w[-1]
    sp, su = sigmoid(zp), sigmoid(zu)
    gain = prior * np.logaddexp(0, -zp).mean()
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return gain, rest, gradient(pd, pc, prior * (sp - 1) / n_p), gradient(ud, uc, su / n_u) - gradient(pd, pc, prior * sp / n_p)


def _descend(kept: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights of the kept features and the bias, by Adam on the non-negative risk."""
    rows = _hits(kept, positive), _hits(kept, unlabelled)
    w = np.zeros(len(kept) + 1)
    w[-1] = -2.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        _, rest, up, down = risk(w, *rows, prior)
        g = up + down if rest >= 0 else -down
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float | None:
    """The logit between two given ones at which  2 * prior * recall / (share of unlabelled + prior),  the F measure as
    the prior gives it, is greatest; the highest of equals. None if there is nothing to choose."""
    at = np.unique(np.concatenate((positive, unlabelled)))
    if len(at) < 2:
        return None
    cuts = (at[1:] + at[:-1]) / 2
    recall = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    share = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    f = 2 * prior * recall / (share + prior)
    return float(cuts[np.flatnonzero(f == f.max())[-1]])


def fit_calibrated(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, threshold: float = 0.7, folds: int = 4, few: float = 50.0) -> tuple[np.ndarray, np.ndarray, float]:
    """`fit_nnpu` with its bias moved so that `threshold` is the score of the best cut.

    The cut is chosen on logits of documents that their fold's fit did not see; equal documents share a fold. With
    few positives it says little: n of them move the bias n / (n + `few`) of the way.
    """
    kept, weights, bias = fit_nnpu(positive, unlabelled, prior)
    if not len(kept):
        return kept, weights, bias
    of_p, of_u = ([crc32(d.astype(np.int64).tobytes()) % folds for d in docs] for docs in (positive, unlabelled))
    seen: list[list[float]] = [[], []]
    for k in range(folds):
        rest = [d for d, f in zip(positive, of_p) if f != k], [d for d, f in zip(unlabelled, of_u) if f != k]
        ids, w, b = fit_nnpu(*rest, prior)
        for z, docs, of in ((seen[0], positive, of_p), (seen[1], unlabelled, of_u)):
            mine = [d for d, f in zip(docs, of) if f == k]
            if mine:
                doc, col, n = _hits(ids, mine) if len(ids) else ([], [], len(mine))
                z += (np.bincount(doc, weights=w[col], minlength=n) + b).tolist() if len(doc) else [b] * n
    cut = best_cut(np.array(seen[0]), np.array(seen[1]), prior)
    if cut is None:
        return kept, weights, bias
    aim = float(np.log(threshold / (1 - threshold)))
    return kept, weights, bias + (aim - cut) * len(positive) / (len(positive) + few)


class Scorer:
    """Toxicity scores of texts under a fitted model."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self._weight = dict(zip(kept.tolist(), weights.tolist()))
        self._bias = bias
        self._memo: dict[str, tuple[int, ...]] = {}

    def _known(self, word: str) -> tuple[int, ...]:
        got = self._memo.get(word)
        if got is None:
            got = tuple(f for f in word_features(word) if f in self._weight)
            if len(self._memo) < _MEMO_WORDS:
                self._memo[word] = got
        return got

    def __call__(self, text: str | None) -> float:
        found: set[int] = set()
        for word in set((text or "").lower().split()):
            found.update(self._known(word))
        z = self._bias + sum(map(self._weight.__getitem__, sorted(found)))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))


def _learn(rows: pa.Table, prior: float, threshold: float) -> pa.Table:
    """One row (kept, weights, bias): the fit on (doc_id, y, f), whose features stay where the table holds them."""
    let_go()
    order, y, f = pc.sort_indices(rows["doc_id"]).to_numpy(), rows["y"].to_numpy(), rows["f"]
    of = [[np.frombuffer(f[int(k)].as_buffer(), np.uint32) for k in order[y[order] == is_y]] for is_y in (1, 0)]
    kept, weights, bias = fit_calibrated(*of, prior, threshold)
    return pa.table({"kept": pa.array([kept.astype(np.int64)], pa.list_(pa.int64())), "weights": pa.array([weights], pa.list_(pa.float64())), "bias": [bias]})


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 2000, most_unlabelled: int = 6000, threshold: float = 0.7) -> Scorer:
    """Fit on the folds that are not held out, calibrated for `threshold`; the driver gets no more than the features that are
    kept."""
    train = labelled(labels, "toxic", fold("doc_id", FOLDS) != HELD_OUT)
    positive = bounded(train.where("y = 1").select("doc_id"), most_positive, 1).withColumn("y", F.lit(1))
    chosen = positive.unionByName(bounded(train.select("doc_id"), most_unlabelled, 2).withColumn("y", F.lit(0)))
    prior = min(0.9, train.agg(F.avg("y")).first()[0] or 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                text, doc_id, y = b.slice(at, 256).columns
                found = [np.array(sorted(text_features(t.as_py())), np.uint32).tobytes() for t in text]
                yield pa.RecordBatch.from_arrays([doc_id, y, pa.array(found, pa.binary())], ["doc_id", "y", "f"])

    rows = texts_of(docs, chosen).select("text", "doc_id", "y").mapInArrow(features, "doc_id long, y int, f binary")
    got = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: _learn(t, prior, threshold), "kept array<bigint>, weights array<double>, bias double").first()  # a bounded sample
    return Scorer(*((np.zeros(0, np.int64), np.zeros(0), -50.0) if got is None else (np.array(got["kept"], np.int64), np.array(got["weights"]), got["bias"])))


def _scores(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    let_go()
    for b in batches:
        text = b.column(b.schema.get_field_index("text"))
        yield b.append_column("score", pa.array([scorer(t.as_py()) for t in text], pa.float64()))


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _scores(batches, scorer):
            yield b.select(["doc_id", "score"])

    got = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted toxic."""
    # A text travels once, within its row, unless it has to be cast.
    at = [c.lower() for c in docs.columns].index("text")
    inside = isinstance(docs.schema[at].dataType, StringType)
    rows = docs.select(row_of(docs).alias("_row"), *([] if inside else [F.col("text").cast("string").alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            keep = pa.array([scorer(t.as_py()) < threshold for t in (b.column(0).field(at) if inside else b.column(1))], pa.bool_())
            yield b.filter(keep).select([0])

    return rows.mapInArrow(run, StructType([rows.schema["_row"]])).select("_row.*")
