"""The corrected risk, its gradient, the cut and the whole classifier, against plain computations and held-out labels."""

import math
import zlib

import numpy as np
import pandas as pd
import pytest

from lodestone.llm import queries, toxicity

LARGE = "/root/testdata/sf0.1"


def _plain_risk(w, positive, unlabelled, prior):
    """(positive part, negative part) by the definition, document by document."""
    z = lambda d: w[-1] + sum(w[f] for f in d)
    loss = lambda v: math.log1p(math.exp(-v))
    mean = lambda docs, sign: sum(loss(sign * z(d)) for d in docs) / len(docs)
    return prior * mean(positive, 1), mean(unlabelled, -1) - prior * mean(positive, -1)


def test_risk_and_gradient_equal_a_plain_computation():
    rng = np.random.default_rng(3)
    draw = lambda n: [np.flatnonzero(rng.random(5) < 0.4) for _ in range(n)]
    positive, unlabelled, w = draw(7), draw(11), rng.normal(size=6)
    rows = toxicity._hits(np.arange(5), positive), toxicity._hits(np.arange(5), unlabelled)
    gain, rest, up, down = toxicity.risk(w, *rows, 0.2)
    assert (gain, rest) == pytest.approx(_plain_risk(w, positive, unlabelled, 0.2))
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-5
        above, below = _plain_risk(w + step, positive, unlabelled, 0.2), _plain_risk(w - step, positive, unlabelled, 0.2)
        assert (up[k], down[k]) == pytest.approx([(a - b) / 2e-5 for a, b in zip(above, below)], abs=1e-7)


def test_the_negative_part_stays_near_zero_or_above():
    rng = np.random.default_rng(5)
    positive = [np.array([1, *rng.integers(10, 400, 3)]) for _ in range(60)]
    unlabelled = [np.sort(rng.integers(10, 400, 4)) for _ in range(200)] + positive[:20]
    kept, weights, bias = toxicity.fit_nnpu(positive, unlabelled, 0.3)
    w = np.append(weights, bias)
    _, rest, _, _ = toxicity.risk(w, toxicity._hits(kept, positive), toxicity._hits(kept, unlabelled), 0.3)
    assert 1 in kept and rest > -0.02


def test_the_cut_has_the_best_estimated_f():
    rng = np.random.default_rng(6)
    positive, unlabelled = rng.normal(1, 1, 40).round(1), rng.normal(-1, 1, 90).round(1)
    f = lambda c: 2 * 0.1 * (positive >= c).mean() / ((unlabelled >= c).mean() + 0.1)
    at = np.unique([*positive, *unlabelled])
    assert f(toxicity.best_cut(positive, unlabelled, 0.1)) == max(f(c) for c in (at[1:] + at[:-1]) / 2)
    assert toxicity.best_cut(np.zeros(3), np.zeros(2), 0.1) is None


def test_calibration_moves_the_bias_only_and_stands_few_rows():
    positive, unlabelled = [np.array([1, 2])] * 20, [np.array([1, 2])] * 2 + [np.array([3])] * 18
    kept, weights, _ = toxicity.fit_nnpu(positive, unlabelled, 0.1)
    got = toxicity.fit_calibrated(positive, unlabelled, 0.1)
    assert (got[0] == kept).all() and (got[1] == weights).all() and np.isfinite(got[2])
    assert toxicity.fit_calibrated([np.array([1])], [np.array([1])], 0.5)[2] is not None
    assert toxicity.fit_calibrated([], [np.array([1])], 0.5)[2] == -50.0


def test_held_out_recall_precision_and_area(spark):
    got = queries.QUERIES["op10_toxicity"](spark, LARGE).toPandas()
    labels = pd.read_parquet(f"{LARGE}/labels.parquet")
    both = got.merge(labels, on="doc_id")
    both = both[[zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]]
    yes = both.toxic == 1
    rank = both.score.rank()
    area = (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())
    assert both.held_out.all() and (both.predicted == (both.score >= 0.7)).all()
    assert both.predicted[yes].mean() >= 0.9 and yes[both.predicted == 1].mean() >= 0.95 and area >= 0.96


def test_the_fit_holds_no_second_copy_of_the_features():
    """Only what is found is held beside the features, some documents at a time; results are those of plain counts."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(12)
    docs = [np.unique(rng.integers(0, 400_000, 2000)).astype(np.uint32) + 10 for _ in range(1200)]
    docs = [np.append(np.uint32([1, 2]), d) if k % 4 == 0 else d for k, d in enumerate(docs)]
    rows = pa.table({"doc_id": [*range(1200)][::-1], "y": pa.array([int(k % 4 == 0) for k in range(1200)], pa.int32()), "f": pa.array([d.tobytes() for d in docs], pa.binary())})
    tracemalloc.start()
    got = toxicity._learn(rows, 0.2, 0.7).to_pylist()[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["kept"] and most < 2.5 * sum(4 * len(d) for d in docs)
    own = [[d for d, y in zip(docs[::-1], rows["y"].to_pylist()[::-1]) if y == is_y] for is_y in (1, 0)]
    whole = toxicity.fit_calibrated(*([d.astype(np.int64) for d in some] for some in own), 0.2, 0.7)
    among = sum(np.bincount(col, minlength=3) for _, col in toxicity._found(np.array([1, 2, 400_020]), own[0]))
    assert among.tolist() == [300, 300, 0]
    assert got["kept"] == whole[0].tolist() and got["weights"] == whole[1].tolist() and got["bias"] == whole[2]
