"""Texts meet only where they share a shingle of their prefixes, and all that can be similar do."""

import itertools

import numpy as np
import pytest

from lodestone.llm import simhash


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    common = rng.permutation(np.arange(1, 60, dtype=np.uint64) * np.uint64(7))
    order, sets = np.argsort(common), []
    for _ in range(60):
        base = rng.choice(np.arange(500, dtype=np.uint64), rng.integers(1, 60), replace=False)
        sets += [np.sort(base), np.unique(np.concatenate((base[rng.random(len(base)) > 0.1], rng.integers(500, 510, 2).astype(np.uint64))))]
    heads, met = [simhash.prefix(s, common, order, 0.8) for s in sets], 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            met += 1
            assert len(np.intersect1d(heads[i], heads[j])) and simhash._fit(len(sets[i]), len(sets[j]), 0.8)
    assert met > 20
    # What many texts hold is taken last, the most frequent at the end.
    assert simhash.prefix(np.array([7, 9, 14], np.uint64), np.array([14, 7], np.uint64), np.array([1, 0]), 0.1).tolist() == [9, 14, 7]


def test_unlike_texts_are_not_compared(spark):
    """Before, every two signatures met; now 300 texts, two of which are alike, give rows of those two only."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(299)] + [(299, " ".join(f"w7x{k}" for k in range(49)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = docs.mapInArrow(lambda b: simhash._signed(b, 5), "node long, fp string, sig binary, size long, prefix array<bigint>")
    shared = simhash.shared_keys(signed)
    assert {r.node for r in shared.collect()} == {7, 299}
    links = simhash.candidate_links(shared, signed.withColumn("component", signed.node), 100, 20, 0.8, 8192)
    assert [tuple(r) for r in links.collect()] == [(7, 299)]


@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize("tile", [16, 50, 8192])
def test_cells_equal_all_pairs_of_a_key(spark, apart, tile):
    """Small cells together, a large one, and one dealt into tiles find what comparing all rows of a key finds."""
    rng, rows, shared = np.random.default_rng(6), [], []
    for key, n in ((1, 2), (2, 90), (3, 7), (4, 64), (5, 1)):
        centre = rng.integers(0, 1 << 62, (3, 8), dtype=np.uint64)
        for _ in range(n):
            sig = centre[rng.integers(3)] ^ (np.uint64(1) << rng.integers(0, 60, 8, dtype=np.uint64))
            shared.append((key, len(rows), n))
            rows.append((len(rows), bytearray(sig.tobytes()), int(rng.integers(90, 130)), int(rng.integers(5)) if apart else len(rows)))
    got = simhash.candidate_links(spark.createDataFrame(shared, "key long, node long, held long"), spark.createDataFrame(rows, "node long, sig binary, size long, component long"), 14, 20, 0.8, tile, apart)
    got = {tuple(r) for r in got.collect()}
    sig = [np.frombuffer(bytes(r[1]), np.uint64) for r in rows]
    near = lambda i, j: np.bitwise_count(sig[i] ^ sig[j]).sum() <= 14 and min(rows[i][2], rows[j][2]) >= 0.8 * max(rows[i][2], rows[j][2])
    every = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if shared[i][0] == shared[j][0] and near(i, j)}
    if apart:
        assert got == {(i, j) for i, j in every if rows[i][3] != rows[j][3]} and len(got) > 100
    else:
        assert got <= every and {i for p in got for i in p} and len(got) < len(every)
