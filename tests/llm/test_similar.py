"""Near copies by verified signatures, against brute force over all pairs of shingle sets."""

import itertools
import tracemalloc

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lodestone.llm import simhash

MID = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def roots(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return [top(i) for i in range(n)]


def test_groups_equal_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    sets, ids = [shingles(t) for t in docs.text], docs.doc_id.tolist()
    want = roots(len(ids), [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if alike(sets[i], sets[j]) >= 0.8])
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.similar(frame, tile=64).collect()}
    assert got == {i: ids[r] for i, r in zip(ids, want)} and len(set(want)) < len(ids)
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, frame, sf)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted({ids[r] for r in want})


def test_recall_of_changed_copies(spark):
    rng, rows, of = np.random.default_rng(0), [], []
    base = [t for t in pd.read_parquet(f"{MID}/documents.parquet").text if 150 <= len(t.split()) <= 600][:100]
    for t in base:
        first, words = len(rows), t.split()
        rows.append((first, t))
        for _ in range(8):
            v = list(words)
            for i in rng.choice(len(v), rng.integers(1, max(2, len(v) // 30)), replace=False):
                v[i] = f"q{rng.integers(10**6)}"
            if alike(shingles(t), shingles(" ".join(v))) >= 0.8:
                of.append((len(rows), first))
                rows.append((len(rows), " ".join(v)))
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(of) > 300 and np.mean([got[i] == got[first] for i, first in of]) >= 0.95


def test_texts_below_the_similarity_stay_apart(spark):
    words = [f"w{i}" for i in range(104)]
    far = words[:50] + [f"x{i}" for i in range(6)] + words[56:]  # 90 of 110 shingles are shared: 0.818
    farther = words[:50] + [f"y{i}" for i in range(8)] + words[58:]  # 88 of 112: 0.786
    rows = [(3, " ".join(words)), (2, " ".join(far)), (1, " ".join(farther))]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 2, 2: 2, 1: 1}


def test_odd_rows(spark):
    long = " ".join(f"n{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, long), (7, long + " end"), (7, "another text"), (None, "no id here"), (None, "no id here"), (8, "no  ID here")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    kept = sorted(((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in simhash.keep_similar(frame).collect()))
    assert kept == [(False, 1, 0), (False, 4, 7), (False, 6, len(long)), (False, 7, 12), (False, 8, 11)]
    assert simhash.keep_similar(frame.limit(0)).count() == 0


def test_signature_counts_bits():
    h = simhash.shingle_hashes("a b c d e f g a b c d e", 5)
    mixed = []
    for x in h.tolist():
        words = []
        for k in range(1, 9):
            z = (x + k * 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
            words.append(z ^ (z >> 31))
        mixed.append(sum(z << (64 * k) for k, z in enumerate(words)))
    want = sum(1 << b for b in range(512) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed))
    assert int.from_bytes(simhash.signature(h), "little") == want


@pytest.mark.parametrize("same", [True, False])
def test_tiles_reach_all_pairs_within_the_radius(same):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2**63, (6, 8)).astype(np.uint64)
    a = centre[rng.integers(0, 6, 40)] ^ (np.uint64(1) << rng.integers(0, 64, (40, 8)).astype(np.uint64))
    b = a if same else centre[rng.integers(0, 6, 30)] ^ (np.uint64(1) << rng.integers(0, 64, (30, 8)).astype(np.uint64))
    every = np.concatenate([a] if same else [a, b])
    near = lambda i, j: np.bitwise_count(every[i] ^ every[j]).sum() <= 14
    pairs = [(i, j) for i in range(40) for j in (range(i + 1, 40) if same else range(40, 70)) if near(i, j)]
    got = simhash.signature_links(a, b, 14, 26, same)
    assert {tuple(p) for p in got.T.tolist()} <= set(pairs)
    assert roots(len(every), got.T.tolist()) == roots(len(every), pairs)


def test_every_pair_within_the_radius_decides(spark):
    """Variants at about the wanted similarity: a forest and the nearest alone leave some of their links out."""
    rng, rows = np.random.default_rng(2), []
    for k in range(8):
        base = [f"w{k}x{i}" for i in range(400)]
        for _ in range(30):
            v = list(base)
            for i in rng.choice(len(v), rng.integers(3, 8), replace=False):
                v[i] = f"q{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(v)))
    sets = [shingles(t) for _, t in rows]
    sigs = np.array([np.frombuffer(simhash.signature(simhash.shingle_hashes(t)), np.uint64) for _, t in rows])
    near = lambda i, j: np.bitwise_count(sigs[i] ^ sigs[j]).sum() <= 100 and np.bitwise_count(sigs[i, 0] ^ sigs[j, 0]) <= 20
    want = roots(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near(i, j) and alike(sets[i], sets[j]) >= 0.8])
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_few_signatures_are_copied_at_once():
    """Where all pairs of a step are alike, each would bring two copies of 64 bytes and their difference."""
    rng = np.random.default_rng(8)
    one = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    a, b = (one ^ (np.uint64(1) << rng.integers(0, 60, (n, 8), dtype=np.uint64)) for n in (1024, 512))
    plain = np.bitwise_count(a[:, None] ^ b[None, :]).sum(axis=2, dtype=np.int64)
    apart = np.arange(1024), np.arange(1024, 1536)
    tracemalloc.start()
    links = simhash.signature_links(a, b, 100, 20, False)
    pairs = simhash.signature_pairs(a, b, *apart, 100, 20, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs.shape[1] == 1024 * 512 and (plain <= 100).all()
    nearest = {(r, 1024 + int(c)) for r, c in enumerate(plain.argmin(axis=1))}
    assert nearest <= set(map(tuple, links.T.tolist()))
    assert most < 70e6, f"{most / 1e6:.0f} MB"
