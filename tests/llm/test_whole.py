"""Each operator does its whole job: nothing is left out for size, order or phase."""

import collections

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import embdup, lm, mixer, substring


def test_word_pairs_are_kept_exactly_and_grow_with_the_text():
    rng = np.random.default_rng(5)
    sizes = []
    for n in (2_000, 8_000):
        context = rng.integers(0, n // 4, n).astype(np.uint64)
        pairs = context << np.uint64(mixer.WORD_BITS) | rng.integers(0, 3, n).astype(np.uint64)
        train = rng.random(n) < 0.8
        counts = np.where(train, rng.integers(1, 4, n), 1).astype(np.uint32)
        got = mixer.guess_codes(pairs, counts, train)
        after = collections.defaultdict(collections.Counter)
        for p, c, t in zip(pairs.tolist(), counts.tolist(), train):
            after[p >> 24][p & 0xFFFFFF] += c * bool(t)
        sizes.append(len(after))
        for i in range(0, n, 7):
            here = collections.Counter(after[int(pairs[i]) >> 24])
            word = int(pairs[i]) & 0xFFFFFF
            here[word] -= int(train[i])
            total = sum(here.values())
            if not total:
                assert got[i] == 0
                continue
            guess = min(here, key=lambda k: (-here[k], k))
            steps = lambda k: min(4, int(np.ceil(np.log2(max(1, k)))))
            assert got[i] == 1 + 5 * steps(here[guess]) + steps(total - here[guess] + 1) + mixer.HIT * (guess == word)
    assert sizes[1] > 3 * sizes[0]


def test_lm_learns_from_every_training_text(spark):
    texts = [(i, " ".join(f"w{(i * 7 + k * k) % 400}" for k in range(40))) for i in range(1800)]
    seen = []
    real = lm.learned

    def spy(blocks, *rest):
        seen.append(blocks.select(F.explode("train").alias("x")).agg(F.sum(F.col("x").cast("int"))).first()[0])
        return real(blocks, *rest)

    lm.learned = spy
    try:
        got = lm.score(spark.createDataFrame(texts, "doc_id long, text string"), head=300).toPandas()
    finally:
        lm.learned = real
    assert seen == [int((~got.held_out).sum())] and seen[0] > 1500


def test_a_long_passage_is_found_whatever_surrounds_it(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"{a}{b}" for a, b in zip(rng.choice(list("bcdfgh"), n), rng.integers(0, 3000, n))]
    plain = " ".join(word(70))  # no sentence ends
    short = " ".join(" ".join(word(2)) + "." for _ in range(35))
    lines = "\n".join(" ".join(word(3)) for _ in range(25))
    rows = []
    for k, passage in enumerate((plain, short, lines)):
        gap = "\n" if k == 2 else " "
        for copy in range(2):
            before = gap.join(" ".join(word(3)) + ("." if k == 1 else "") for _ in range(40 + 3 * copy))
            rows.append((2 * k + copy, f"{before}{gap}{passage}{gap}{' '.join(word(20))}"))
    got = {r.doc_id: r.text.split() for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    windows = lambda w: {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
    for k in range(3):
        assert windows(rows[2 * k][1].split()) & windows(rows[2 * k + 1][1].split())
        assert not windows(got[2 * k]) & windows(got[2 * k + 1])


def test_collisions_are_counted_by_windows():
    rng = np.random.default_rng(7)
    p, q = rng.standard_normal((40, 9)), np.round(rng.standard_normal((70, 9)), 1)
    p[:5] = q[:5]
    assert (embdup.collisions(p, q, 0.5) == ((p[:, None] - 0.5 <= q[None]) & (q[None] <= p[:, None] + 0.5)).sum(axis=2)).all()


def test_planted_pairs_are_found_where_cells_are_many(spark):
    rng = np.random.default_rng(9)
    n, planted = 6000, 500
    unit = rng.standard_normal((n, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for k in range(planted):  # cosine 0.95 to 0.96 with the vector before it
        c, other = 0.9502 + 0.0098 * rng.random(), rng.standard_normal(64)
        base = unit[2 * k]
        other -= (other @ base) * base
        unit[2 * k + 1] = c * base + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
    assert embdup.Design.of(n, 0.95).used > 1
    got = embdup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert want.sum() >= 2 * planted and (got.n_links.values <= want).all()
    recall = got.n_links.sum() / want.sum()
    print(f"recall {recall:.4f}")
    assert recall >= 0.99
