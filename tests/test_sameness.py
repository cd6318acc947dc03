"""The walk over lines finds what comparing all pairs finds, and compares few of them."""

import random

import pytest

from lodestone.operators import compress, sameness


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("some,most", [(["ab", "cde", "fghi", "jk", "lmnop"], 9), (["a", "b", "가나", "c d", "ñx", "z9"], 5), (["registration", "internationalisation", "of", "documents", "x"], 12)])
def test_equal_brute_force(some, most, least):
    rng, parts = random.Random(1), sameness._PARTS
    line = lambda: rng.choice([" ", "-", "", " , "]).join(rng.choice(some) for _ in range(rng.randrange(most)))
    a, b = [line() for _ in range(60)], [line() for _ in range(150)]
    b += [a[0], a[1] + " q", a[2] + " " + a[3], "", " ", a[4] * 30]
    pa, pb = ([{r: f(x) for r, f in parts.items()} for x in side] for side in (a, b))
    want = {(j, i, r) for j, q in enumerate(pb) for i, p in enumerate(pa) for r in parts if sameness._holds(r, p[r], q[r], least)}
    got = list(sameness.Asked(a, least).found(b))
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_unlike_lines_are_not_measured(monkeypatch):
    words, rng = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}q" for i in range(400)], random.Random(2)
    line = lambda: " ".join(rng.sample(words, 20))
    a, b, seen = [line() for _ in range(50)], [line() for _ in range(500)], []
    monkeypatch.setattr(sameness, "_holds", lambda *x, f=sameness._holds: seen.append(x) or f(*x))
    assert set(sameness.Asked(a, 0.8).found([*b, a[7]])) == {(500, 7, r) for r in sameness._PARTS}
    assert len(seen) < 1500  # of 75,150


def test_details_are_not_taken_apart_as_rows(spark):
    """Before, character runs and words of details were arrays and rows; blocks of lines give the same, too."""
    a = spark.createDataFrame([(i, f"line {i} of the asked ones") for i in range(30)] + [(3, "x")], "id int, line string")
    b = spark.createDataFrame([(i, f"Line {i % 40} of the ASKED ones" if i % 2 else f"other {i} x y") for i in range(60)], "id long, line string")
    one, many = compress.same_lines(a, b), compress.same_lines(a, b, block=4)
    rows = lambda df: sorted((r.a_id, r.a_line, r.b_id, tuple(r.reasons)) for r in df.collect())
    assert rows(one) == rows(many) and len(rows(one)) > 30
    plan = one._jdf.queryExecution().toString()
    assert "explode" not in plan and "transform" not in plan
