"""The rebuild protocol, its manifest, and content digests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import digest
from lodestone.sources import generations, store
from lodestone.sources.shared import shared_folder

SIGNED = generations.Signature("c", "p", "m", 256, 500, 0, "0" * 64, "1" * 64)


def rows(spark, n, dims=256, first=0):
    return spark.range(first, first + n).select("id", F.array_repeat(F.lit(0.5), dims).alias("embedding"))


def test_rebuild_and_every_failure(spark, monkeypatch):
    path = shared_folder(spark, "store")
    assert generations.current(spark, path) is None
    assert generations.inspect_strict(spark, path, SIGNED) == "index_unavailable"
    made = generations.rebuild(spark, path, lambda: rows(spark, 5), lambda: SIGNED, "2026-01-01 00:00:00")
    assert made.count == 5 and generations.read_manifest(spark, path) == made
    assert generations.inspect_strict(spark, path, SIGNED) == "compatible"
    held = generations.current(spark, path)

    def fails(build=lambda: rows(spark, 7), signature=lambda: SIGNED, reset=True):
        with pytest.raises((store.StoreError, ZeroDivisionError)):
            generations.rebuild(spark, path, build, signature, "2026-01-02 00:00:00", reset)
        assert generations.current(spark, path) == held and generations.open_current(spark, path).count() == 5

    fails(reset=False)
    fails(signature=lambda: 1 / 0)
    fails(build=lambda: 1 / 0)
    fails(build=lambda: rows(spark, 7, dims=255))
    fails(build=lambda: rows(spark, 7).withColumn("embedding", F.when(F.col("id") > 2, F.col("embedding"))))
    signs = iter([SIGNED, generations.Signature("c", "p", "m", 256, 500, 0, "0" * 64, "2" * 64)])
    fails(signature=lambda: next(signs))
    whole = generations._Files.replace
    for broken in ("manifest.json", "CURRENT"):
        monkeypatch.setattr(generations._Files, "replace", lambda self, name, text, b=broken: 1 / 0 if name.endswith(b) else whole(self, name, text))
        fails()
    monkeypatch.setattr(generations._Files, "replace", whole)

    def meanwhile():  # another run commits while this one builds
        if generations.current(spark, path) == held:
            generations._Files(spark, path).replace("CURRENT", f"other\n{held}")
        return rows(spark, 7)

    with pytest.raises(store.StoreError):
        generations.rebuild(spark, path, meanwhile, lambda: SIGNED, "2026-01-02 00:00:00", True)
    assert generations.current(spark, path) == "other"
    generations._Files(spark, path).replace("CURRENT", held)

    assert len(generations._Files(spark, path).folders("generations")) > 3
    before = generations.open_current(spark, path)
    again = generations.rebuild(spark, path, lambda: rows(spark, 3), lambda: SIGNED, "2026-01-03 00:00:00", True)
    assert generations.open_current(spark, path).count() == 3 and before.count() == 5  # a reader keeps its generation
    left = generations._Files(spark, path).folders("generations")
    assert again.generation in left and len(left) == 2
    assert generations.clean(spark, path, 0) and generations._Files(spark, path).folders("generations") == [again.generation]


def test_eight_reasons(spark):
    path = shared_folder(spark, "store")
    made = generations.rebuild(spark, path, lambda: rows(spark, 4), lambda: SIGNED, "2026-01-01 00:00:00")
    files, file = generations._Files(spark, path), f"generations/{made.generation}/manifest.json"
    text = files.read(file)
    other = lambda **k: generations.Signature(**{**vars(SIGNED), **k})
    assert generations.inspect_strict(spark, path, other(model="n")) == "settings_mismatch"
    assert generations.inspect_strict(spark, path, other(content_sha256="3" * 64)) == "content_mismatch"
    for broken in ("[]", "{", text.replace('"count":4', '"count":4,"more":1'), text.replace('"count":4', '"count":"4"'), text.replace('"count":4', '"count":true'), text.replace('"dimensions":256', '"dimensions":64')):
        files.replace(file, broken)
        assert generations.inspect_strict(spark, path, SIGNED) == "invalid_manifest"
    files.replace(file, text.replace('"count":4', '"count":5'))
    assert generations.inspect_strict(spark, path, SIGNED) == "chunk_count_mismatch"
    files.remove(file)
    assert generations.inspect_strict(spark, path, SIGNED) == "missing_manifest"
    empty = shared_folder(spark, "store")
    generations.rebuild(spark, empty, lambda: rows(spark, 0), lambda: SIGNED, "2026-01-01 00:00:00")
    assert generations.inspect_strict(spark, empty, SIGNED) == "empty_index"
    generations.rebuild(spark, empty, lambda: rows(spark, 1), lambda: SIGNED, "2026-01-01 00:00:01")  # an empty one needs no reset
    files.replace("CURRENT", "gone")
    assert generations.inspect_strict(spark, path, SIGNED) == "index_unavailable"


def test_digest_tree(spark):
    data = [(i, None if i % 5 == 0 else f"t{i}") for i in range(300)] + [(7, "t7")]
    df = spark.createDataFrame(data, "b int, a string")
    rows_ = [hashlib.sha256(json.dumps({"a": a, "b": b}, separators=(",", ":")).encode()).hexdigest() for b, a in data]
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    ranges = {r: sha(sorted(d for d in rows_ if d[:2] == r)) for r in {d[:2] for d in rows_}}
    groups = {g: sha(ranges[r] for r in sorted(ranges) if r[0] == g) for g in {r[0] for r in ranges}}
    found = digest.leaves(df.repartition(7), 2)
    assert {r.range: r.digest for r in found.collect()} == ranges
    assert digest.root(df.repartition(3), 2) == (sha(groups[g] for g in sorted(groups)), 301) == digest.root(df.orderBy("a"), 2)
    assert digest.root(df.distinct(), 2)[0] != digest.root(df, 2)[0]
    diff = digest.changed(found, digest.leaves(df.where("b <> 11"), 2)).collect()
    assert len(diff) == 1 and diff[0].rows_a - diff[0].rows_b == 1
    assert digest.root(df.limit(0)) == (hashlib.sha256(b"").hexdigest(), 0)
