"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are collapsed to the distinct ones, which are dealt into tiles by their population count. Two fingerprints
within the radius have population counts within the radius, so only such tiles meet; each pair of tiles is one bounded
piece of work (exclusive-or and bit counts in numpy). A pair of tiles returns a spanning forest of its links, so that a
group of copies costs its size, and the forests are joined by `components`.

`keep_similar` is the same for near copies in the sense of sets: signatures of 512 bits over five-word shingles, whose
wide radius proposes pairs among texts that share a rare shingle, as all similar ones do, and the Jaccard similarity of
the whole texts' shingle sets, which decides.

Defined results: a null or empty text has fingerprint zero and links like any other; repeated rows get the same result;
rows without a doc_id take part, and a component of such rows only has a null component_id; an empty table gives no
rows; columns other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import checkpoint, let_go, row_of
from lodestone.llm._forest import Forest
from lodestone.llm.components import named_components

_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the text's word shingles, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = shingles[at : at + _CHUNK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: _fingerprints(b, width), "doc_id long, fp long")


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles of distinct unsigned fingerprints, as two arrays of them."""
    forest, step = Forest(len(a) + len(b)), max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), step):
        r, c = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        if len(r):
            forest.add(r + at, c + len(a))
    both = np.concatenate((a, b))
    x, y = forest.links()
    return both[x], both[y]


def _cell(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of the pairs of tiles that meet in a cell: each tile of the one group with each of the other, or of one group
    with itself; pairs whose population counts differ beyond the radius are skipped."""
    tiles = [(p, n, np.asarray(f, np.int64).view(np.uint64), second) for p, n, f, second in zip(pdf.p, pdf.tile, pdf.fps, pdf.second)]
    own = pdf.x.iloc[0] == pdf.y.iloc[0]
    out = [(np.zeros(0, np.uint64),) * 2]
    for p, n, a, second in tiles:
        for q, m, b, other in tiles:
            if (n <= m if own else not second and other) and abs(p - q) <= radius:
                x, y = tile_links(a, b, radius)
                out.append((x[x != y], y[x != y]))
    return pd.DataFrame({c: np.concatenate([o[k] for o in out]).view(np.int64) for k, c in enumerate("ab")})


def fingerprint_links(distinct: DataFrame, radius: int = 4, tile: int = 16384) -> DataFrame:
    """(a, b): links that join every two of the distinct fingerprints `fp` within the radius, directly or by others."""
    counts = {r["p"]: r["n"] for r in distinct.groupBy(F.expr("bit_count(fp)").alias("p")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    tiles = [-(-counts.get(p, 0) // tile) for p in range(65)]
    k = F.array(*[F.lit(n) for n in tiles])
    p = F.expr("bit_count(fp)")
    dealt = distinct.select("fp", p.alias("p"), F.pmod(F.xxhash64("fp"), F.greatest(F.element_at(k, p + 1), F.lit(1))).cast("int").alias("s"))
    packed = dealt.groupBy("p", "s").agg(F.collect_list("fp").alias("fps"))
    # Tiles are numbered in order of their population counts and dealt into groups of `side`; two groups that hold counts
    # within the radius meet in one cell, so that a tile is sent once for each group it meets and not for each tile.
    before, at = [], 0
    for n in tiles:
        before.append(at)
        at += n
    of = [p for p, n in enumerate(tiles) for _ in range(n)]
    side = max(1, math.isqrt(len(of)) // 4)
    groups = -(-len(of) // side)
    low, high = [of[g * side] for g in range(groups)], [of[min(len(of), (g + 1) * side) - 1] for g in range(groups)]
    meets = [[h for h in range(groups) if low[max(g, h)] - high[min(g, h)] <= radius] for g in range(groups)]
    if not groups:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    number = F.element_at(F.array(*map(F.lit, before)), F.col("p") + 1) + F.col("s")
    sent = packed.select("p", number.alias("tile"), "fps", F.floor(number / side).cast("int").alias("g"))
    to = F.element_at(F.array(*(F.array(*map(F.lit, m)) for m in meets)), F.col("g") + 1)
    cells = sent.select("p", "tile", "fps", "g", F.explode(to).alias("h")).select("p", "tile", "fps", F.least("g", "h").alias("x"), F.greatest("g", "h").alias("y"), (F.col("g") > F.col("h")).alias("second"))
    return cells.groupBy("x", "y").applyInPandas(lambda pdf: _cell(pdf, radius), "a long, b long")


def _found(docs: DataFrame, radius: int, width: int, tile: int) -> DataFrame:
    """(doc_id, fp, component, component_id) for every document."""
    fps = checkpoint(fingerprints(docs, width))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    by_fp = named_components(classes.withColumnRenamed("fp", "node"), fingerprint_links(classes.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    return fps.join(checkpoint(by_fp).hint("merge"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, tile: int = 16384) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document; component_id is the smallest doc_id reachable."""
    return _found(docs, radius, width, tile).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4, tile: int = 16384) -> DataFrame:
    """The documents, all columns, of which one row of each group of near-duplicates stays: the one with the smallest id
    and, of rows with that id, the smallest fingerprint and then the smallest hash of the text.

    Rows without an id stay only where no document of their group has one. A group is known by its fingerprints, so that
    rows of one id in different groups do not take each other's place.
    """
    return _one_of_each(docs, checkpoint(_found(docs, radius, width, tile)), fingerprint_column(width))


def _one_of_each(docs: DataFrame, found: DataFrame, fp_of) -> DataFrame:
    """The row of `docs` that stays for each component of `found` (doc_id, fp, component); `fp_of` gives a text's `fp`."""
    one = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")
    best = found.groupBy("component").agg(F.min(one).alias("best")).select("best.doc_id", "best.fp")
    best = checkpoint(best)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).join(best.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    rows = docs.select(row_of(docs).alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").cast("string").alias("_text"))
    out = rows.join(ids.where("_n = 1").select(F.col("doc_id").alias("_doc_id")), "_doc_id", "left_semi").select("_row.*")
    several = ids.where("_n > 1").select(F.col("doc_id").alias("_doc_id"))
    if found.where("doc_id IS NULL").isEmpty() and several.isEmpty():
        return out
    unsure = rows.where("_doc_id IS NULL").unionByName(rows.join(several, "_doc_id", "left_semi").select(*rows.columns)).withColumn("_fp", fp_of("_text"))
    chosen = best.select(F.col("doc_id").alias("_best"), F.col("fp").alias("_fp"))
    kept = unsure.join(chosen, "_fp").where(F.col("_doc_id").eqNullSafe(F.col("_best")))
    kept = kept.groupBy("_doc_id", "_fp").agg(F.min_by("_row", F.struct(F.xxhash64("_text"), "_text")).alias("_row"))
    return out.unionByName(kept.select("_row.*"))


def fingerprint_column(width: int = 4):
    """The fingerprint's 64 bits as a signed long, as a column function."""

    @F.pandas_udf("long")
    def f(text: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in text), np.uint64, len(text)).view(np.int64))

    return f


#: Steps of the 64-bit mixing function SplitMix64 (fixed values).
_GAMMA, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORDS = 8
_STEPS = np.arange(1, _WORDS + 1, dtype=np.uint64) * _GAMMA


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of the text's word shingles, repeats included; of a text with fewer words, that of all of them; of none, none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    shingles = (joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)


def signature(hashes: np.ndarray) -> bytes:
    """512-bit SimHash: every hash is mixed into eight words, and a bit is 1 if set in over half of them."""
    counts = np.zeros(64 * _WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        z = hashes[at : at + (1 << 13), None] + _STEPS
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def text_key(text: str | None) -> str:
    """128-bit digest of the words in lower case, by which equal texts are one."""
    return xxhash.xxh3_128_hexdigest(b" ".join((text or "").encode().lower().split()))


def text_key_column(text):
    @F.pandas_udf("string")
    def f(t: pd.Series) -> pd.Series:
        return t.map(text_key)

    return f(text)


def _distances(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bits in which the signatures a[r] and b[c] differ, 2^15 pairs at a time, so that few signatures are copied at once."""
    out, step = np.empty(len(r), np.int64), 1 << 15
    for at in range(0, len(r), step):
        out[at : at + step] = np.bitwise_count(a[r[at : at + step]] ^ b[c[at : at + step]]).sum(axis=1, dtype=np.int64)
    return out


def signature_links(a: np.ndarray, b: np.ndarray, radius: int, first: int, same: bool) -> np.ndarray:
    """Pairs (place in a, place in b after those of a) between two tiles of signatures (n x 8 words): a spanning forest of all
    pairs within the radius, and for each signature its nearest within it. Of the first word `first` bits may differ."""
    forest, step = Forest(len(a) + len(b)), max(1, (1 << 19) // max(1, len(b)))
    nearest, spanning = np.full(len(a) + len(b), np.iinfo(np.int64).max), []
    for at in range(0, len(a), step):
        r, c = np.nonzero(np.bitwise_count(a[at : at + step, None, 0] ^ b[None, :, 0]) <= first)
        r += at
        if same:
            r, c = r[r < c], c[r < c]
        d = _distances(a, b, r, c)
        near = d <= radius
        if near.any():
            order = np.argsort(d[near], kind="stable")
            r, c, d = r[near][order], c[near][order] + (0 if same else len(a)), d[near][order] << 32
            joined = forest.join(r, c)
            spanning.append(np.stack([r[joined], c[joined]]))
            np.minimum.at(nearest, r, d | c)
            np.minimum.at(nearest, c, d | r)
    have = np.flatnonzero(nearest < np.iinfo(np.int64).max)
    pairs = np.concatenate([*spanning, np.stack([have, nearest[have] & 0xFFFFFFFF])], axis=1)
    return np.unique(np.sort(pairs, axis=0), axis=1)


def signature_pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, radius: int, first: int, same: bool) -> np.ndarray:
    """Pairs as `signature_links` numbers them: all within the radius whose groups `of_a` and `of_b` differ."""
    out, step = [np.zeros((2, 0), np.int64)], max(1, (1 << 19) // max(1, len(b)))
    for at in range(0, len(a), step):
        r, c = np.nonzero((np.bitwise_count(a[at : at + step, None, 0] ^ b[None, :, 0]) <= first) & (of_a[at : at + step, None] != of_b[None, :]))
        r += at
        if same:
            r, c = r[r < c], c[r < c]
        near = _distances(a, b, r, c) <= radius
        out.append(np.stack([r[near], c[near] + (0 if same else len(a))]))
    return np.concatenate(out, axis=1)


def common_shingles(rows: DataFrame, width: int, texts: int = 8192, most: int = 1 << 16) -> np.ndarray:
    """Hashes of the shingles that most texts hold, the rarest first, as counted in about `texts` distinct ones, which a
    hash of the text chooses. They only set the order in which `prefix` takes shingles, so that what many texts hold is
    taken last; what is found does not depend on them."""
    part = max(1, rows.count() // texts)
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select(F.lit(0).cast("long").alias("doc_id"), "text").distinct()
    held = some.mapInArrow(lambda b: _sets(b, width), "node long, shingles array<bigint>").select(F.explode("shingles").alias("s"))
    top = held.groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(most).collect()  # `most` rows
    return np.array([r["s"] for r in reversed(top)], np.int64).view(np.uint64)


def prefix(shingles: np.ndarray, common: np.ndarray, order: np.ndarray, least: float) -> np.ndarray:
    """The first of a set of shingles (distinct, in order) by one order for all sets: those not in `common` by their hash,
    then `common`, the rarest first; `order` sorts `common`. Two sets of similarity `least` or more share `least` of the larger one, so that
    of all but so many of each one is in both."""
    if not len(shingles):
        return shingles
    n = len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1
    if not len(common):
        return shingles[:n]
    place = np.minimum(np.searchsorted(common, shingles, sorter=order), len(common) - 1)
    known = common[order[place]] == shingles
    return np.concatenate((shingles[~known][:n], common[np.sort(order[place[known]])]))[:n]


def shared_keys(classes: DataFrame) -> DataFrame:
    """(key, node, held): the shingles in the prefixes of `classes` (node, prefix) that more than one of them, `held`, has."""
    rows = classes.select("node", F.explode("prefix").alias("key"))
    keys = rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    return rows.join(keys.hint("merge"), "key")


#: Cells of so many rows are compared together with other cells, larger ones by themselves.
_FEW = 64


def _few_links(ends: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, groups: np.ndarray, radius: int, first: int, least: float, apart: bool) -> np.ndarray:
    """As `signature_links`, with `apart` as `signature_pairs`, within many small cells; row i's cell ends before ends[i]."""
    at, found = np.arange(len(ends)), [np.zeros((3, 0), np.int64)]
    for step in range(1, _FEW):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        r = at[np.bitwise_count(sigs[at, 0] ^ sigs[at + step, 0]) <= first]
        r = r[_fit(sizes[r], sizes[r + step], least) & ((groups[r] != groups[r + step]) | (not apart))]
        d = _distances(sigs, sigs, r, r + step)
        found.append(np.stack([r, r + step, d])[:, d <= radius])
    r, c, d = np.concatenate(found, axis=1)
    if apart or not len(r):
        return np.stack([r, c])
    order = np.argsort(d, kind="stable")
    r, c, d = r[order], c[order], d[order] << 32
    joined, nearest = Forest(len(ends)).join(r, c), np.full(len(ends), np.iinfo(np.int64).max)
    np.minimum.at(nearest, r, d | c)
    np.minimum.at(nearest, c, d | r)
    have = np.flatnonzero(nearest < np.iinfo(np.int64).max)
    return np.concatenate([np.stack([r[joined], c[joined]]), np.stack([have, nearest[have] & 0xFFFFFFFF])], axis=1)


def _fit(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity `least`."""
    return np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9


def _links_of_cells(batches: Iterator[pa.RecordBatch], radius: int, first: int, least: float, apart: bool) -> Iterator[pa.RecordBatch]:
    """Candidate links (a, b) of rows (key, x, y, second, node, sig, size, component) in order of their cells (key, x, y).
    Rows of a cell are held until it ends; it has at most two tiles."""
    let_go()
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        cell = [batch.column(k).to_numpy() for k in range(3)]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1
        if kept and batch.num_rows and any(c[0] != kept[-1].column(k)[-1].as_py() for k, c in enumerate(cell)):
            starts = np.concatenate(([0], starts))
        if not batch.num_rows or not len(starts):
            kept += [batch] if batch.num_rows else []
            continue
        yield from _whole_cells(pa.Table.from_batches([*kept, batch.slice(0, starts[-1])]), radius, first, least, apart)
        kept = [batch.slice(starts[-1])]
    if kept:
        yield from _whole_cells(pa.Table.from_batches(kept), radius, first, least, apart)


def _whole_cells(rows: pa.Table, radius: int, first: int, least: float, apart: bool) -> Iterator[pa.RecordBatch]:
    key, x, y, second, nodes, sizes, groups = (rows.column(c).to_numpy() for c in ("key", "x", "y", "second", "node", "size", "component"))
    sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint64).reshape(-1, _WORDS)
    starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1))
    ends = np.append(starts[1:], len(key))
    few = (ends - starts <= _FEW) & (x[starts] == y[starts])

    def found(r: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        fit = _fit(sizes[r], sizes[c], least)
        a, b = nodes[r[fit]], nodes[c[fit]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    some = np.flatnonzero(np.repeat(few, ends - starts))
    lengths = (ends - starts)[few]
    yield found(*some[_few_links(np.repeat(np.cumsum(lengths), lengths), sigs[some], sizes[some], groups[some], radius, first, least, apart)])
    for s, e in zip(starts[~few].tolist(), ends[~few].tolist()):
        same = x[s] == y[s]
        a = np.arange(s, e) if same else s + np.flatnonzero(~second[s:e])
        b = a if same else s + np.flatnonzero(second[s:e])
        if len(a) and len(b):
            pairs = signature_pairs(sigs[a], sigs[b], groups[a], groups[b], radius, first, same) if apart else signature_links(sigs[a], sigs[b], radius, first, same)
            yield found(*(a if same else np.concatenate((a, b)))[pairs])


def candidate_links(shared: DataFrame, signed: DataFrame, radius: int, first: int, least: float, tile: int, apart: bool = False) -> DataFrame:
    """(a, b): distinct candidate pairs among `signed` (node, sig, size, component) that have a key of `shared` (key, node,
    held) in common. With `apart` they are all such pairs within the radius whose `component` differs, else for each key a
    forest of them and each signature's nearest.

    A key's rows are compared with one another; where they are more than `tile`, they are dealt into tiles, and each two
    tiles meet in a cell of their own.
    """
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = F.ceil(F.col("held") / tile)
    dealt = shared.select("key", "node", tiles.alias("tiles"), F.pmod(F.xxhash64("node"), tiles).alias("t")).join(signed.hint("merge"), "node")
    met = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("u"))
    cells = met.select("key", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), (F.col("t") > F.col("u")).alias("second"), "node", "sig", "size", "component")
    # A number of partitions of their own: rows are few bytes and much work, so that merged partitions would be slow.
    cells = cells.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return cells.mapInArrow(lambda b: _links_of_cells(b, radius, first, least, apart), "a long, b long").distinct()


def _signed(batches: Iterator[pa.RecordBatch], width: int, common: np.ndarray = _STEPS[:0], least: float = 0.8) -> Iterator[pa.RecordBatch]:
    let_go()
    order = np.argsort(common)
    for batch in batches:
        keys, sigs, sizes, prefixes = [], [], [], []
        for t in batch.column(1):
            text = t.as_py()
            hashes = shingle_hashes(text, width)
            shingles = np.unique(hashes)
            keys.append(text_key(text))
            sigs.append(signature(hashes))
            sizes.append(len(shingles))
            prefixes.append(prefix(shingles, common, order, least).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "fp", "sig", "size", "prefix"])


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        yield batch.append_column("fp", pa.array([text_key(t.as_py()) for t in batch.column(1)], pa.string()))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _verified(keyed: DataFrame, classes: DataFrame, links: DataFrame, least: float, width: int) -> DataFrame:
    """The `links` (a, b) between `classes` (node, fp, rep) whose texts in `keyed` (doc_id, text, fp) are as similar as `least`."""
    asked = classes.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge"), "node", "left_semi").select("node", F.col("fp").alias("_fp"), "rep")
    # A class's text is looked up by its digest and smallest id, so that a hot class's copies are spread.
    texts = keyed.join(asked.hint("merge"), (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text").dropDuplicates(["node"])
    sets = checkpoint(texts.mapInArrow(lambda b: _sets(b, width), "node long, shingles array<bigint>"))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")).hint("merge")
    both = links.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(common / (F.size("a_set") + F.size("b_set") - common) >= least).select("a", "b")


def similar(docs: DataFrame, least: float = 0.8, width: int = 5, radius: int = 100, first: int = 20, tile: int = 8192) -> DataFrame:
    """(doc_id, fp, component, component_id) for every document; components are joined by pairs whose sets of shingles
    have a Jaccard similarity of `least` or more, on whole texts.

    Two texts of similarity 0.8 differ in 78 of 512 bits at the mean, by 8; in 10 of the first word's 64, by 3. Only texts
    that can be so similar are compared: those that share a shingle of their prefixes, which every such pair does. First
    candidates are a forest and each signature's nearest of those with a shingle, so that a group of copies costs its size;
    then all pairs within the radius whose components differ are candidates, so that no such pair is left out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    common = common_shingles(rows, width)
    signed = checkpoint(rows.mapInArrow(lambda b: _signed(b, width, common, least), "doc_id long, fp string, sig binary, size long, prefix array<bigint>"))
    classes = signed.groupBy("fp").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("sig", "size", "prefix")))
    classes = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    rows = rows.mapInArrow(_with_key, "doc_id long, text string, fp string")
    shared = checkpoint(shared_keys(classes))
    # A forest and the nearest join large groups at their size; then every pair whose components still differ is looked at.
    links = checkpoint(candidate_links(shared, classes.select("node", "sig", "size", F.col("node").alias("component")), radius, first, least, tile))
    verified = checkpoint(_verified(rows, classes, links, least, width))
    named = checkpoint(named_components(classes.select("node", "rep"), verified))
    grouped = classes.select("node", "sig", "size").join(named.select("node", "component").hint("merge"), "node")
    rest = checkpoint(candidate_links(shared, grouped, radius, first, least, tile, apart=True).join(links.hint("merge"), ["a", "b"], "left_anti"))
    more = checkpoint(_verified(rows, classes, rest, least, width))
    if not more.isEmpty():
        named = named_components(classes.select("node", "rep"), verified.unionByName(more))
    by_fp = checkpoint(classes.select("node", "fp").join(named.hint("merge"), "node").select("fp", "component", "component_id"))
    return signed.select("doc_id", "fp").join(by_fp.hint("merge"), "fp")


def keep_similar(docs: DataFrame, least: float = 0.8, width: int = 5, radius: int = 100, first: int = 20, tile: int = 8192) -> DataFrame:
    """As `keep_one`, of the groups that `similar` finds."""
    return _one_of_each(docs, checkpoint(similar(docs, least, width, radius, first, tile)), text_key_column)
