"""Embedding near-duplicates by collision-counting projections.

Equal vectors are collapsed to one class first. Unit vectors are projected on many random directions. On a direction, whose
projections are sorted, two vectors collide if one's projection lies in a window around the other's; the pairs with enough
collisions, and only they, are verified by their cosine in double precision. The count that a pair must reach is calibrated: pairs at the least cosine reach it with
probability `count_recall`.

To meet, a pair must first share a cell: each of several tables cuts a few projections into sorted ranges. The number of
ranges and tables follows from the number of classes, so that cells keep about the same size as the input grows and a
pair at the least cosine shares a cell of some table with probability `table_recall` (closer pairs more often). Cells
larger than a tile are split, and every two tiles of a cell meet in a task of bounded size. A task returns counts of
links and a spanning forest of them, so that a group of copies costs its size and not its square.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; shorter
vectors count as if they ended in zeros; repeated rows are vectors of their own; rows without an id take part, and a
component of such rows only has a null component_id and keeps none; an empty table gives no rows; other columns (also
labels) are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import checkpoint
from lodestone.llm._forest import Forest
from lodestone.llm.components import named_components
from lodestone.llm.topk import usable

#: Rows of a cell and of a bundle of cells, on average.
_CELL_ROWS, _BUNDLE_ROWS = 512, 16_384


def _within(x: float) -> float:
    """P(|Z| <= x) of a standard normal Z."""
    return math.erf(x / math.sqrt(2))


@dataclass(frozen=True)
class Design:
    """Directions, windows and tables, calibrated for pairs at the least cosine."""

    least: float
    directions: int
    window: float
    count: int
    width: float
    used: int
    tables: int
    seed: int

    @classmethod
    def of(cls, classes: int, least: float, directions: int = 32, table_recall: float = 0.998, count_recall: float = 0.9999, seed: int = 5) -> Design:
        apart = math.sqrt(max(1e-9, 2 - 2 * least))
        window, width = 1.42 * apart, 3.8 * apart
        hit = _within(1.42)
        tail, count = 0.0, directions + 1
        while count and tail < count_recall:
            count -= 1
            tail += math.comb(directions, count) * hit**count * (1 - hit) ** (directions - count)
        by_chance = min(0.95, width / (2 * math.sqrt(math.pi)))
        used = min(directions, max(1, math.ceil(math.log(max(1.0, classes / _CELL_ROWS)) / -math.log(by_chance))))
        same = 1 - math.sqrt(2 / math.pi) * apart / width
        tables = max(1, math.ceil(math.log(1 - table_recall) / math.log(1 - same**used)))
        return cls(least, directions, window, count, width, used, tables, seed)

    def project(self, unit: np.ndarray) -> np.ndarray:
        """Projections on the directions; a component's share does not depend on how many there are."""
        made = np.random.default_rng(self.seed).standard_normal((max(1, unit.shape[1]), self.directions))
        return unit @ made[: unit.shape[1]]

    def cells(self, projected: np.ndarray) -> np.ndarray:
        """Each row's cell in each table, as a 64-bit number."""
        rng = np.random.default_rng(self.seed + 1)
        out = np.empty((len(projected), self.tables), np.uint64)
        for t in range(self.tables):
            which, shift = rng.choice(self.directions, self.used, replace=False), rng.random(self.used)
            key = np.full(len(projected), (t + 1) * 0xBF58476D1CE4E5B9 % 2**64, np.uint64)
            for part in np.floor(projected[:, which] / self.width + shift).astype(np.int64).T:
                key = (key ^ part.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, t] = key
        return out.view(np.int64)


def units(vectors: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of length one in double precision."""
    width = max(1, width or max(map(len, vectors), default=1))
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def collisions(p: np.ndarray, q: np.ndarray, window: float) -> np.ndarray:
    """(rows of p, rows of q): on how many directions q's projection lies in the window around p's.

    Each direction's projections of q are sorted once; a row of p takes the run of them that its window covers. Runs are
    marked at both ends, so that their sums over the sorted places are the collisions of a direction.
    """
    hits = np.zeros((len(p), len(q)), np.uint8)
    row = np.arange(len(p))
    for k in range(p.shape[1]):
        order = np.argsort(q[:, k], kind="stable")
        known = q[order, k]
        edges = np.zeros((len(p), len(q) + 1), np.int8)
        np.add.at(edges, (row, np.searchsorted(known, p[:, k] - window, "left")), 1)
        np.add.at(edges, (row, np.searchsorted(known, p[:, k] + window, "right")), -1)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        hits += np.cumsum(edges[:, :-1], axis=1, dtype=np.int8)[:, back].view(np.uint8)
    return hits


def tile_links(design: Design, table: int, a: Tile, b: Tile, own: bool) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Links between two tiles of a cell, or within one (own): counts of linked rows for each, and the forest.

    Only pairs with enough collisions are verified. A pair that shares cells of several tables counts in the first only.
    """
    links_a, links_b = np.zeros(len(a.n), np.int64), np.zeros(len(b.n), np.int64)
    forest = Forest(len(a.n) + (0 if own else len(b.n)))
    step = max(1, (1 << 18) // max(1, len(b.n)))
    for at in range(0, len(a.n), step):
        i, j = np.nonzero(collisions(a.projected[at : at + step], b.projected, design.window) >= design.count)
        i += at
        if own:
            i, j = i[j > i], j[j > i]
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            good = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= design.least
            good &= (a.cells[x, :table] != b.cells[y, :table]).all(axis=1)
            x, y = x[good], y[good]
            links_a += np.bincount(x, weights=b.n[y], minlength=len(a.n)).astype(np.int64)
            links_b += np.bincount(y, weights=a.n[x], minlength=len(b.n)).astype(np.int64)
            if len(x):
                forest.add(x, y if own else y + len(a.n))
    return links_a, links_b, forest


@dataclass(frozen=True)
class Tile:
    """Rows that meet others: unit vectors, projections, cells in every table, and the sizes of their classes."""

    unit: np.ndarray
    projected: np.ndarray
    cells: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, design: Design, unit: np.ndarray, n: np.ndarray) -> Tile:
        projected = design.project(unit)
        return cls(unit, projected, design.cells(projected), n)

    def take(self, rows: np.ndarray) -> Tile:
        return Tile(self.unit[rows], self.projected[rows], self.cells[rows], self.n[rows])


def _bundle(design: Design, pdf: pd.DataFrame) -> pd.DataFrame:
    """Link counts (node, links) and forest links (node, other) of the pairs of tiles dealt to one bundle."""
    everything = Tile.of(design, units(pdf.v), pdf.n.to_numpy())
    node, second = pdf.node.to_numpy(), pdf.second.to_numpy()
    keys = [pdf[c].to_numpy() for c in ("t", "cell", "i", "j")]
    order = np.lexsort(keys)
    new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows in np.split(order, np.flatnonzero(new) + 1):
        own = keys[2][rows[0]] == keys[3][rows[0]]
        a, b = (rows, rows) if own else (rows[~second[rows]], rows[second[rows]])
        if len(a) and len(b) and len(rows) > 1:
            la, lb, forest = tile_links(design, int(keys[0][rows[0]]), everything.take(a), everything.take(b), bool(own))
            links, both = (la + lb, node[a]) if own else (np.concatenate((la, lb)), node[np.concatenate((a, b))])
            x, y = forest.links()
            some = np.flatnonzero(links)
            out += [(both[some], links[some], both[some]), (both[x], np.zeros(len(x), np.int64), both[y])]
    columns = [np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(3)]
    return pd.DataFrame(dict(zip(("node", "links", "other"), columns)))


def near_duplicates(vectors: DataFrame, least: float = 0.95, tile: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    some = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(some, F.xxhash64("v")))
    classes = checkpoint(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v")))
    design = Design.of(classes.count(), least)

    @F.pandas_udf("array<bigint>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(design.cells(design.project(units(v)))))

    dealt = classes.select("node", F.posexplode(cells("v")).alias("t", "cell"))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").withColumn("k", F.ceil(F.col("size") / tile).cast("int"))
    dealt = dealt.join(sizes.select("cell", "k"), "cell").withColumn("s", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    dealt = dealt.select("node", "t", "cell", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") > F.col("o")).alias("second"))
    dealt = checkpoint(dealt)
    bundles = max(1, -(-dealt.count() // _BUNDLE_ROWS))
    met = dealt.join(classes.select("node", "n", "v"), "node").withColumn("bundle", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(bundles)))
    found = met.groupBy("bundle").applyInPandas(lambda pdf: _bundle(design, pdf), "node long, links long, other long")
    found = checkpoint(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = named_components(classes.select("node", "rep"), found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    by_node = classes.select("node", "n").join(ids, "node").join(counts, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("node IS NOT NULL").select("vec_id", "node").join(by_node, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
