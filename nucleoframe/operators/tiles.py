"""Parts of cells in which every spot finds its k nearest: whole cells in buckets, large ones in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nucleoframe.functions.neighbours import BOX_POINTS, meeting, reach

#: Rows of a bucket of whole cells, most rows of a cell that isn't split, rows that a tile has of its own.
BUCKET_ROWS, CELL_ROWS, TILE_ROWS = 20_000, 50_000, 100_000
#: Boxes wanted of all split cells, and points the driver samples for each to shape them.
MAX_BOXES, PER_BOX = 32_768, 32
#: Boxes that look at more points than this and than so many times the median are split again, up to so many points a box wanted.
COSTLY_ROWS, COSTLY_TIMES, COSTLY_POINTS = 10_000, 3, 20
_COUNTED = "box int, n bigint, x_lo double, x_hi double, y_lo double, y_hi double, z_lo double, z_hi double"


@dataclass(frozen=True)
class Boxes:
    """Parts of space, per cell, as leaves of binary trees: ``axis`` is -1 at a leaf, whose box is ``left``; ``cell`` numbers the cell of a box."""

    roots: dict[str, int]
    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray

    def box_of(self, cells: pa.Array, points: np.ndarray) -> np.ndarray:
        coded = cells.dictionary_encode()
        node = np.array([self.roots[c] for c in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return self.left[node]
            at = node[inner]
            node[inner] = np.where(points[inner, self.axis[at]] < self.cut[at], self.left[at], self.right[at])

    def leaves(self) -> np.ndarray:
        """The node of each box."""
        leaves = np.flatnonzero(self.axis < 0)
        out = np.empty(len(leaves), np.int64)
        out[self.left[leaves]] = leaves
        return out


_LEAF = (-1, 0.0, 0, 0)


def _grow(nodes: list[tuple], at: int, points: np.ndarray, size: int) -> None:
    """Cut a leaf in the middle of the widest side of its points, and its parts, until none has more than ``size``; far points get parts of their own."""
    todo = [(at, points)]
    while todo:
        at, part = todo.pop()
        if len(part) <= size:
            continue
        lo, hi = part.min(axis=0), part.max(axis=0)
        d = int(np.argmax(hi - lo))
        middle = float((lo[d] + hi[d]) / 2)
        low = part[:, d] < middle
        if low.any():
            nodes[at] = (d, middle, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), part[low]), (len(nodes) + 1, part[~low])]
            nodes += [_LEAF, _LEAF]


def _numbered(roots: dict[str, int], nodes: list[tuple]) -> Boxes:
    """The boxes are numbered through the trees, so that those of a subtree follow one another."""
    cells = []
    for number, root in enumerate(roots.values()):
        todo = [root]
        while todo:
            at = todo.pop()
            if nodes[at][0] >= 0:
                todo += [nodes[at][3], nodes[at][2]]
            else:
                nodes[at] = (-1, 0.0, len(cells), 0)
                cells.append(number)
    axis, cut, left, right = zip(*nodes)
    return Boxes(roots, np.array(axis), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(cells))


def shape(samples: dict[str, np.ndarray], size: int) -> Boxes:
    roots, nodes = {c: i for i, c in enumerate(samples)}, [_LEAF] * len(samples)
    for c, sample in samples.items():
        _grow(nodes, roots[c], sample, size)
    return _numbered(roots, nodes)


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"])


def _sums(box: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, ...]:
    """Boxes with points, their numbers of points, and the least and largest coordinates of these."""
    order = np.argsort(box, kind="stable")
    some, begins, n = np.unique(box[order], return_index=True, return_counts=True)
    return some, n, np.minimum.reduceat(points[order], begins), np.maximum.reduceat(points[order], begins)


def _count(boxes: Boxes):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _points(batch)
            some, n, lo, hi = _sums(boxes.box_of(batch.column("cell_id"), points), points)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n), *[pa.array(np.ascontiguousarray(v[:, d])) for d in range(3) for v in (lo, hi)]], names=["box", "n", *[f"{c}_{s}" for c in "xyz" for s in ("lo", "hi")]])

    return count


def _within(boxes: Boxes, wanted: np.ndarray):
    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted[boxes.box_of(batch.column("cell_id"), _points(batch))]))

    return within


def _radii(cell: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    radius2 = np.zeros(len(n))
    for c in np.unique(cell):
        at = np.flatnonzero((cell == c) & (n > 0))
        radius2[at] = reach(lo[at], hi[at], n[at], k + 1)
    return radius2


def _costly(cell: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius2: np.ndarray) -> np.ndarray:
    """Boxes that look at far more points than others, such as those of stray points around a heap; the worst first."""
    cost = np.zeros(len(n), np.int64)
    for c in np.unique(cell):
        at = np.flatnonzero((cell == c) & (n > 0))
        for i, j in meeting(lo[at], hi[at], radius2[at]):
            cost[at] += np.bincount(i, n[at[j]], len(at)).astype(np.int64)
    some = np.flatnonzero((n > 1) & (hi > lo).any(axis=1) & (cost > max(COSTLY_ROWS, COSTLY_TIMES * np.median(cost[n > 0]))))
    some = some[np.argsort(-cost[some], kind="stable")]
    return some[np.cumsum(n[some]) <= COSTLY_POINTS * MAX_BOXES]


def _refined(boxes: Boxes, counted: tuple[np.ndarray, ...], some: np.ndarray, found: pa.Table) -> tuple:
    """Boxes and their sums after splitting ``some``, whose points are all ``found``."""
    nodes, leaves = list(zip(boxes.axis.tolist(), boxes.cut.tolist(), boxes.left.tolist(), boxes.right.tolist())), boxes.leaves()
    cells, points = found.column("cell_id").combine_chunks(), _points(found)
    box = boxes.box_of(cells, points)
    order = np.argsort(box, kind="stable")
    size = max(1, -(-len(points) // MAX_BOXES))
    for part in np.split(order, np.flatnonzero(np.diff(box[order])) + 1):
        _grow(nodes, leaves[box[part[0]]], points[part], size)
    out = _numbered(boxes.roots, nodes)
    kept = np.delete(np.arange(len(leaves)), some)
    sums = [np.zeros((len(out.cell), *v.shape[1:]), v.dtype) for v in counted]
    at, *new = _sums(out.box_of(cells, points), points)
    for v, old, found_ in zip(sums, counted, new):
        v[out.left[leaves[kept]]], v[at] = old[kept], found_
    return out, sums


def _place(boxes: Boxes, tile: np.ndarray, begins: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius2: np.ndarray, first: int):
    """Send each spot to the tile of its box, and to the tiles for which its box is wanted, from ``begins`` on."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch)
            box = boxes.box_of(batch.column("cell_id"), points)
            n = begins[box + 1] - begins[box]
            rows = np.repeat(np.arange(len(box)), n)
            to = wanted[np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[box], n)]
            gap2 = np.zeros(len(rows))
            for d in range(3):
                gap = np.maximum(np.maximum(points[rows, d] - hi[to, d], lo[to, d] - points[rows, d]), 0)
                gap2 += gap * gap
            near = gap2 <= radius2[to]
            rows, to = np.append(np.arange(len(box)), rows[near]), np.append(tile[box], to[near])
            out = batch.drop_columns(["unit", "home"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array((to + first).astype(np.int32)), pa.array(np.arange(len(rows)) < len(box)), *out.columns], names=["unit", "home", *out.schema.names])

    return place


def _tiles(cell: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tiles of boxes that follow one another in a cell, and which other boxes hold the k nearest of a tile's points."""
    tile, pairs, count = np.zeros(len(n), np.int64), [], 0
    for c in np.unique(cell):
        at = np.flatnonzero((cell == c) & (n > 0))
        rows = 0
        for box in at:
            if rows and rows + n[box] > TILE_ROWS:
                count, rows = count + 1, 0
            tile[box] = count
            rows += n[box]
        count += 1
        for i, j in meeting(lo[at], hi[at], radius2[at]):
            pairs.append(np.unique(at[j] * len(n) + tile[at[i]]))
    wanted = np.unique(np.concatenate(pairs))
    box, to = wanted // len(n), wanted % len(n)
    box, to = box[tile[box] != to], to[tile[box] != to]
    full = n > 0
    order = np.argsort(tile[full], kind="stable")
    starts = np.searchsorted(tile[full][order], np.arange(count))
    around = [f.reduceat(v[full][order], starts) for f, v in ((np.minimum, lo), (np.maximum, hi), (np.maximum, radius2))]
    return tile, np.searchsorted(box, np.arange(len(n) + 1)), to, *around


def parted(spots: DataFrame, k: int) -> DataFrame:
    """The spots with ``unit`` and ``home``: the k nearest other spots of a cell of each home spot are in its unit.

    Each spot is at home in one unit. Spots need cell_id, x, y and z; those without a cell are at home
    somewhere. Cells of few rows stay whole, several to a unit. A sample shapes boxes in large
    cells, whose spots are counted; the counts bound how far the k nearest can be, and a unit
    gets the spots that are as near to its boxes.
    """
    sizes = spots.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    large = F.when(F.col("n") > CELL_ROWS, F.col("cell_id"))
    n = {r["cell_id"]: r["n"] for r in sizes.groupBy(large.alias("cell_id")).agg(F.sum("n").alias("n")).collect()}
    buckets = max(1, -(-n.pop(None, 0) // BUCKET_ROWS))
    whole = spots.select(F.coalesce(F.pmod(F.hash("cell_id"), F.lit(buckets)), F.lit(0)).alias("unit"), F.lit(True).alias("home"), "*")
    if not n:
        return whole
    split = F.coalesce(F.col("cell_id").isin(list(n)), F.lit(False))
    rows = sum(n.values())
    size = max(BOX_POINTS, -(-rows // MAX_BOXES))
    sampled = spots.where(split).select("cell_id", "x", "y", "z").sample(min(1.0, PER_BOX / size), 7).toArrow()
    points, cells = _points(sampled), np.array(sampled.column("cell_id").to_pylist(), object)
    boxes = shape({c: points[cells == c] for c in n}, PER_BOX)
    sides = [f"{c}_{s}" for c in "xyz" for s in ("lo", "hi")]
    counted = spots.where(split).select("cell_id", "x", "y", "z").mapInArrow(_count(boxes), _COUNTED)
    counted = counted.groupBy("box").agg(F.sum("n").alias("n"), *[(F.min if s.endswith("lo") else F.max)(s).alias(s) for s in sides]).toArrow()
    counts, lo, hi = np.zeros(len(boxes.cell), np.int64), np.zeros((len(boxes.cell), 3)), np.zeros((len(boxes.cell), 3))
    at = counted.column("box").to_numpy()
    counts[at] = counted.column("n").to_numpy()
    for d, c in enumerate("xyz"):
        lo[at, d], hi[at, d] = counted.column(f"{c}_lo").to_numpy(), counted.column(f"{c}_hi").to_numpy()
    radius2 = _radii(boxes.cell, counts, lo, hi, k)
    some = _costly(boxes.cell, counts, lo, hi, radius2)
    if len(some):
        wanted = np.zeros(len(counts), bool)
        wanted[some] = True
        found = spots.where(split).select("cell_id", "x", "y", "z").mapInArrow(_within(boxes, wanted), "cell_id string, x double, y double, z double").toArrow()
        boxes, (counts, lo, hi) = _refined(boxes, (counts, lo, hi), some, found)
        radius2 = _radii(boxes.cell, counts, lo, hi, k)
    placed = whole.where(split).mapInArrow(_place(boxes, *_tiles(boxes.cell, counts, lo, hi, radius2), buckets), T.StructType(whole.schema.fields))
    return whole.where(~split).unionByName(placed)
