"""Sample-driven quadtree partitions of a plane, with replication across leaf boundaries."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points the driver samples to shape the tree: so many at least, and so many for each leaf wanted.
SAMPLE_ROWS, PER_LEAF = 60_000, 32
#: Most leaves; the tree that is sent to every task stays under a megabyte.
MAX_LEAVES = 65_536


@dataclass(frozen=True)
class Quadtree:
    """Leaves as ascending start codes of a Z curve over a grid of 2**depth cells a side.

    Places beyond the grid belong to its outermost cells, so every point has exactly one leaf.
    """

    x0: float
    y0: float
    cell: float
    depth: int
    starts: np.ndarray

    def leaf_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        top = (1 << self.depth) - 1
        gx = np.clip(np.floor((x - self.x0) / self.cell), 0, top).astype(np.uint64)
        gy = np.clip(np.floor((y - self.y0) / self.cell), 0, top).astype(np.uint64)
        return np.searchsorted(self.starts, _interleave(gx) | (_interleave(gy) << np.uint64(1)), side="right") - 1

    def leaves_near(self, x: np.ndarray, y: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf within ``margin`` of a point. No leaf is narrower than
        twice the margin, so that the four corners around a point meet all of them."""
        corner = [self.leaf_of(x + dx, y + dy) for dx in (-margin, margin) for dy in (-margin, margin)]
        rows, leaves = [np.arange(len(x))], [corner[0]]
        for k in range(1, 4):
            new = np.ones(len(x), bool)
            for other in corner[:k]:
                new &= corner[k] != other
            rows.append(np.nonzero(new)[0])
            leaves.append(corner[k][new])
        return np.concatenate(rows), np.concatenate(leaves)

    def leaves_of_boxes(self, x_lo: np.ndarray, x_hi: np.ndarray, y_lo: np.ndarray, y_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) for every leaf that a box meets."""
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        x0, x1, y0, y1 = self.bounds()
        step = max(1, 4_000_000 // len(x0))
        for k in range(0, len(x_lo), step):
            some = slice(k, k + step)
            hit = (x0 <= x_hi[some, None]) & (x1 >= x_lo[some, None]) & (y0 <= y_hi[some, None]) & (y1 >= y_lo[some, None])
            box, leaf = np.nonzero(hit)
            rows.append(box + k)
            leaves.append(leaf)
        return np.concatenate(rows), np.concatenate(leaves)

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sides of the leaves; those at the rim reach to infinity."""
        ends = np.append(self.starts[1:], np.uint64(1) << np.uint64(2 * self.depth))
        side = np.sqrt((ends - self.starts).astype(np.float64)).round().astype(np.int64)
        gx, gy = _gather(self.starts).astype(np.int64), _gather(self.starts >> np.uint64(1)).astype(np.int64)
        top = 1 << self.depth
        x0 = np.where(gx == 0, -np.inf, self.x0 + gx * self.cell)
        y0 = np.where(gy == 0, -np.inf, self.y0 + gy * self.cell)
        x1 = np.where(gx + side >= top, np.inf, self.x0 + (gx + side) * self.cell)
        y1 = np.where(gy + side >= top, np.inf, self.y0 + (gy + side) * self.cell)
        return x0, x1, y0, y1


def _interleave(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _gather(v: np.ndarray) -> np.ndarray:
    v = v & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> np.uint64(shift))) & np.uint64(mask)
    return v


def grow(sample: np.ndarray, low: tuple[float, float], high: tuple[float, float], capacity: float, margin: float) -> Quadtree:
    """Split squares while more than ``capacity`` sampled points lie in one and it stays wide enough."""
    side = max(high[0] - low[0], high[1] - low[1], 4 * margin, 1e-9) * (1 + 1e-9)
    depth = int(min(15, max(0, math.floor(math.log2(side / max(4 * margin, side / 32768))))))
    cell = side / (1 << depth)
    gx = np.clip((sample[:, 0] - low[0]) / cell, 0, (1 << depth) - 1).astype(np.uint64)
    gy = np.clip((sample[:, 1] - low[1]) / cell, 0, (1 << depth) - 1).astype(np.uint64)
    codes = np.sort(_interleave(gx) | (_interleave(gy) << np.uint64(1)))
    starts: list[int] = []
    todo = [(0, depth)]
    while todo:
        start, level = todo.pop()
        size = 1 << (2 * level)
        n = np.searchsorted(codes, np.uint64(start + size - 1), "right") - np.searchsorted(codes, np.uint64(start), "left")
        if n > capacity and level and len(starts) + len(todo) < MAX_LEAVES:
            todo += [(start + k * (size >> 2), level - 1) for k in range(4)]
        else:
            starts.append(start)
    return Quadtree(low[0], low[1], cell, depth, np.array(sorted(starts), np.uint64))


def plan_quadtree(points: DataFrame, margin: float, leaf_points: int, x: str = "x", y: str = "y", sample_rows: int = SAMPLE_ROWS) -> Quadtree:
    """Shape a tree on a sample of the points.

    The sample only shapes the partitions; every row is assigned. It grows with the leaves wanted, of
    which there are ``MAX_LEAVES`` at most, so that it has two million points or so at most. An empty table gives one leaf.
    """
    n, x0, x1, y0, y1 = points.agg(F.count(F.lit(1)), F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if not n:
        return Quadtree(0.0, 0.0, 1.0, 0, np.zeros(1, np.uint64))
    share = min(1.0, max(sample_rows, PER_LEAF * min(n / leaf_points, MAX_LEAVES)) / n)
    sampled = (points.select(x, y).sample(share, 7) if share < 1 else points.select(x, y)).toArrow()
    xy = np.column_stack([sampled.column(c).to_numpy() for c in (x, y)]).astype(float)
    return grow(xy, (x0, y0), (x1, y1), max(1.0, max(leaf_points, 4 * n / MAX_LEAVES) * share), margin)
