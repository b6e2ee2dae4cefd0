"""A packed R-tree in numpy: bulk-loaded from Z-ordered points, probed block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 16


def spread_bits(v: np.ndarray, dims: int) -> np.ndarray:
    """Bits of ``v`` moved apart so that ``dims`` values can be interleaved."""
    v = v.astype(np.uint64)
    out = np.zeros_like(v)
    for b in range(20 if dims == 3 else 31):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(b * dims)
    return out


def z_order(points: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Order of 3-d points along a Z curve, within ``key`` if given."""
    if not len(points):
        return np.zeros(0, np.int64)
    lo = points.min(axis=0)
    span = max(float((points.max(axis=0) - lo).max()), 1e-12)
    cells = ((points - lo) / span * 1023).astype(np.uint64)
    code = np.zeros(len(points), np.uint64)
    for d in range(3):
        v, part = cells[:, d], np.zeros(len(points), np.uint64)
        for b in range(10):
            part |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(3 * b + d)
        code |= part
    return np.argsort(code, kind="stable") if key is None else np.lexsort((code, key))


class PackedTree:
    """Points in packed order, in leaves of FANOUT, under levels of bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        lo = hi = points
        while len(lo) > 1 or not self.levels:
            at = np.arange(0, len(lo), FANOUT)
            if not len(at):
                break
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((lo, hi))

    def probe(self, qlo: np.ndarray, qhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query box and a leaf that its box meets."""
        if not self.levels or not len(qlo):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = np.arange(len(qlo))
        node = np.zeros(len(qlo), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            lo, hi = self.levels[level]
            meets = np.ones(len(q), bool)
            for d in range(lo.shape[1]):
                meets &= (lo[node, d] <= qhi[q, d]) & (hi[node, d] >= qlo[q, d])
            q, node = q[meets], node[meets]
            if level:
                below = len(self.levels[level - 1][0])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                real = node < below
                q, node = q[real], node[real]
        return q, node

    def _blocks(self) -> np.ndarray:
        """Points as (leaf, slot, dimension); the empty slots of the last leaf are NaN."""
        n, d = self.points.shape
        leaves = -(-n // FANOUT)
        out = np.full((leaves * FANOUT, d), np.nan)
        out[:n] = self.points
        return out.reshape(leaves, FANOUT, d)

    def pairs_within(self, radius: float, key: np.ndarray | None = None, chunk: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs i < j of points within ``radius`` (and of one key), with squared distances.

        Leaves probe the tree with their own boxes grown by the radius; what comes back is
        refined point by point. Yields blocks of bounded size.
        """
        if len(self.points) < 2:
            return
        blocks, (lo, hi) = self._blocks(), self.levels[0]
        keys = None
        if key is not None:
            keys = np.full(blocks.shape[0] * FANOUT, -1, np.int64)
            keys[: len(key)] = key
            keys = keys.reshape(-1, FANOUT)
            first, last = keys[:, 0], np.maximum.reduce(keys, axis=1)
        upper = np.triu(np.ones((FANOUT, FANOUT), bool), 1)
        r2 = radius * radius
        for at in range(0, len(lo), chunk):
            a, b = self.probe(lo[at : at + chunk] - radius, hi[at : at + chunk] + radius)
            a = a + at
            keep = b >= a
            if keys is not None:
                keep &= (first[b] <= last[a]) & (last[b] >= first[a])
            a, b = a[keep], b[keep]
            for k in range(0, len(a), chunk):
                p, q = a[k : k + chunk], b[k : k + chunk]
                d2 = np.zeros((len(p), FANOUT, FANOUT))
                for d in range(blocks.shape[2]):
                    delta = blocks[p, :, d][:, :, None] - blocks[q, :, d][:, None, :]
                    d2 += delta * delta
                near = d2 <= r2
                near &= (p != q)[:, None, None] | upper
                if keys is not None:
                    near &= keys[p][:, :, None] == keys[q][:, None, :]
                m, i, j = np.nonzero(near)
                if len(m):
                    yield p[m] * FANOUT + i, q[m] * FANOUT + j, d2[m, i, j]

    def inside(self, qlo: np.ndarray, qhi: np.ndarray, chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query box and a point inside it, bounds included, in blocks."""
        if not len(self.points):
            return
        blocks = self._blocks()
        q, leaf = self.probe(qlo, qhi)
        for k in range(0, len(q), chunk):
            a, b = q[k : k + chunk], leaf[k : k + chunk]
            within = np.ones((len(a), FANOUT), bool)
            for d in range(blocks.shape[2]):
                v = blocks[b, :, d]
                within &= (v >= qlo[a, d][:, None]) & (v <= qhi[a, d][:, None])
            m, i = np.nonzero(within)
            if len(m):
                yield a[m], b[m] * FANOUT + i
