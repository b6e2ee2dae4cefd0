"""What the k nearest others of points are made of, in numpy: boxes bound the search, distances are exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a box, elements of a block of distances, boxes that are looked at together, and points whose neighbours are.
BOX_POINTS, BLOCK, GROUP, FEW = 128, 400_000, 16, 16


def gaps(lo: np.ndarray, hi: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray) -> np.ndarray:
    """Squared distance from each box to each other box; 0 where they meet.

    Differences, squares and sums are taken in the order in which points are compared, so that
    rounding never puts it above the distance of two points in the boxes.
    """
    out = np.zeros((len(lo), len(to_lo)))
    for d in range(lo.shape[1]):
        gap = np.maximum(np.maximum(to_lo[:, d] - hi[:, d, None], lo[:, d, None] - to_hi[:, d]), 0)
        out += gap * gap
    return out


def _spans(lo: np.ndarray, hi: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray) -> np.ndarray:
    """Squared distance that no two points in a box and another box exceed."""
    out = np.zeros((len(lo), len(to_lo)))
    for d in range(lo.shape[1]):
        span = np.maximum(to_hi[:, d] - lo[:, d, None], hi[:, d, None] - to_lo[:, d])
        out += span * span
    return out


def _reach(lo: np.ndarray, hi: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray, n: np.ndarray, need: int) -> np.ndarray:
    out = np.empty(len(lo))
    step = max(1, 2_000_000 // len(n))
    for k in range(0, len(lo), step):
        spans = _spans(lo[k : k + step], hi[k : k + step], to_lo, to_hi)
        todo, width = np.arange(len(spans)), 64
        while len(todo):
            width = min(4 * width, len(n))
            some = spans[todo]
            near = np.argpartition(some, width - 1, axis=1)[:, :width]
            some = np.take_along_axis(some, near, axis=1)
            order = np.argsort(some, axis=1)
            enough = np.cumsum(n[np.take_along_axis(near, order, axis=1)], axis=1) >= need
            found = enough[:, -1]
            at = enough[found].argmax(axis=1)
            out[k + todo[found]] = np.take_along_axis(some, order, axis=1)[found, at]
            todo = todo[~found]
    return out


def _groups(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.arange(0, len(lo), GROUP)
    return starts, np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)


def reach(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, need: int) -> np.ndarray:
    """Per box the squared radius within which each of its points has ``need`` points, itself included; infinite if there are fewer.

    A radius that does for a group of boxes bounds which others matter to each of them.
    """
    if n.sum() < need:
        return np.full(len(n), np.inf)
    if len(n) <= 2 * GROUP:
        return _reach(lo, hi, lo, hi, n, need)
    starts, g_lo, g_hi = _groups(lo, hi)
    bound = _reach(g_lo, g_hi, g_lo, g_hi, np.add.reduceat(n, starts), need)
    out = np.empty(len(n))
    for g, a in enumerate(starts):
        some = np.flatnonzero(gaps(g_lo[g : g + 1], g_hi[g : g + 1], lo, hi)[0] <= bound[g])
        out[a : a + GROUP] = _reach(lo[a : a + GROUP], hi[a : a + GROUP], lo[some], hi[some], n[some], need)
    return out


def meeting(lo: np.ndarray, hi: np.ndarray, radius2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a box and a box within its radius, for a group of boxes at a time."""
    starts, g_lo, g_hi = _groups(lo, hi)
    most = np.maximum.reduceat(radius2, starts)
    for g, a in enumerate(starts):
        some = np.flatnonzero(gaps(g_lo[g : g + 1], g_hi[g : g + 1], lo, hi)[0] <= most[g])
        i, j = np.nonzero(gaps(lo[a : a + GROUP], hi[a : a + GROUP], lo[some], hi[some]) <= radius2[a : a + GROUP, None])
        yield a + i, some[j]


def boxed(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): points halved along their widest side until no part is larger than ``size``."""
    order = np.arange(len(points))
    starts, todo = [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            starts.append(a)
            continue
        part = points[order[a:b]]
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, np.argmax(np.ptp(part, axis=0))], middle)]
        todo += [(a + middle, b), (a, a + middle)]
    return order, np.array(starts)


def _first_at_place(points: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """True for the first ``most`` points by rank of each place; no others can be among the nearest of any point."""
    order = np.lexsort((rank, *points.T))
    moved = np.ones(len(order), bool)
    moved[1:] = (points[order[1:]] != points[order[:-1]]).any(axis=1)
    begins = np.flatnonzero(moved)
    out = np.empty(len(order), bool)
    out[order] = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order)))) < most
    return out


def _narrowed(points: np.ndarray, rows: np.ndarray, near: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Few of the rows at a time, and those of the points near them that can be among their ``need`` nearest, themselves included.

    If the middle of some rows has that many points within r and the farthest of them is h away, each
    has as many within r + h, none of which is farther from the middle than r + 2h.
    """
    todo = [(rows, near)]
    while todo:
        rows, near = todo.pop()
        if len(near) > need:
            lo, hi = points[rows].min(axis=0), points[rows].max(axis=0)
            middle = (lo + hi) / 2
            d2 = np.square(points[near] - middle).sum(axis=1)
            far = np.sqrt(np.partition(d2, need - 1)[need - 1]) + 2 * np.sqrt(np.square(points[rows] - middle).sum(axis=1).max())
            near = near[d2 <= np.square(far * (1 + 1e-9))]
            if len(rows) > (FEW if len(near) <= 16 * need else 1):
                d = int(np.argmax(hi - lo))
                low = points[rows, d] < middle[d]
                if low.any():
                    todo += [(rows[~low], near), (rows[low], near)]
                    continue
        yield rows, near


class Tally:
    """Sums over points of one cell, by their track, the track of the neighbours and k.

    ``tracks`` has a row for each point and a column for each track, with how often the point is in
    it. Points are in the order of ``copy``; ``blank`` ones have no trace, so that it isn't known
    whether they and others of their chromosome are on different copies.
    """

    def __init__(self, ks: list[int], n_tracks: int):
        self.ks = np.array(sorted(ks))
        self.raw = np.zeros((n_tracks, n_tracks, len(ks)), np.int64)
        self.copies = np.zeros((n_tracks, n_tracks, len(ks)), np.int64)

    def add(self, points: np.ndarray, rank: np.ndarray, copy: np.ndarray, chrom: np.ndarray, blank: np.ndarray, tracks: np.ndarray, asked: np.ndarray) -> None:
        """Count the neighbours of the points ``asked`` (true or false for each)."""
        columns = (points, rank, copy, chrom, blank, tracks)
        most = int(self.ks[-1])
        if len(points) <= max(4 * most, 4 * BOX_POINTS):
            self._blocks(columns, np.flatnonzero(asked), np.arange(len(points)))
            return
        kept = _first_at_place(points, rank, most + 1)
        order, starts = boxed(points, BOX_POINTS)
        ends = np.append(starts[1:], len(points))
        lo, hi = np.minimum.reduceat(points[order], starts), np.maximum.reduceat(points[order], starts)
        radius2 = reach(lo, hi, np.add.reduceat(kept[order].astype(np.int64), starts), most + 1)
        for box, (a, b) in enumerate(zip(starts, ends)):
            rows = order[a:b][asked[order[a:b]]]
            if not len(rows):
                continue
            met = np.flatnonzero(gaps(lo[box : box + 1], hi[box : box + 1], lo, hi)[0] <= radius2[box])
            near = np.concatenate([order[starts[m] : ends[m]] for m in met])
            near = near[kept[near]]
            near = near[gaps(points[near], points[near], lo[box : box + 1], hi[box : box + 1])[:, 0] <= radius2[box]]
            for some, others in _narrowed(points, rows, np.sort(near), most + 1):
                self._blocks(columns, some, others)

    def _blocks(self, columns: tuple[np.ndarray, ...], rows: np.ndarray, near: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(near)))
        for k in range(0, len(rows), step):
            self._block(*columns, rows[k : k + step], near)

    def _block(self, points: np.ndarray, rank: np.ndarray, copy: np.ndarray, chrom: np.ndarray, blank: np.ndarray, tracks: np.ndarray, rows: np.ndarray, near: np.ndarray) -> None:
        d2 = np.zeros((len(rows), len(near)))
        for d in range(3):
            delta = points[rows, d, None] - points[near, d]
            d2 += delta * delta
        at = np.minimum(np.searchsorted(near, rows), len(near) - 1)
        own = near[at] == rows
        d2[own, at[own]] = np.inf
        # Level j: not among the nearest ks[j - 1], but among the nearest ks[j].
        levels = len(self.ks)
        level = np.full(d2.shape, levels, np.uint8)
        short = [k for k in self.ks if k < len(near)]
        level -= np.uint8(levels - len(short))
        if short:
            ordered = np.partition(d2, [k - 1 for k in short], axis=1)
            tied = np.zeros(len(rows), bool)
            for k in short:
                within = d2 <= ordered[:, k - 1, None]
                tied |= np.count_nonzero(within, axis=1) > k
                level -= within.view(np.uint8)
            tied = np.flatnonzero(tied)
            if len(tied):
                by_rank = np.argsort(rank[near])
                places = np.argsort(d2[np.ix_(tied, by_rank)], axis=1, kind="stable")
                exact = np.empty(places.shape, np.uint8)
                np.put_along_axis(exact, by_rank[places], np.searchsorted(self.ks, np.arange(1, len(near) + 1)).astype(np.uint8)[None, :], axis=1)
                level[tied] = exact
        same = copy[rows, None] == copy[near]
        if blank[rows].any() or blank[near].any():
            same |= (chrom[rows, None] == chrom[near]) & (blank[rows, None] | blank[near])
        np.putmask(level, same, levels)
        times = tracks[rows].astype(np.int64)
        for t in range(tracks.shape[1]):
            cols = np.repeat(np.arange(len(near)), tracks[near, t])
            if not len(cols):
                continue
            part, of = level[:, cols], copy[near[cols]]
            first = np.minimum.reduceat(part, np.flatnonzero(np.append(True, of[1:] != of[:-1])), axis=1)
            for j in range(levels):
                self.raw[:, t, j] += np.count_nonzero(part <= j, axis=1) @ times
                self.copies[:, t, j] += np.count_nonzero(first <= j, axis=1) @ (times > 0)
