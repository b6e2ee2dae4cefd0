"""Traces of chromosomes from their spots, and sister spots that don't belong to them.

Tracing goes window by window along a chromosome. Only the clusters of a window are found from its
spots; chaining and merging see one row per cluster or trace, so that no task holds all spots of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoframe.functions.rtree import PackedTree, z_order
from nucleoframe.functions.runs import bounds, whole_groups
from nucleoframe.model import TRACE_KEY
from nucleoframe.operators.spatial import pair_counts

_GROUP = ["cell_id", "chrom"]


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each vertex's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def dbscan(points: np.ndarray, group: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster of each point within its group, numbered from 0 by first core point; -1 for noise.

    A core point has ``least`` points within ``eps``, itself included; a border point belongs to the first
    cluster that has a core point near it.
    """
    order = z_order(points, group)
    pairs = [(order[i], order[j]) for i, j, _ in PackedTree(points[order]).pairs_within(eps, group[order])]
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in range(2))
    core = np.bincount(np.concatenate([i, j]), minlength=len(points)) + 1 >= least
    both = core[i] & core[j]
    root = _components(len(points), i[both], j[both])
    # A core point's root is the first core point of its cluster.
    first = np.where(core, root, len(points))
    for me, it in ((i, j), (j, i)):
        edge = ~core[me] & core[it]
        np.minimum.at(first, me[edge], root[it[edge]])
    label = np.full(len(points), -1)
    inside = np.nonzero(first < len(points))[0]
    if len(inside):
        roots = np.unique(first[inside])
        start = np.searchsorted(group[roots], np.unique(group), side="left")
        number = np.arange(len(roots)) - start[np.searchsorted(np.unique(group), group[roots])]
        label[inside] = number[np.searchsorted(roots, first[inside])]
    return label


def _clusters(eps: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, [*_GROUP, "window"]):
            points = np.column_stack([t.column(c).to_numpy() for c in "xyz"])
            yield from t.append_column("cluster", pa.array(dbscan(points, group, eps, least).astype(np.int32))).to_batches()

    return run


def _chain(delta: float):
    """Clusters of each window to the traces so far, nearest centres first, each trace once per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, _GROUP):
            window, cluster = t.column("window").to_numpy(), t.column("cluster").to_numpy()
            n, total = t.column("n").to_numpy().astype(float), np.column_stack([t.column(f"s{c}").to_numpy() for c in "xyz"])
            trace, born = np.full(len(window), -1, np.int32), np.zeros(len(window), np.int32)
            for lo, hi in bounds(group):
                held: dict[int, np.ndarray] = {}  # trace: sums of coordinates and number of spots, in order of birth
                rows = np.arange(lo, hi)
                for w in np.unique(window[lo:hi]):
                    now = rows[(window[lo:hi] == w) & (cluster[lo:hi] >= 0)].tolist()
                    ids, free = list(held), []
                    if ids and now:
                        centre = np.array([held[k][:3] / held[k][3] for k in ids])
                        d = np.sqrt(((total[now, None] / n[now, None, None] - centre[None]) ** 2).sum(axis=2))
                        while np.isfinite(d).any() and d.min() <= delta:
                            c, k = np.unravel_index(int(d.argmin()), d.shape)
                            trace[now[c]] = ids[k]
                            d[c, :] = d[:, k] = np.inf
                    for r in now:
                        if trace[r] < 0:
                            free.append(r)
                    for r in now:
                        if trace[r] >= 0:
                            held[int(trace[r])] = held[int(trace[r])] + np.append(total[r], n[r])
                    for r in free:
                        name = int(cluster[r]) if int(cluster[r]) not in held else max(held) + 1
                        trace[r], held[name] = name, np.append(total[r], n[r])
                place = {k: i for i, k in enumerate(held)}
                born[lo:hi] = [place.get(int(k), -1) for k in trace[lo:hi]]
            yield from t.select([*_GROUP, "window", "cluster"]).append_column("trace", pa.array(trace)).append_column("born", pa.array(born)).to_batches()

    return run


def overlap_score(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, length: int) -> float:
    """The larger share of one trace's spots whose start is nearer than ``length`` to some start of the other.

    Starts are distinct and ascending, with how many spots have each.
    """

    def share(p: np.ndarray, weight: np.ndarray, q: np.ndarray) -> float:
        at = np.searchsorted(q, p)
        gap = np.minimum(np.abs(p - q[np.minimum(at, len(q) - 1)]), np.abs(p - q[np.maximum(at - 1, 0)]))
        return float(weight[gap < length].sum() / weight.sum())

    return max(share(a, na, b), share(b, nb, a))


def _merge(length: int, most_overlap: float):
    """Traces that come near one another and hardly overlap along the genome become one; then all are numbered by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, _GROUP, 5_000):
            trace, born, near, starts = (t.column(c).to_pylist() for c in ("trace", "born", "near", "starts"))
            out = np.zeros(len(trace), np.int32)
            for lo, hi in bounds(group):
                order = sorted(range(lo, hi), key=lambda r: born[r])
                held = {trace[r]: {s["start"]: s["n"] for s in starts[r]} for r in order}
                close = {trace[r]: set(near[r]) for r in order}
                into = {k: k for k in held}
                sides = {k: (np.array(sorted(v)), np.array([v[s] for s in sorted(v)])) for k, v in held.items()}
                found = True
                while found:
                    found = False
                    for a in list(held):
                        for b in held:
                            if b > a and b in close[a] and overlap_score(*sides[a], *sides[b], length) < most_overlap:
                                found = True
                                break
                        if found:
                            for s, k in held.pop(b).items():
                                held[a][s] = held[a].get(s, 0) + k
                            sides[a] = (np.array(sorted(held[a])), np.array([held[a][s] for s in sorted(held[a])]))
                            close[a] = (close[a] | close.pop(b)) - {a, b}
                            for c in close:
                                if b in close[c]:
                                    close[c] = (close[c] - {b}) | ({a} if c != a else set())
                            into = {k: a if v == b else v for k, v in into.items()}
                            break
                sizes = {k: sum(v.values()) for k, v in held.items()}
                label = {k: i for i, k in enumerate(sorted(held, key=lambda k: -sizes[k]), 1)}
                for r in range(lo, hi):
                    out[r] = label[into[trace[r]]]
            yield from t.select([*_GROUP, "trace"]).append_column("label", pa.array(out)).to_batches()

    return run


def traced(
    spots: DataFrame, eps: float = 1.0, min_samples: int = 1, window: int = 10_000_000, delta: float = 3.0, near_length: int = 2_000_000, most_overlap: float = 0.3, near_distance: float = 1.0, least_spots: int = 20, no_cells: tuple[str, ...] = ("unsegmented",)
) -> DataFrame:
    """(row_id, trace_id): the traces of each cell's chromosomes, ``1`` the largest, ``-1`` noise.

    Spots of a window are clustered by density; clusters join the trace with the nearest centre within ``delta``,
    one cluster per trace and window, others begin traces; traces that come within ``near_distance`` and
    share less than ``most_overlap`` of their starts are merged. Chromosomes with fewer than
    ``least_spots`` spots, and spots that lie in no cell, keep their traces. Spots with an unknown place, start, cell or chromosome keep theirs too.
    """
    known = F.col("cell_id").isNotNull() & F.col("chrom").isNotNull() & F.col("start_bp").isNotNull() & ~F.coalesce(F.col("cell_id").isin(*no_cells), F.lit(False))
    for c in "xyz":
        known = known & F.col(c).isNotNull()
    s = spots.where(known).select("row_id", *_GROUP, "start_bp", "x", "y", "z")
    enough = s.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least_spots).select(*_GROUP)
    s = s.join(enough, _GROUP, "left_semi").withColumn("window", F.floor(F.col("start_bp") / window).cast("int"))
    schema = "row_id bigint, cell_id string, chrom string, start_bp bigint, x double, y double, z double, window int, cluster int"
    found = s.select("row_id", *_GROUP, "start_bp", "x", "y", "z", "window").repartition(*_GROUP, "window").sortWithinPartitions(*_GROUP, "window", "row_id").mapInArrow(_clusters(eps, min_samples), schema)
    summary = found.where("cluster >= 0").groupBy(*_GROUP, "window", "cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"])
    chained = summary.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "window", "cluster").mapInArrow(_chain(delta), "cell_id string, chrom string, window int, cluster int, trace int, born int")
    placed = found.join(chained, [*_GROUP, "window", "cluster"], "left")
    valid = placed.where("trace IS NOT NULL")
    pairs = pair_counts(valid, near_distance, _GROUP, ["trace"])
    ends = F.array(*[F.struct(F.col(f"trace{p}").alias("trace"), F.col(f"trace{q}").alias("other")) for p, q in ("12", "21")])
    near = pairs.select(*_GROUP, F.inline(ends)).groupBy(*_GROUP, "trace").agg(F.collect_set("other").alias("near"))
    starts = valid.groupBy(*_GROUP, "trace", F.col("start_bp").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.min("born").alias("born"))
    # As many starts as the chromosome has loci, however many spots lie there.
    per_trace = starts.groupBy(*_GROUP, "trace").agg(F.min("born").alias("born"), F.collect_list(F.struct("start", "n")).alias("starts")).join(near, [*_GROUP, "trace"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
    labels = per_trace.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "trace").mapInArrow(_merge(near_length, most_overlap), "cell_id string, chrom string, trace int, label int")
    new = placed.join(labels, [*_GROUP, "trace"], "left").select("row_id", F.coalesce("label", F.lit(-1)).cast("string").alias("label"))
    return spots.select("row_id", "trace_id").join(new, "row_id", "left").select("row_id", F.coalesce("label", "trace_id").alias("trace_id"))


def median_spot(points: np.ndarray, centre: np.ndarray) -> int:
    """The point with the least sum of distances to the others; of one or two, and among equals, the one nearest to the centre, first of those."""
    to_centre = np.sqrt(((points - centre) ** 2).sum(axis=1))
    if len(points) <= 2:
        return int(np.argmin(to_centre))
    total = np.array([np.sqrt(((points - p) ** 2).sum(axis=1)).sum() for p in points])
    return int(np.lexsort((np.arange(len(points)), to_centre, total))[0])


def odd_sisters(points: np.ndarray, middle: np.ndarray | None, most: float) -> list[int]:
    """Which spots of one domain lie apart from the others by ``most`` or more, taken out one after another.

    Of two, the one farther from the middle of the neighbourhood goes; both go if none is given, or both are near it or both far.
    """
    left, gone = list(range(len(points))), []
    while len(left) > 1:
        d = np.sqrt(((points[left][:, None] - points[left][None]) ** 2).sum(axis=2))
        if d.max() < most:
            break
        if len(left) > 2:
            out = [left[int(np.argmax(np.triu(d, 1).sum(axis=0)))]]
        elif middle is None:
            out = list(left)
        else:
            apart = np.sqrt(((points[left] - middle) ** 2).sum(axis=1))
            out = list(left) if apart.max() < most or apart.min() > most else [left[int(np.argmax(apart))]]
        gone += out
        left = [k for k in left if k not in out]
    return gone


def _sisters(most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, [*TRACE_KEY, "at"]):
            points, centre = (np.column_stack([t.column(f"{p}{c}").to_numpy() for c in "xyz"]) for p in ("", "c"))
            ids, mine = t.column("row_id").to_numpy(), t.column("mine").to_numpy(zero_copy_only=False)
            out = []
            for lo, hi in bounds(group):
                own, around = np.nonzero(mine[lo:hi])[0] + lo, np.nonzero(~mine[lo:hi])[0] + lo
                middle = points[around[median_spot(points[around], centre[lo])]] if len(around) else None
                out += [int(ids[own[k]]) for k in odd_sisters(points[own], middle, most)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["row_id"])

    return run


def sister_outliers(spots: DataFrame, most: float, around: int) -> DataFrame:
    """Spots (row_id) that lie ``most`` or farther from their sisters, the other spots of their domain in the trace.

    The middle is the median spot of those of other domains within ``around`` base pairs. A task sees the spots of one
    domain and its surroundings. Spots with an unknown key, start or place are no sisters.
    """
    s = spots.dropna(subset=[*TRACE_KEY, "start_bp", "x", "y", "z"]).select("row_id", *TRACE_KEY, "start_bp", "x", "y", "z")
    several = s.groupBy(*TRACE_KEY, "start_bp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*TRACE_KEY, F.col("start_bp").alias("at"))
    own = s.withColumn("at", F.col("start_bp")).join(several, [*TRACE_KEY, "at"]).select("row_id", *TRACE_KEY, "at", "x", "y", "z", F.lit(True).alias("mine"))
    wide = max(1, around)
    asked = several.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("at") / wide) + k for k in (-1, 0, 1)])))
    near = s.withColumn("bucket", F.floor(F.col("start_bp") / wide)).join(asked, [*TRACE_KEY, "bucket"]).where((F.abs(F.col("start_bp") - F.col("at")) <= around) & (F.col("start_bp") != F.col("at"))).select("row_id", *TRACE_KEY, "at", "x", "y", "z", F.lit(False).alias("mine"))
    centre = s.groupBy(*TRACE_KEY).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    rows = own.unionByName(near).join(centre, TRACE_KEY)
    return rows.repartition(*TRACE_KEY, "at").sortWithinPartitions(*TRACE_KEY, "at", "row_id").mapInArrow(_sisters(most), "row_id bigint")
