"""Hierarchical density clustering of records in space.

A quadtree spreads the records; each leaf builds the mutual-reachability graph of its
neighbours within ``eps`` and contracts it by Borůvka's rule as far as no other leaf can have
a say. What remains between leaves, a graph of the records at their rims, is contracted by
Borůvka rounds over tables. The forest's edges, taken from the lightest up, build the condensed
hierarchy of each component, whose most stable clusters come out with their sizes and most
persistent members. A component of any size has the same hierarchy: large ones are built slice by
slice of their edges, and only what a slice needs of the clusters so far is handed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.functions.rtree import PackedTree, z_order
from nucleoframe.llm.forest import boruvka, distributed_boruvka
from nucleoframe.operators.quadtree import Quadtree, plan_quadtree
from nucleoframe.session import cut_lineage, discard, ranked, settled

LEAF_POINTS = 20_000
#: Edges of one component that one task works on; larger components are worked on in slices.
SLICE = 500_000
#: Distances below this count as this, so that persistence stays finite for equal places.
LEAST_DISTANCE = 1e-4

_PLACED = "leaf int, id bigint, key bigint, x double, y double, z double"
#: kind 0: edge a-b surely in the forest, in component rep (closed tells whether it is whole);
#: kind 1: rim edge a-b to be judged over tables; kind 2: record a in component rep.
_LOCAL = "kind tinyint, closed boolean, rep bigint, a bigint, b bigint, w double"


def _place(tree: Quadtree, margin: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            rows, leaves = tree.leaves_near(x, y, margin)
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int32)), *out.columns], names=["leaf", *batch.schema.names])

    return place


def _core(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, min_points: int) -> np.ndarray:
    """Distance to the min_points-th record, itself the first; infinite if eps holds fewer."""
    core = np.full(n, np.inf)
    who, dist = np.concatenate([i, j]), np.concatenate([d, d])
    order = np.lexsort((dist, who))
    who, dist = who[order], dist[order]
    first = np.searchsorted(who, np.arange(n))
    count = np.searchsorted(who, np.arange(n), "right") - first
    enough = np.nonzero(count >= min_points - 1)[0]
    core[enough] = dist[first[enough] + min_points - 2]
    return core


def _light(ids: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in their total order."""
    a, b = ids[i], ids[j]
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    return i[order], j[order], w[order]


def _local(tree: Quadtree, eps: float, min_points: int, edges_too: bool, least_size: int):
    half = eps / 2 * (1 + 1e-9) + 1e-9

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        leaf = t.column("leaf")[0].as_py()
        ids, key = t.column("id").to_numpy(), np.unique(t.column("key").to_numpy(), return_inverse=True)[1]
        points = np.column_stack([t.column(c).to_numpy() for c in "xyz"])
        order = z_order(points, key)
        ids, key, points = ids[order], key[order], points[order]
        n = len(ids)
        packed = PackedTree(points)
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        core = np.zeros(n)
        if min_points > 1:
            parts = list(packed.pairs_within(eps, key))
            if parts:
                i, j, d = (np.concatenate([p[k] for p in parts]) for k in range(3))
                d = np.sqrt(d)
                core = _core(n, i, j, d, min_points)
                kept.append((i, j, d))
        else:
            held = 0
            for i, j, d2 in packed.pairs_within(eps, key):
                kept.append((i, j, np.sqrt(d2)))
                held += len(i)
                if held > 3_000_000:  # keep what can still be in the forest
                    i, j, w = _light(ids, *(np.concatenate([p[k] for p in kept]) for k in range(3)))
                    e = boruvka(np.arange(n), i, j, np.zeros(n, bool))[1]
                    kept, held = [(i[e], j[e], w[e])], len(e)
        i, j, d = (np.concatenate([p[k] for p in kept]) for k in range(3))
        w = np.maximum(d, np.maximum(core[i], core[j])) if min_points > 1 else d
        mine = np.isfinite(w) & (w <= eps) & (tree.leaf_of((points[i, 0] + points[j, 0]) / 2, (points[i, 1] + points[j, 1]) / 2) == leaf)
        i, j, w = _light(ids, i[mine], j[mine], w[mine])
        rows = tree.leaves_near(points[:, 0], points[:, 1], half)[0]
        shared = np.bincount(rows, minlength=n) > 1
        label, sure = boruvka(np.arange(n), i, j, shared)
        _, more = boruvka(label, i, j, np.zeros(n, bool))
        # A component is named by its smallest shared record, or its smallest record if it is whole.
        rep = np.full(n, np.iinfo(np.int64).max)
        open_ = np.zeros(n, bool)
        np.logical_or.at(open_, label, shared)
        named = shared | ~open_[label]
        np.minimum.at(rep, label[named], ids[named])
        rep, size = rep[label], np.bincount(label, minlength=n)[label]
        closed = ~open_[label]
        native = tree.leaf_of(points[:, 0], points[:, 1]) == leaf
        big = ~closed | (size >= least_size)
        member = np.nonzero(native & big & (size > 1) | (native & shared))[0]
        out = [(2, closed[member], rep[member], ids[member], ids[member], np.zeros(len(member)))]
        link = np.nonzero(shared & (rep != ids) & (size > 1))[0]
        out.append((1, np.zeros(len(link), bool), rep[link], rep[link], ids[link], np.full(len(link), -1.0)))
        out.append((1, np.zeros(len(more), bool), rep[i[more]], rep[i[more]], rep[j[more]], w[more]))
        if edges_too:
            e = sure[big[i[sure]]]
            out.append((0, closed[i[e]], rep[i[e]], ids[i[e]], ids[j[e]], w[e]))
        for kind, c, r, a, b, x in out:
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), kind, np.int8)), pa.array(c), pa.array(r), pa.array(a), pa.array(b), pa.array(x)], names=["kind", "closed", "rep", "a", "b", "w"])

    return local


def _contracted(points: DataFrame, id_col: str, key: Column, eps: float, min_points: int, edges_too: bool, least_size: int, leaf_points: int) -> DataFrame:
    finite = F.col(id_col).isNotNull()
    for c in ("x", "y", "z"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    spots = points.where(finite).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    margin = (eps / 2 if min_points == 1 else 1.5 * eps) * (1 + 1e-9) + 2e-9
    tree = plan_quadtree(spots, margin, leaf_points)
    work = _local(tree, eps, min_points, edges_too, least_size)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)

    return cut_lineage(spots.mapInArrow(_place(tree, margin), _PLACED).groupBy("leaf").applyInArrow(local, _LOCAL))


def _rooted(local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, root) of all records of components, and the rim edges that the forest takes."""
    rim = local.where("kind = 1").select("a", "b", "w")
    labels, taken = distributed_boruvka(rim)
    member = local.where("kind = 2")
    whole = member.where("closed").select(F.col("a").alias("id"), F.col("rep").alias("root"))
    joined = member.where("NOT closed").join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left").select(F.col("a").alias("id"), F.coalesce("root", "rep").alias("root"))
    return whole.unionByName(joined), taken.where("w >= 0")


class _Merger:
    """The condensed hierarchy of one component, built from its lightest edge up.

    A part of fewer than ``least`` records is a list of them. When a part reaches ``least``, it becomes a
    cluster, and a smaller part that meets it falls to it; where two clusters meet, both end and a
    new one begins that holds them. A cluster has its records, the sum of their rates (one over the
    distance at which each came, at most the distance at which the cluster began), and the best stability that lies below it
    (none for the first of their kind).
    """

    def __init__(self, ids: np.ndarray, least: int):
        n = len(ids)
        self.least, self.up = least, list(range(n))
        self.size: list[int] = [1] * n
        self.loose: list[list[int]] = [[i] for i in ids.tolist()]
        self.cluster: list[int] = [-1] * n
        self.total, self.below = [0.0] * n, [-np.inf] * n
        #: (record, rate, cluster), and (cluster, the one that holds it, own stability, best below).
        self.fell: list[tuple[int, float, int]] = []
        self.ended: list[tuple[int, int, float, float]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def merge(self, u: list[int], v: list[int], w: list[float], name: list[int]) -> None:
        least, size = self.least, self.size
        for a, b, d, new in zip(u, v, w, name):
            p, q = self.root(a), self.root(b)
            if size[p] < size[q]:
                p, q = q, p
            rate = 1.0 / max(d, LEAST_DISTANCE)
            if size[p] < least:
                self.loose[p] += self.loose[q]
                if size[p] + size[q] >= least:
                    self.fell += [(i, rate, new) for i in self.loose[p]]
                    self.loose[p], self.cluster[p], self.total[p] = [], new, rate * (size[p] + size[q])
            elif size[q] < least:
                self.fell += [(i, rate, self.cluster[p]) for i in self.loose[q]]
                self.total[p] += rate * size[q]
            else:
                below = 0.0
                for part in (p, q):
                    own = self.total[part] - rate * size[part]
                    self.ended.append((self.cluster[part], new, own, self.below[part]))
                    below += max(own, self.below[part])
                self.cluster[p], self.total[p], self.below[p] = new, rate * (size[p] + size[q]), below
            self.loose[q] = []
            size[p] += size[q]
            self.up[q] = p


def _condense(a: np.ndarray, b: np.ndarray, w: np.ndarray, eps: float, least_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One component's records, the smallest record of their cluster (-1 for none), and their persistence."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    m = _Merger(ids, least_size)
    m.merge(u[order].tolist(), v[order].tolist(), w[order].tolist(), list(range(len(order))))
    p = m.root(0)
    ended = m.ended + [(m.cluster[p], -1, m.total[p] - m.size[p] / eps, m.below[p])]
    # The uppermost cluster that has at least the stability of what lies below it; those above come later.
    kept = {-1: -1}
    for c, above, own, below in reversed(ended):
        kept[c] = kept[above] if kept[above] >= 0 else c if own >= below else -1
    who, rate, home = np.array([f[0] for f in m.fell]), np.array([f[1] for f in m.fell]), np.array([kept[f[2]] for f in m.fell])
    first = np.full(len(order), np.iinfo(np.int64).max)
    inside = home >= 0
    np.minimum.at(first, home[inside], who[inside])
    return who, np.where(inside, first[home], -1), rate


def _condensed(eps: float, least_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            root, a, b, w = (t.column(c).to_numpy() for c in ("root", "a", "b", "w"))
            cuts = np.nonzero(np.diff(root))[0] + 1
            out = []
            for s, e in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(root)]])):
                if e - s + 1 >= least_size:
                    who, cluster, rate = _condense(a[s:e], b[s:e], w[s:e], eps, least_size)
                    out.append((who, np.full(len(who), who.min()), cluster, rate))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(4)], names=["row_id", "root_id", "cluster_id", "persistence"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows > 50_000:
                root = batch.column("root").to_numpy()
                new = np.nonzero(root != held[-1].column("root")[held[-1].num_rows - 1].as_py())[0]
                if len(new):
                    held.append(batch.slice(0, int(new[0])))
                    yield from work([h for h in held if h.num_rows])
                    held, rows, batch = [], 0, batch.slice(int(new[0]))
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from work(held)

    return run


_HIERARCHY = "row_id bigint, root_id bigint, cluster_id bigint, persistence double"
#: kind 0: part a is now in part b; kind 1: the state of part a; kind 2: record a fell to cluster b at
#: rate x; kind 3: cluster a ended in cluster b with own stability x and best below y.
_SLICED = "root bigint, kind tinyint, a bigint, b bigint, n bigint, loose array<bigint>, x double, y double"


def _slice(least_size: int):
    def run(key, edges: pa.Table, states: pa.Table) -> pa.Table:
        root = key[0].as_py()
        edges = edges.sort_by("place")
        la, lb = edges.column("la").to_numpy(), edges.column("lb").to_numpy()
        ids, at = np.unique(np.concatenate([la, lb]), return_inverse=True)
        m = _Merger(ids, least_size)
        place = {i: k for k, i in enumerate(ids.tolist())}
        for a, b, n, loose, x, y in zip(*(states.column(c).to_pylist() for c in ("a", "b", "n", "loose", "x", "y"))):
            k = place[a]
            m.size[k], m.loose[k], m.cluster[k], m.total[k], m.below[k] = n, list(loose), b, x, y
        m.merge(at[: len(la)].tolist(), at[len(la) :].tolist(), edges.column("w").to_pylist(), edges.column("place").to_pylist())
        parts = [m.root(k) for k in range(len(ids))]
        tops = sorted(set(parts))
        name = {p: int(ids[p]) for p in tops}
        rows = [(0, int(ids[k]), name[p], None, None, None, None) for k, p in enumerate(parts)]
        rows += [(1, name[p], m.cluster[p], m.size[p], m.loose[p], m.total[p], m.below[p]) for p in tops]
        rows += [(2, i, c, None, None, rate, None) for i, rate, c in m.fell]
        rows += [(3, c, above, None, None, own, below) for c, above, own, below in m.ended]
        kind, a, b, n, loose, x, y = zip(*rows)
        return pa.table({"root": pa.array([root] * len(rows), pa.int64()), "kind": pa.array(kind, pa.int8()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()), "loose": pa.array(loose, pa.list_(pa.int64())), "x": pa.array(x, pa.float64()), "y": pa.array(y, pa.float64())})

    return run


def _sliced(forest: DataFrame, eps: float, least_size: int, edges_at_once: int) -> DataFrame:
    """The condensed hierarchy of large components (root, a, b, w), slice by slice of their edges.

    The edges of a component are numbered from the lightest up and cut into slices. One task works
    on a slice, from the parts that lighter slices have joined and the state of those parts, all
    components beside one another; the ends of the edges to come are then renamed. So the hierarchy is
    exact, memory is bounded by the slice, and there are as many rounds as the largest component has slices.
    """
    order = [F.col("root"), F.col("w"), F.least("a", "b"), F.greatest("a", "b")]
    placed = settled(ranked(forest, order))
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    slices = ((F.col("place") - F.col("first")) / edges_at_once).cast("int")
    todo = settled(placed.join(first, "root").select("root", "place", "w", F.col("a").alias("la"), F.col("b").alias("lb"), slices.alias("slice")))
    discard(placed)
    last = todo.agg(F.max("slice")).first()[0]
    states, fell, ended = None, None, None
    for k in range(last + 1):
        now = todo.where(F.col("slice") == k).select("root", "place", "w", "la", "lb")
        needed = now.select("root", F.explode(F.array("la", "lb")).alias("a")).distinct()
        given = forest.sparkSession.createDataFrame([], _SLICED) if states is None else states.join(needed, ["root", "a"], "left_semi").select("root", "kind", "a", "b", "n", "loose", "x", "y")
        out = settled(now.groupBy("root").cogroup(given.groupBy("root")).applyInArrow(_slice(least_size), _SLICED))
        fresh = out.where("kind = 1")
        after = settled(fresh if states is None else states.join(needed, ["root", "a"], "left_anti").unionByName(fresh))
        moved = out.where("kind = 0 AND a <> b").select("root", F.col("a").alias("old"), F.col("b").alias("new"))
        rest = todo.where(F.col("slice") > k)
        for end in ("la", "lb"):
            to = moved.select("root", F.col("old").alias(end), "new")
            rest = rest.join(to, ["root", end], "left").withColumn(end, F.coalesce("new", end)).drop("new")
        rest = settled(rest.select("root", "place", "w", "la", "lb", "slice"))
        discard(todo, *([states] if states is not None else []))
        states, todo = after, rest
        fell = out.where("kind = 2") if fell is None else fell.unionByName(out.where("kind = 2"))
        ended = out.where("kind = 3") if ended is None else ended.unionByName(out.where("kind = 3"))
    whole = states.select("root", F.col("b").alias("c"), F.lit(None).cast("bigint").alias("above"), (F.col("x") - F.col("n") / eps).alias("own"), F.col("y").alias("below"))
    tree = ended.select("root", F.col("a").alias("c"), F.col("b").alias("above"), F.col("x").alias("own"), F.col("y").alias("below")).unionByName(whole)
    # The uppermost cluster kept, by pointer jumping.
    tree = settled(tree.select("root", "c", "above", F.when(F.col("own") >= F.col("below"), F.col("c")).alias("kept")))
    while not tree.where("above IS NOT NULL").isEmpty():
        up = tree.select("root", F.col("c").alias("above"), F.col("above").alias("next"), F.col("kept").alias("higher"))
        after = settled(tree.join(up, ["root", "above"], "left").select("root", "c", F.col("next").alias("above"), F.coalesce("higher", "kept").alias("kept")))
        discard(tree)
        tree = after
    rows = fell.select("root", F.col("a").alias("row_id"), F.col("b").alias("c"), F.col("x").alias("persistence")).join(tree.select("root", "c", "kept"), ["root", "c"])
    named = rows.where("kept IS NOT NULL").groupBy("root", "kept").agg(F.min("row_id").alias("cluster_id"))
    roots = rows.groupBy("root").agg(F.min("row_id").alias("root_id"))
    return rows.join(named, ["root", "kept"], "left").join(roots, "root").select("row_id", "root_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "persistence")


def hierarchy(points: DataFrame, id_col: str, key: Column, eps: float, min_points: int, least_size: int, leaf_points: int = LEAF_POINTS, slice_edges: int = SLICE) -> DataFrame:
    """Every record of a component of at least ``least_size``: row_id, root_id, cluster_id, persistence.

    Records of one key are compared by mutual reachability within ``eps``. root_id is the smallest id of the
    component, the hierarchy cut at ``eps``; cluster_id that of the record's most stable cluster, or -1. persistence is one
    over the distance at which the record comes to a cluster.
    """
    local = _contracted(points, id_col, key, eps, min_points, True, least_size, leaf_points)
    member, taken = _rooted(local)
    member = cut_lineage(member)
    sure = local.where("kind = 0").select("rep", "closed", "a", "b", "w")
    inner = sure.where("closed").select(F.col("rep").alias("root"), "a", "b", "w")
    rim = sure.where("NOT closed").join(member.select(F.col("id").alias("rep"), "root"), "rep").select("root", "a", "b", "w")
    across = taken.join(member.select(F.col("id").alias("a"), "root"), "a").select("root", "a", "b", "w")
    forest = inner.unionByName(rim).unionByName(across)
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    huge = cut_lineage(sizes.where((F.col("n") > slice_edges) & (F.col("n") >= least_size)).select("root"))
    usual = forest if huge.isEmpty() else forest.join(huge, "root", "left_anti")
    found = usual.repartition("root").sortWithinPartitions("root").mapInArrow(_condensed(eps, least_size), _HIERARCHY)
    if not huge.isEmpty():
        found = found.unionByName(_sliced(forest.join(huge, "root", "left_semi"), eps, least_size, slice_edges))
    return found


def linked_groups(points: DataFrame, id_col: str, key: Column, eps: float, least_size: int, leaf_points: int = LEAF_POINTS, slice_edges: int = SLICE) -> DataFrame:
    """(cluster_id, row_id) of the hierarchy cut at ``eps``: records of one key linked by steps of at
    most ``eps``, in groups of at least ``least_size``; cluster_id is the smallest id of the group.

    Each record counts as a core of its own (min_points 1), so mutual reachability is the distance. Records with a null or NaN coordinate are in no group. Equal places are at distance 0, so
    repeated rows are members like others. An empty table gives an empty result.
    """
    return hierarchy(points, id_col, key, eps, 1, least_size, leaf_points, slice_edges).select(F.col("root_id").alias("cluster_id"), "row_id")


def density_clusters(points: DataFrame, id_col: str, key: Column, eps: float, min_points: int = 4, least_size: int = 8, exemplars: int = 3, leaf_points: int = LEAF_POINTS, slice_edges: int = SLICE) -> DataFrame:
    """Clusters of mutually near records of one key: cluster_id, row_id, cluster_size, persistence, exemplar.

    Records are compared by mutual reachability within ``eps``; of the condensed hierarchy of
    each component the clusters with the greatest stability come out, with the ``exemplars`` most
    persistent members marked (ties by smallest id). cluster_id is the smallest id of a cluster. ``slice_edges``
    changes the work, not the result. Records in no cluster, and those with a null or NaN coordinate, have no row.
    """
    found = cut_lineage(hierarchy(points, id_col, key, eps, min_points, least_size, leaf_points, slice_edges).where("cluster_id >= 0").drop("root_id"))
    sized = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    bucket = F.pmod(F.xxhash64("row_id"), F.lit(64))
    near = Window.partitionBy("cluster_id", "bucket").orderBy(F.desc("persistence"), "row_id")
    last = Window.partitionBy("cluster_id").orderBy(F.desc("persistence"), "row_id")
    best = found.withColumn("bucket", bucket).withColumn("k", F.row_number().over(near)).where(F.col("k") <= exemplars).withColumn("k", F.row_number().over(last)).where(F.col("k") <= exemplars)
    marked = best.select("cluster_id", "row_id", F.lit(True).alias("exemplar"))
    return found.join(sized, "cluster_id").join(marked, ["cluster_id", "row_id"], "left").select("cluster_id", "row_id", "cluster_size", "persistence", F.coalesce("exemplar", F.lit(False)).alias("exemplar"))
