"""Neighbours within a distance and containing regions, over quadtree partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoframe.functions.rtree import PackedTree, z_order
from nucleoframe.operators.quadtree import Quadtree, plan_quadtree

LEAF_POINTS = 20_000
_PLACED = "leaf int, kind tinyint, id bigint, who bigint, x double, y double, z double, x2 double, y2 double, z2 double"
_FOUND = "near_kind string, row_id bigint, near_id bigint, distance double"


def _place(tree: Quadtree, margin: float):
    """Send each point to every leaf within the margin, each box to every leaf it meets."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            at = np.nonzero(kind == 0)[0]
            rows, leaves = tree.leaves_near(x[at], y[at], margin)
            rows = at[rows]
            if len(at) < len(kind):
                box = np.nonzero(kind == 1)[0]
                x2, y2 = (batch.column(c).to_numpy(zero_copy_only=False)[box] for c in ("x2", "y2"))
                r, found = tree.leaves_of_boxes(x[box], x2, y[box], y2)
                rows, leaves = np.concatenate([rows, box[r]]), np.concatenate([leaves, found])
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int32)), *out.columns], names=["leaf", *batch.schema.names])

    return place


def _probe(tree: Quadtree, radius: float):
    """Neighbours and containments of one leaf. Whatever lies in several leaves is reported by
    the leaf that holds its reference point: the middle of a pair, the point inside a box."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        leaf = group.column("leaf")[0].as_py()
        col = {c: group.column(c).to_numpy() for c in group.column_names}
        spot, box = np.nonzero(col["kind"] == 0)[0], np.nonzero(col["kind"] == 1)[0]
        points = np.column_stack([col[c][spot] for c in "xyz"]) if len(spot) else np.zeros((0, 3))
        order = z_order(points)
        points, spot = points[order], spot[order]
        ids, who = col["id"][spot], col["who"][spot]
        packed = PackedTree(points)
        if radius > 0:
            for i, j, d2 in packed.pairs_within(radius):
                mine = tree.leaf_of((points[i, 0] + points[j, 0]) / 2, (points[i, 1] + points[j, 1]) / 2) == leaf
                mine &= who[i] != who[j]
                i, j, d2 = i[mine], j[mine], d2[mine]
                if len(i):
                    yield _batch("spot", np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.sqrt(d2))
        if len(box) and len(spot):
            native = tree.leaf_of(points[:, 0], points[:, 1]) == leaf
            lo = np.column_stack([col[c][box] for c in ("x", "y", "z")])
            hi = np.column_stack([col[c][box] for c in ("x2", "y2", "z2")])
            for b, p in packed.inside(lo, hi):
                b, p = b[native[p]], p[native[p]]
                if len(b):
                    yield _batch("body", ids[p], col["id"][box[b]], np.zeros(len(b)))

    return probe


def _batch(kind: str, left: np.ndarray, right: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    kinds = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(left), np.int32)), pa.array([kind])).dictionary_decode()
    return pa.RecordBatch.from_arrays([kinds, pa.array(left), pa.array(right), pa.array(distance)], names=["near_kind", "row_id", "near_id", "distance"])


def near_or_inside(
    points: DataFrame,
    radius: float,
    regions: DataFrame | None = None,
    id_col: str = "row_id",
    differ: Column | None = None,
    region_id: str = "body_id",
    leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """For each point, other points within ``radius`` and the axis-parallel regions that contain it.

    Columns: near_kind (``spot`` or ``body``), row_id, near_id, distance (0 for a region).
    A pair of points comes out once, the smaller id first; pairs whose ``differ`` values are
    equal don't come out (give a hash of the columns that must differ somewhere). Points with
    a null or NaN coordinate and regions with a null or NaN bound match nothing; bounds count
    as inside. Repeated rows match like others. An empty table gives an empty result.

    A bounded sample shapes a quadtree. Points go to every leaf within half the radius, so
    the leaf with the middle of a pair holds both its ends and alone reports it.
    """
    finite = F.lit(True)
    for c in ("x", "y", "z"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    none = F.lit(None).cast("double")
    spots = points.where(finite).select(
        F.lit(0).cast("tinyint").alias("kind"), F.col(id_col).cast("bigint").alias("id"), (F.col(id_col).cast("bigint") if differ is None else differ).alias("who"), "x", "y", "z", none.alias("x2"), none.alias("y2"), none.alias("z2")
    )
    margin = radius / 2 * (1 + 1e-9) + 1e-9
    tree = plan_quadtree(spots, margin, leaf_points)
    items = spots
    if regions is not None:
        sides = ["x_lo", "y_lo", "z_lo", "x_hi", "y_hi", "z_hi"]
        given = F.lit(True)
        for c in sides:
            given = given & F.col(c).isNotNull() & ~F.isnan(c)
        items = items.unionByName(
            regions.where(given).select(F.lit(1).cast("tinyint").alias("kind"), F.col(region_id).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("who"), *[F.col(s).alias(n) for s, n in zip(sides, ("x", "y", "z", "x2", "y2", "z2"))])
        )
    placed = items.mapInArrow(_place(tree, margin), _PLACED)

    probe = _probe(tree, radius)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from probe(batches)

    return placed.groupBy("leaf").applyInArrow(found, _FOUND)


def _spread(rows: DataFrame, radius: float, leaf_points: int):
    """A tree, and the function that sends each point to every leaf within half the radius."""
    margin = radius / 2 * (1 + 1e-9) + 1e-9
    tree = plan_quadtree(rows, margin, leaf_points)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, leaves = tree.leaves_near(batch.column("x").to_numpy(), batch.column("y").to_numpy(), margin)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int32)), *out.columns], names=["leaf", *batch.schema.names])

    return tree, place


_SPOT = "leaf int, id bigint, key bigint, chrom bigint, trace bigint, start bigint, source boolean, x double, y double, z double"
_SUMS = "id bigint, n bigint, inter bigint, trans bigint, far bigint, same_place bigint, distance double, kernel double"


def _sums(tree: Quadtree, radius: float, far: int, sigma: float):
    """Sums over the neighbours of each point that the pairs of one leaf give: a pair belongs to the leaf of its middle."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        leaf = t.column("leaf")[0].as_py()
        points = np.column_stack([t.column(c).to_numpy() for c in "xyz"])
        cell = np.unique(t.column("key").to_numpy(), return_inverse=True)[1]
        order = z_order(points, cell)
        points, cell = points[order], cell[order]
        ids, chrom, trace, start, source = (t.column(c).to_numpy(zero_copy_only=False)[order] for c in ("id", "chrom", "trace", "start", "source"))
        out = np.zeros((7, len(ids)))
        for i, j, d2 in PackedTree(points).pairs_within(radius, cell):
            mine = (tree.leaf_of((points[i, 0] + points[j, 0]) / 2, (points[i, 1] + points[j, 1]) / 2) == leaf) & (d2 < radius * radius)
            i, j, d2 = i[mine], j[mine], d2[mine]
            other = chrom[i] != chrom[j]
            d = np.sqrt(d2)
            apart = d > 0
            values = [np.ones(len(i)), other, other | (trace[i] != trace[j]), ~other & (np.abs(start[i] - start[j]) >= far), ~apart, d, np.where(apart, np.exp(-d2 / (2 * sigma * sigma)), 0.0)]
            for me, it in ((i, j), (j, i)):
                seen = source[it]
                for k, v in enumerate(values):
                    out[k] += np.bincount(me[seen], v[seen], len(ids))
        met = np.nonzero(out[0])[0]
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(ids[met]), *[pa.array(out[k][met].astype(np.int64)) for k in range(5)], pa.array(out[5][met]), pa.array(out[6][met])], names=["id", "n", "inter", "trans", "far", "same_place", "distance", "kernel"])

    return sums


def neighbour_sums(spots: DataFrame, radius: float, far: int, sigma: float, source: Column | None = None, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Per spot (row_id) sums over the other spots of its cell closer than ``radius``.

    n, of another chromosome (inter), of another chromosome or trace (trans), of the same chromosome from
    ``far`` on, at the same place, the sum of distances, and of exp(-d2 / 2 sigma2) over those apart. Only spots for which
    ``source`` holds are counted. Spots without a neighbour have no row. Pairs are folded where they are found, over
    quadtree leaves with an R-tree each, so that no pair is shuffled.
    """
    rows = spots.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND cell_id IS NOT NULL").select(
        F.col("row_id").alias("id"), F.xxhash64("cell_id").alias("key"), F.xxhash64("chrom").alias("chrom"), F.xxhash64("trace_id").alias("trace"), F.coalesce("start_bp", F.lit(0)).alias("start"),
        (F.lit(True) if source is None else F.coalesce(source, F.lit(False))).alias("source"), "x", "y", "z"
    )
    tree, place = _spread(rows, radius, leaf_points)
    work = _sums(tree, radius, far, sigma)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)

    found = rows.mapInArrow(place, _SPOT).groupBy("leaf").applyInArrow(fold, _SUMS)
    return found.groupBy(F.col("id").alias("row_id")).agg(*[F.sum(c).alias(c) for c in ("n", "inter", "trans", "far", "same_place", "distance", "kernel")])


def _counted(tree: Quadtree, radius: float):
    """Pairs of one key and different labels whose middle lies in a leaf, counted by their labels."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        leaf = t.column("leaf")[0].as_py()
        points = np.column_stack([t.column(c).to_numpy() for c in "xyz"])
        keys, key = np.unique(t.column("key").to_numpy(), return_inverse=True)
        names, name = np.unique(t.column("name").to_numpy(), return_inverse=True)
        order = z_order(points, key)
        points, key, name = points[order], key[order], name[order]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            code, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return code, np.bincount(back, np.concatenate([h[1] for h in held]), len(code))

        for i, j, _ in PackedTree(points).pairs_within(radius, key):
            mine = (name[i] != name[j]) & (tree.leaf_of((points[i, 0] + points[j, 0]) / 2, (points[i, 1] + points[j, 1]) / 2) == leaf)
            i, j = i[mine], j[mine]
            low, high = np.minimum(name[i], name[j]), np.maximum(name[i], name[j])
            held.append(((key[i].astype(np.int64) * len(names) + low) * len(names) + high, np.ones(len(i))))
            size += len(i)
            if size > 2_000_000:
                held, size = [fold()], 0
        if held:
            code, n = fold()
            yield pa.RecordBatch.from_arrays([pa.array(keys[code // len(names) ** 2]), pa.array(names[code // len(names) % len(names)]), pa.array(names[code % len(names)]), pa.array(n.astype(np.int64))], names=["_key", "_a", "_b", "n"])

    return counted


def pair_counts(spots: DataFrame, radius: float, key: list[str], label: list[str], leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Pairs of spots at most ``radius`` apart with one key and different labels, counted: the key, both labels (ending in 1 and 2), n.

    Which label comes first is not defined, but is the same for all pairs of two labels of a key. Pairs are
    found in quadtree leaves with an R-tree each and counted there, so that only counts are shuffled. Spots with a null in
    the key or an unknown place have no pair.
    """
    known = spots.dropna(subset=[*key, "x", "y", "z"])
    rows = known.select(F.xxhash64(*key).alias("key"), F.xxhash64(*label).alias("name"), "x", "y", "z")
    tree, place = _spread(rows, radius, leaf_points)
    work = _counted(tree, radius)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)

    found = rows.mapInArrow(place, "leaf int, key bigint, name bigint, x double, y double, z double").groupBy("leaf").applyInArrow(count, "_key bigint, _a bigint, _b bigint, n bigint")
    sums = found.groupBy("_key", "_a", "_b").agg(F.sum("n").alias("n"))
    own = [c for c in label if c not in key]
    named = known.select(*key, *own).distinct().select(F.xxhash64(*key).alias("_key"), F.xxhash64(*label).alias("_name"), *key, *own)
    one = named.select("_key", F.col("_name").alias("_a"), *key, *[F.col(c).alias(f"{c}1") for c in own])
    two = named.select("_key", F.col("_name").alias("_b"), *[F.col(c).alias(f"{c}2") for c in own])
    return sums.join(one, ["_key", "_a"]).join(two, ["_key", "_b"]).drop("_key", "_a", "_b")
