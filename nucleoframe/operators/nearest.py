"""The k nearest spots of a cell, and what they are made of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.functions.neighbours import Tally
from nucleoframe.operators.tiles import parted
from nucleoframe.session import cut_lineage

_SUMS = "track string, near_track string, k int, raw bigint, copies bigint"


def _square(a: str, b: str) -> Column:
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def nearest_k(spots: DataFrame, k: int, radius: float = 0.6, apart: bool = False, growth: float = 4.0) -> DataFrame:
    """(row_id, near_id, dist2, rank): the k nearest other spots of each spot's cell, ties by row_id.

    With ``apart`` spots at distance 0 don't count. Spots look in a grid as wide as the radius;
    those that find k within it are done, the few others look again in a coarser grid, until the
    radius spans their cell. Spots of cells with fewer others get all of them. Coordinates
    must be known; an empty table gives an empty result.
    """
    all_ = spots.select("row_id", "cell_id", "x", "y", "z")
    spans = all_.groupBy("cell_id").agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"])
    spans = spans.select("cell_id", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).alias("span"))
    found, todo = None, cut_lineage(all_.join(spans, "cell_id"))
    while True:
        home = all_.select("*", *[F.floor(F.col(c) / radius).alias(f"g{c}") for c in "xyz"])
        ask = todo.select("*", *[F.floor(F.col(c) / radius).alias(f"g{c}") for c in "xyz"])
        for c in "xyz":
            ask = ask.withColumn(f"g{c}", F.explode(F.array(*[F.col(f"g{c}") + m for m in (-1, 0, 1)])))
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("cell_id", "gx", "gy", "gz")]
        pairs = ask.alias("a").join(home.alias("b"), [*same, F.col("a.row_id") != F.col("b.row_id")]).select(F.col("a.row_id").alias("row_id"), F.col("b.row_id").alias("near_id"), (F.col("a.span") <= radius).alias("whole"), _square("a", "b").alias("dist2")).where(F.col("dist2") <= radius * radius)
        if apart:
            pairs = pairs.where("dist2 > 0")
        top = cut_lineage(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy("dist2", "near_id"))).where(F.col("rank") <= k))
        # Done are those that found k, and those whose cell the radius spans.
        full = top.where((F.col("rank") == k) | F.col("whole")).select("row_id").distinct()
        done = top.join(full, "row_id", "left_semi").drop("whole")
        found = done if found is None else found.unionByName(done)
        todo = cut_lineage(todo.where(F.col("span") > radius).join(full, "row_id", "left_anti"))
        if todo.isEmpty():
            return found
        radius *= growth


def closest(spots: DataFrame, k: int, radius: float = 0.6) -> DataFrame:
    """Per spot the mean of the k smallest distances above 0 in its cell."""
    return nearest_k(spots, k, radius, apart=True).groupBy("row_id").agg(F.avg(F.sqrt("dist2")).alias("value"))


def _marked(spots: DataFrame, tracks: DataFrame) -> DataFrame:
    """Spots with ``tracks``, an array of the tracks that hold their start; the intervals of a chromosome are one broadcast row."""
    known = tracks.where("chrom IS NOT NULL").groupBy(F.col("chrom").alias("_chrom")).agg(F.collect_list(F.struct("lo", "hi", "track")).alias("_parts"))
    hit = F.filter("_parts", lambda t: (F.col("start_bp") >= t["lo"]) & (F.col("start_bp") < t["hi"]))
    return spots.join(F.broadcast(known), F.col("chrom") == F.col("_chrom"), "left").withColumn("tracks", F.coalesce(F.transform(hit, lambda t: t["track"]), F.array().cast("array<string>")))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _tallied(ks: list[int]):
    """Sums of one unit: hits and copies by track, track of the neighbours and k; spots by track, where k is null."""

    def tallied(unit: pa.Table) -> pa.Table:
        n = unit.num_rows
        cell, chrom, trace = (_codes(unit.column(c))[0] for c in ("cell_id", "chrom", "trace_id"))
        none = unit.column("cell_id").is_null().to_numpy() | unit.column("row_id").is_null().to_numpy()
        blank = unit.column("trace_id").is_null().to_numpy()
        copy = chrom * (trace.max() + 1) + trace
        rank = np.empty(n, np.int64)
        rank[pc.sort_indices(unit.column("row_id")).to_numpy()] = np.arange(n)
        of = unit.column("tracks").combine_chunks()
        track, names = _codes(pa.chunked_array([pc.list_flatten(of)], of.type.value_type))
        tracks = np.zeros((n, len(names)), np.int32)
        np.add.at(tracks, (pc.list_parent_indices(of).to_numpy(), track), 1)
        home = unit.column("home").to_numpy()
        total = tracks[home].sum(axis=0)
        tally = Tally(ks, len(names))
        points = np.column_stack([unit.column(c).to_numpy() for c in "xyz"])
        asked = home & (tracks > 0).any(axis=1)
        order = np.lexsort((rank, copy, cell))
        order = order[~none[order]]
        for some in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if asked[some].any():
                tally.add(points[some], rank[some], copy[some], chrom[some], blank[some], tracks[some], asked[some])
        s, t, j = np.nonzero(tally.raw)
        known = np.flatnonzero(total)
        return pa.table({
            "track": names.take(pa.array(np.append(known, s))),
            "near_track": pa.concat_arrays([pa.nulls(len(known), names.type), names.take(pa.array(t))]),
            "k": pa.concat_arrays([pa.nulls(len(known), pa.int32()), pa.array(tally.ks[j].astype(np.int32))]),
            "raw": pa.array(np.append(total[known], tally.raw[s, t, j])),
            "copies": pa.array(np.append(np.zeros_like(known), tally.copies[s, t, j])),
        })

    return tallied


def composition(spots: DataFrame, tracks: DataFrame, ks: list[int]) -> DataFrame:
    """Per track, track of the neighbours and k: spots, and mean numbers of hits and of their distinct copies.

    A hit is one of the k nearest spots (ties by row_id) that is in the neighbours' track and on another copy
    (chromosome and trace) than the spot itself. Neighbours are found and counted where the spots of a cell, or
    of a tile of a large one, lie together; only sums leave a task.
    """
    ks = sorted(set(ks))
    near = _marked(spots, tracks).select("row_id", "cell_id", "chrom", "trace_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], "tracks")
    sums = parted(near, ks[-1]).groupBy("unit").applyInArrow(_tallied(ks), _SUMS)
    sums = sums.groupBy("track", "near_track", "k").agg(F.sum("raw").alias("raw"), F.sum("copies").alias("copies")).where("track IS NOT NULL")
    sums = sums.withColumn("n_spots", F.max(F.when(F.col("k").isNull(), F.col("raw"))).over(Window.partitionBy("track"))).where("k IS NOT NULL")
    return sums.select("track", "near_track", "k", "n_spots", (F.col("raw") / F.col("n_spots")).alias("raw"), (F.col("copies") / F.col("n_spots")).alias("copies"))
