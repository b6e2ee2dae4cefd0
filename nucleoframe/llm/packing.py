"""Filling containers of one fixed capacity with items of varying size.

A linear grouping scheme: large sizes are rounded up within groups of about equal cardinality,
configurations of the few rounded sizes are optimised, the actual items take the places of the
rounded ones, and small items go where they fit best. The driver sees the histogram of sizes,
at most one row per size up to the capacity, and the configurations; items stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.session import cut_lineage

#: Items of more than capacity / SMALL are large.
SMALL = 8
GROUPS = 40
#: Items and containers that one task fits together.
SHARD = 40_000
_RANKED = 50_000


def pieces(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, size): items whole, those above the capacity cut into full pieces and a rest.

    Null sizes count as 0; an item of size 0 is one piece of size 0.
    """
    n = F.greatest(F.lit(0), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint"))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0))
    cut = items.select(F.col(id_col).alias("id"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return cut.select("id", "piece_no", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).alias("size"))


def group_sizes(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, int, int]]:
    """(largest size, smallest size, count) of groups of about equal cardinality, from the largest
    down. Items that fill a container alone are a group of their own."""
    out = []
    if histogram.get(capacity):
        out.append((capacity, capacity, histogram[capacity]))
    sizes = sorted((s for s in histogram if s < capacity), reverse=True)
    each = max(1.0, sum(histogram[s] for s in sizes) / groups)
    top, count = None, 0
    for s in sizes:
        top = s if top is None else top
        count += histogram[s]
        if count >= each:
            out.append((top, s, count))
            top, count = None, 0
    if count:
        out.append((top, sizes[-1], count))
    return out


def configurations(groups: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many containers, {group: items of it in each}) until all rounded items have a place.

    The largest rounded size left goes first; the best filling of the rest of its container is
    found by a bounded knapsack over the few sizes, and used as often as the items last.
    """
    left = [g[2] for g in groups]
    out = []
    for first in range(len(groups)):
        while left[first]:
            room = capacity - groups[first][0]
            left[first] -= 1
            reach = [(1, -1)]
            for g in range(first, len(groups)):
                size = groups[g][0]
                for _ in range(min(left[g], room // size)):
                    before = reach[-1][0]
                    after = before | ((before << size) & ((1 << (room + 1)) - 1))
                    if after == before:
                        break
                    reach.append((after, g))
            use = {first: 1}
            at, k = reach[-1][0].bit_length() - 1, len(reach) - 1
            while at:
                while reach[k - 1][0] >> at & 1:
                    k -= 1
                g = reach[k][1]
                use[g] = use.get(g, 0) + 1
                at -= groups[g][0]
                k -= 1
            left[first] += 1
            times = min(left[g] // a for g, a in use.items())
            for g, a in use.items():
                left[g] -= times * a
            out.append((times, use))
    return out


def _place_large(large: DataFrame, groups: list[tuple[int, int, int]], plan: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """Actual items in the places of the rounded ones: (id, piece_no, start, size, container_id)."""
    spark = large.sparkSession
    rows, base, used = [], 0, [0] * len(groups)
    for times, use in plan:
        for g, a in use.items():
            rows.append((g, used[g], used[g] + times * a, a, base))
            used[g] += times * a
        base += times
    places = spark.createDataFrame(rows, "g int, lo bigint, hi bigint, per bigint, base bigint")
    group = F.lit(None).cast("int")
    for g in range(len(groups) - 1, -1, -1):
        group = F.when(F.col("size") >= groups[g][1], F.lit(g)).otherwise(group)
    # Ranks within a group, from counts of buckets and ranks within a bucket.
    buckets = max(1, -(-sum(g[2] for g in groups) // _RANKED))
    tagged = large.withColumn("g", group).withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)))
    before = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n")).select("g", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("g", "bucket").orderBy("id", "piece_no", "start")) - 1
    ranked = tagged.withColumn("r", rank).join(offsets, ["g", "bucket"]).withColumn("r", F.col("r") + F.col("offset"))
    # As many rows as configurations have sizes: bounded by groups and capacity, not by items.
    hit = ranked.join(F.broadcast(places), (ranked["g"] == places["g"]) & (ranked["r"] >= places["lo"]) & (ranked["r"] < places["hi"]))
    return hit.select("id", "piece_no", "start", "size", (F.col("base") + F.floor((F.col("r") - F.col("lo")) / F.col("per"))).alias("container_id"))


def _best_fit(capacity: int):
    """Small items of one shard, largest first, each into the container where it leaves least room."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        shard = t.column("shard")[0].as_py()
        given = t.filter(pc.equal(t.column("kind"), 0))
        open_: list[list[int]] = [[] for _ in range(capacity + 1)]
        rooms = 0  # bit r is set while some container has room r
        for c, room in zip(given.column("container").to_pylist(), given.column("size").to_pylist()):
            open_[room].append(c)
            rooms |= 1 << room
        items = t.filter(pc.equal(t.column("kind"), 1)).sort_by([("size", "descending"), ("id", "ascending"), ("piece_no", "ascending"), ("start", "ascending")])
        at = items.column("size").to_pylist()
        placed, fresh = np.zeros(len(at), np.int64), 0
        for k, s in enumerate(at):
            fitting = rooms >> s
            if fitting:
                room = s + (fitting & -fitting).bit_length() - 1
                c = open_[room].pop()
                if not open_[room]:
                    rooms &= ~(1 << room)
            else:
                room, c = capacity, ((shard + 1) << 40) + fresh
                fresh += 1
            placed[k] = c
            open_[room - s].append(c)
            rooms |= 1 << (room - s)
        yield from items.select(["id", "piece_no", "start", "size"]).append_column("container_id", pa.array(placed)).to_batches()

    return fit


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, groups: int = GROUPS, shard_rows: int = SHARD) -> DataFrame:
    """Every item in a container: id, piece_no, start, size, container_id.

    No container holds more than ``capacity``. Items are whole unless they exceed it; then they
    are cut into full pieces and a rest. Null and zero sizes take no room but have a container.
    Repeated rows are packed one by one. Ids may be numbers or text. An empty table gives an empty result.
    """
    cut = cut_lineage(pieces(items, id_col, size_col, capacity))
    least = capacity // SMALL
    histogram = {r["size"]: r["n"] for r in cut.where(F.col("size") > least).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = cut.where(F.col("size") <= least)
    bounds = group_sizes(histogram, capacity, groups)
    large = cut_lineage(_place_large(cut.where(F.col("size") > least), bounds, configurations(bounds, capacity)))
    rooms = large.groupBy("container_id").agg((F.lit(capacity) - F.sum("size")).alias("room")).where("room > 0")
    shards = max(1, -(-(small.count() + rooms.count()) // shard_rows))
    shard = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards)).cast("int").alias("shard")
    none = F.lit(0).cast("bigint")
    both = rooms.select(shard("container_id"), F.lit(0).alias("kind"), F.col("container_id").alias("container"), F.lit(None).cast(small.schema["id"].dataType).alias("id"), none.alias("piece_no"), none.alias("start"), F.col("room").alias("size")).unionByName(
        small.select(shard("id", "piece_no"), F.lit(1).alias("kind"), none.alias("container"), "id", "piece_no", "start", "size")
    )
    work = _best_fit(capacity)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)

    fitted = both.groupBy("shard").applyInArrow(fit, large.select("id", "piece_no", "start", "size", F.col("container_id").cast("bigint")).schema)
    return large.unionByName(fitted)
