"""Minimum spanning forests: Borůvka's algorithm in numpy for one partition, and over tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoframe.session import discard, settled


def jump(parent: np.ndarray) -> np.ndarray:
    """Roots of a parent forest, by pointer jumping."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def boruvka(label: np.ndarray, u: np.ndarray, v: np.ndarray, frozen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contract a graph whose edges are given in their total order, lightest first.

    ``label`` names each vertex's component by one of its vertices; components with a frozen
    vertex don't choose an edge of their own, but others may join them. Returns the labels and the
    edges chosen.
    """
    label, stuck = label.copy(), np.zeros(len(label), bool)
    np.logical_or.at(stuck, label, frozen)
    chosen = []
    edge = np.arange(len(u))
    while len(edge):
        a, b = label[u[edge]], label[v[edge]]
        open_ = a != b
        edge, a, b = edge[open_], a[open_], b[open_]
        best = np.full(len(label), -1)
        back = edge[::-1]
        for side in (a, b):
            mine = np.full(len(label), -1)
            mine[side[::-1]] = back  # the lightest is written last
            best = np.where(best < 0, mine, np.where(mine < 0, best, np.minimum(best, mine)))
        best[stuck] = -1
        who = np.nonzero(best >= 0)[0]
        if not len(who):
            break
        e = best[who]
        other = np.where(label[u[e]] == who, label[v[e]], label[u[e]])
        parent = np.arange(len(label))
        parent[who] = other
        both = (parent[parent] == np.arange(len(label))) & (np.arange(len(label)) < parent)
        parent[both] = np.nonzero(both)[0]
        chosen.append(np.unique(e))
        root = jump(parent)
        label = root[label]
        np.logical_or.at(stuck, root, stuck.copy())
    return label, np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def distributed_boruvka(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest of a table of edges (a, b, w): (node, root) and the chosen edges.

    The order of edges is (w, smaller end, larger end), so that there is one forest. In each round
    every component takes its lightest edge out, the components joined are named by one of them,
    and edges inside a component are dropped. All of it is joins and grouped minima. A round at least
    halves the components that have edges out; if ``max_rounds`` don't do, it raises RuntimeError.
    """
    live = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    labels = settled(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    forest = edges.sparkSession.createDataFrame([], live.select("a", "b", "w").schema)
    for _ in range(max_rounds):
        out = live.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("other"), "w", "a", "b"), F.struct(F.col("cb").alias("c"), F.col("ca").alias("other"), "w", "a", "b"))).alias("e")).select("e.*")
        pick = out.groupBy("c").agg(F.min(F.struct("w", "a", "b", "other")).alias("m")).select("c", F.col("m.other").alias("p"), "m.a", "m.b", "m.w")
        pick = settled(pick)
        if pick.isEmpty():
            discard(live, pick)
            return labels, forest
        forest = forest.unionByName(pick.select("a", "b", "w").distinct())
        # Two that chose each other: the smaller becomes the root.
        back = pick.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = settled(pick.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"), F.lit(True).alias("moved")))
        while True:
            step = up.select("c", "p").join(up.select(F.col("c").alias("p"), F.col("p").alias("q")), "p", "left")
            after = settled(step.select("c", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")))
            discard(up)
            up = after
            if up.where("moved").isEmpty():
                break
        left, right = up.select(F.col("c").alias("ca"), F.col("p").alias("na")), up.select(F.col("c").alias("cb"), F.col("p").alias("nb"))
        next_live = settled(live.join(left, "ca", "left").join(right, "cb", "left").select("a", "b", "w", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb")).where("ca <> cb"))
        next_labels = settled(labels.join(up.select(F.col("c").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        discard(live, labels, up)
        live, labels = next_live, next_labels
    raise RuntimeError(f"components still have edges after {max_rounds} rounds")
