import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nucleoframe.llm.density import density_clusters, linked_groups
from nucleoframe.llm.forest import boruvka, distributed_boruvka
from nucleoframe.llm.splits import components

SCHEMA = "row_id bigint, k bigint, x double, y double, z double"


def world(seed=5, n=500):
    rnd = random.Random(seed)
    out = []
    for c in range(12):
        at = [rnd.uniform(0, 8) for _ in range(3)]
        out += [(c % 2, *(rnd.gauss(v, 0.25) for v in at)) for _ in range(30)]
    out += [(rnd.randrange(2), *(rnd.uniform(0, 8) for _ in range(3))) for _ in range(n - len(out) - 12)]
    out += [(1, 4.0, 4.0, 4.0)] * 12
    rnd.shuffle(out)
    return [(i, *r) for i, r in enumerate(out)]


def kruskal(edges, nodes):
    parent = {v: v for v in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    chosen = set()
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        if find(a) != find(b):
            parent[find(b)] = find(a)
            chosen.add((a, b))
    return chosen, {v: find(v) for v in nodes}


def test_forests_agree(spark):
    rnd = random.Random(4)
    edges = list({(a, b): (a, b, float(rnd.randrange(5))) for a, b in ((rnd.randrange(80), rnd.randrange(80)) for _ in range(140)) if a != b}.values())
    nodes = {v for e in edges for v in e[:2]}
    want, root = kruskal(edges, nodes)
    labels, taken = distributed_boruvka(spark.createDataFrame(edges, "a bigint, b bigint, w double"))
    assert {(r["a"], r["b"]) for r in taken.collect()} == want
    got = {r["node"]: r["root"] for r in labels.collect()}
    assert all((got[a] == got[b]) == (root[a] == root[b]) for a in nodes for b in nodes)
    order = sorted(edges, key=lambda e: (e[2], min(e[:2]), max(e[:2])))
    u, v = np.array([e[0] for e in order]), np.array([e[1] for e in order])
    _, e = boruvka(np.arange(80), u, v, np.zeros(80, bool))
    assert {(min(u[k], v[k]), max(u[k], v[k])) for k in e} == want


def groups(points, eps, least):
    edges = [(p[0], q[0], 1.0) for i, p in enumerate(points) for q in points[i + 1 :] if p[1] == q[1] and math.dist(p[2:], q[2:]) <= eps]
    root = kruskal(edges, [p[0] for p in points])[1]
    by = {}
    for v, r in root.items():
        by.setdefault(r, []).append(v)
    return {(min(m), v) for m in by.values() if len(m) >= least for v in m}


@pytest.mark.parametrize("leaf", [30, 20_000])
def test_groups_do_not_depend_on_leaves(spark, leaf):
    points = world()
    extra = [(9_000, 0, None, 1.0, 1.0), (9_001, 0, float("nan"), 1.0, 1.0)]
    got = linked_groups(spark.createDataFrame(points + extra, SCHEMA), "row_id", F.col("k"), 0.4, 5, leaf_points=leaf)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == groups(points, 0.4, 5)


def test_clusters_do_not_depend_on_leaves(spark):
    df = spark.createDataFrame(world(), SCHEMA)
    runs = [{tuple(r) for r in density_clusters(df, "row_id", F.col("k"), 0.5, 4, 6, leaf_points=leaf).collect()} for leaf in (60, 20_000)]
    assert runs[0] == runs[1] and runs[0]
    sizes = {}
    for c, _, size, _, _ in runs[0]:
        sizes.setdefault(c, []).append(size)
    assert all(len(s) == s[0] >= 6 for s in sizes.values())
    assert all(sum(1 for r in runs[0] if r[0] == c and r[4]) == 3 for c in sizes)


def hdbscan(points, eps, min_points, least):
    """Clusters by trying all pairs and going down the hierarchy: {row: (cluster, size, persistence)}."""
    near = {p[0]: sorted(math.dist(p[2:], q[2:]) for q in points if q[1] == p[1]) for p in points}
    core = {i: d[min_points - 1] if len(d) >= min_points else math.inf for i, d in near.items()}
    edges = []
    for i, p in enumerate(points):
        for q in points[i + 1 :]:
            w = max(math.dist(p[2:], q[2:]), core[p[0]], core[q[0]])
            if p[1] == q[1] and w <= eps:
                edges.append((max(w, 1e-4), min(p[0], q[0]), max(p[0], q[0])))

    def parts(rows, links):
        root = kruskal([(a, b, w) for w, a, b in links if a in rows and b in rows], rows)[1]
        by = {}
        for v in rows:
            by.setdefault(root[v], set()).add(v)
        return list(by.values())

    tree, _ = kruskal([(a, b, w) for w, a, b in edges], [p[0] for p in points])
    tree = sorted(e for e in edges if e[1:] in tree)

    def solve(rows, birth):
        """(best stability, [(members)]) of a cluster of rows that begins at rate birth; falls are noted."""
        all_rows, own, links = set(rows), 0.0, [e for e in tree if e[1] in rows and e[2] in rows]
        while links:
            w = links.pop()[0]
            sides = parts(rows, links)
            big = [s for s in sides if len(s) >= least]
            if len(big) == 2:
                own += (1 / w - birth) * len(rows)
                below = [solve(s, 1 / w) for s in big]
                best = sum(b for b, _ in below)
                return (best, [c for _, cs in below for c in cs]) if best > own * (1 + 1e-12) else (own, [all_rows])
            for s in sides:
                if len(s) < least:
                    own += (1 / w - birth) * len(s)
                    for v in s:
                        fall[v] = 1 / w
            if not big:
                break
            rows = big[0]
            links = [e for e in links if e[1] in rows and e[2] in rows]
        return own, [all_rows]

    fall, out = {}, {}
    for rows in parts({p[0] for p in points}, tree):
        if len(rows) >= least:
            for c in solve(rows, 1 / eps)[1]:
                out |= {v: (min(c), len(c), fall[v]) for v in c}
    return out


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("slices", [20, 500_000])
def test_clusters_of_components_of_any_size_by_trying_all(spark, seed, slices):
    points = world(seed, 300)
    got = density_clusters(spark.createDataFrame(points, SCHEMA), "row_id", F.col("k"), 0.6, 3, 6, leaf_points=90, slice_edges=slices).collect()
    want = hdbscan(points, 0.6, 3, 6)
    assert {r["row_id"]: (r["cluster_id"], r["cluster_size"]) for r in got} == {v: c[:2] for v, c in want.items()}
    assert all(math.isclose(r["persistence"], want[r["row_id"]][2], rel_tol=1e-9) for r in got)
    for c in {r["cluster_id"] for r in got}:
        mine = sorted(((-r["persistence"], r["row_id"]) for r in got if r["cluster_id"] == c))
        assert {r["row_id"] for r in got if r["cluster_id"] == c and r["exemplar"]} == {i for _, i in mine[:3]}


@pytest.mark.parametrize("slices", [7, 500_000])
def test_two_chains_near_one_another(spark, slices):
    points = [(i, 0, 0.27 * i, 0.0, 0.0) for i in range(60)] + [(100 + i, 0, 0.27 * i, 0.4, 0.0) for i in range(60)]
    df = spark.createDataFrame([(p[0], p[1], *(float(v) for v in p[2:])) for p in points], SCHEMA)
    rows = density_clusters(df, "row_id", F.col("k"), 0.5, 2, 8, slice_edges=slices).collect()
    assert sorted({(r["cluster_id"], r["cluster_size"]) for r in rows}) == [(0, 60), (100, 60)]
    whole = linked_groups(df, "row_id", F.col("k"), 0.5, 8, slice_edges=slices).collect()
    assert {(r["cluster_id"]) for r in whole} == {0} and len(whole) == 120


def test_unfinished_rounds_raise(spark):
    chain = spark.createDataFrame([(i, i + 1, float(i % 7)) for i in range(64)], "a bigint, b bigint, w double")
    with pytest.raises(RuntimeError):
        distributed_boruvka(chain, max_rounds=1)
    with pytest.raises(RuntimeError):
        components(chain.select("a", "b"), max_rounds=2)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert linked_groups(none, "row_id", F.col("k"), 0.4, 5).count() == 0
    assert density_clusters(none, "row_id", F.col("k"), 0.4).count() == 0
