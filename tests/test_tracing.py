import math
import random

import pytest

from nucleoframe.operators.tracing import median_spot, odd_sisters, overlap_score, sister_outliers, traced
import numpy as np

SPOTS = "row_id bigint, cell_id string, chrom string, trace_id string, start_bp bigint, x double, y double, z double, extra int"


def clusters(points, eps, least):
    """Density clusters by plain search, in the order of their first core point."""
    near = [[j for j, q in enumerate(points) if math.dist(p, q) <= eps] for p in points]
    label, n = [-1] * len(points), 0
    for i in range(len(points)):
        if label[i] == -1 and len(near[i]) >= least:
            todo, label[i] = [i], n
            while todo:
                for j in near[todo.pop()]:
                    if label[j] == -1:
                        label[j] = n
                        if len(near[j]) >= least:
                            todo.append(j)
            n += 1
    return label


def plain(rows, eps, least, window, delta, length, most, distance):
    """Labels of the spots of one chromosome of one cell, step by step."""
    traces = {}
    noise = []
    for w in sorted({r[4] // window for r in rows}):
        mine = [r for r in rows if r[4] // window == w]
        groups = {}
        for r, c in zip(mine, clusters([r[5:8] for r in mine], eps, least)):
            (noise if c < 0 else groups.setdefault(c, [])).append(r)
        centre = lambda rs: [sum(r[k] for r in rs) / len(rs) for k in (5, 6, 7)]
        gaps = {(c, t): math.dist(centre(g), centre(rs)) for c, g in groups.items() for t, rs in traces.items()}
        taken = {}
        while gaps and min(gaps.values()) <= delta:
            c, t = min(gaps, key=lambda k: (gaps[k], sorted(groups).index(k[0]), list(traces).index(k[1])))
            taken[c] = t
            gaps = {k: v for k, v in gaps.items() if k[0] != c and k[1] != t}
        for c, t in taken.items():
            traces[t] = traces[t] + groups[c]
        for c in sorted(groups):
            if c not in taken:
                traces[c if c not in traces else max(traces) + 1] = groups[c]
    while True:
        pair = next(((a, b) for a in traces for b in traces if b > a and min(math.dist(p[5:8], q[5:8]) for p in traces[a] for q in traces[b]) <= distance
                     and max(sum(any(abs(p[4] - q[4]) < length for q in other) for p in one) / len(one) for one, other in ((traces[a], traces[b]), (traces[b], traces[a]))) < most), None)
        if not pair:
            break
        traces[pair[0]] = traces[pair[0]] + traces.pop(pair[1])
    out = {r[0]: "-1" for r in noise}
    for k, t in enumerate(sorted(traces, key=lambda t: -len(traces[t])), 1):
        out |= {r[0]: str(k) for r in traces[t]}
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_traces_step_by_step(spark, least, monkeypatch):
    monkeypatch.setattr("nucleoframe.functions.runs.ROWS", 40)
    rnd = random.Random(least)
    rows = []
    for c in range(6):
        homes = [[rnd.uniform(0, 6) for _ in range(3)] for _ in range(3)]
        for i in range(70):
            home = homes[rnd.randrange(3)]
            rows.append((1000 * c + i, f"c{c // 2}", f"chr{c % 2}", "old", 100 * rnd.randrange(40), *[h + rnd.gauss(0, 0.5) for h in home], 1))
    rows += [(9000 + i, "small", "chr1", "kept", 0, 1.0, 1.0, 1.0, 1) for i in range(5)] + [(9100, "unsegmented", "chr1", "kept", 0, 1.0, 1.0, 1.0, 1), (9101, "c0", None, "kept", 0, 1.0, 1.0, 1.0, 1), (9102, "c0", "chr0", "kept", 0, None, 1.0, 1.0, 1)]
    got = {r["row_id"]: r["trace_id"] for r in traced(spark.createDataFrame(rows, SPOTS), 0.6, least, 1000, 1.5, 200, 0.3, 0.5, 20).collect()}
    want = {r[0]: "kept" for r in rows if r[0] >= 9000}
    for c in range(6):
        want |= plain([r for r in rows if 1000 * c <= r[0] < 1000 * c + 70 and r[0] < 9000], 0.6, least, 1000, 1.5, 200, 0.3, 0.5)
    assert got == want and len(set(got.values())) > 3
    assert traced(spark.createDataFrame([], SPOTS)).count() == 0


def test_overlap_and_medians():
    a, b, one = np.array([0, 10, 20]), np.array([12, 100]), np.ones(3)
    assert overlap_score(a, one, b, one[:2], 10) == max(2 / 3, 1 / 2) and overlap_score(a, one, a, one, 1) == 1.0
    p = np.array([[0.0, 0, 0], [1, 0, 0], [5, 0, 0]])
    assert median_spot(p, p[0]) == 1 and median_spot(p[:2], np.array([0.5, 0, 0])) == 0 and median_spot(p[:1], p[2]) == 0
    assert median_spot(np.array([[0.0, 0, 0], [2, 0, 0], [1, 1.8, 0]]) * 1.0, np.array([2.0, 0, 0])) in (0, 1, 2)


def test_the_four_cases_of_sisters():
    near, off = np.array([[0.0, 0, 0], [0.1, 0, 0]]), np.array([[0.0, 0, 0], [3.0, 0, 0]])
    assert odd_sisters(near, None, 1.0) == [] and odd_sisters(off, None, 1.0) == [0, 1]
    assert odd_sisters(off, np.array([1.5, 0, 0]), 2.0) == [0, 1] and odd_sisters(off, np.array([9.0, 0, 0]), 1.0) == [0, 1]
    assert odd_sisters(off, np.array([0.2, 0, 0]), 1.0) == [1]
    assert odd_sisters(np.array([[0.0, 0, 0], [0.2, 0, 0], [4.0, 0, 0]]), None, 1.0) == [2]


def test_outliers_of_the_whole_table(spark):
    rnd = random.Random(3)
    rows = [(i, "a", "chr1", f"t{i % 2}", 100 * rnd.randrange(12), *[rnd.gauss(0, 0.6) for _ in range(3)], 1) for i in range(120)] + [(500, "a", "chr1", "t0", None, 1.0, 1.0, 1.0, 1)]
    got = {r["row_id"] for r in sister_outliers(spark.createDataFrame(rows, SPOTS), 1.2, 150).collect()}
    want = set()
    for t in ("t0", "t1"):
        mine = [r for r in rows if r[3] == t and r[4] is not None]
        centre = np.mean([r[5:8] for r in mine], axis=0)
        for start in {r[4] for r in mine}:
            own, around = [r for r in mine if r[4] == start], np.array([r[5:8] for r in mine if r[4] != start and abs(r[4] - start) <= 150])
            middle = around[median_spot(around, centre)] if len(around) else None
            if len(own) > 1:
                want |= {own[k][0] for k in odd_sisters(np.array([r[5:8] for r in own]), middle, 1.2)}
    assert got == want and want
    assert sister_outliers(spark.createDataFrame([], SPOTS), 1.0, 10).count() == 0
