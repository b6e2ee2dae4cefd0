import math
import random

from pyspark.sql import functions as F

from nucleoframe.operators.spatial import near_or_inside

POINTS = "row_id bigint, cell_id string, x double, y double, z double"
BOXES = "body_id bigint, x_lo double, x_hi double, y_lo double, y_hi double, z_lo double, z_hi double, cell_id string"


def brute(points, boxes, r):
    good = [p for p in points if all(v is not None and math.isfinite(v) for v in p[2:])]
    out = set()
    for i, p in enumerate(good):
        for q in good[i + 1 :]:
            if p[1] != q[1] and sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])) <= r * r:
                out.add(("spot", min(p[0], q[0]), max(p[0], q[0])))
        for b in boxes:
            if None not in b[1:7] and all(b[1 + 2 * k] <= p[2 + k] <= b[2 + 2 * k] for k in range(3)):
                out.add(("body", p[0], b[0]))
    return out


def test_matches_brute_force_over_many_leaves(spark):
    rnd = random.Random(1)
    points = [(i, f"c{i % 7}", round(rnd.uniform(0, 6), 2), round(rnd.uniform(0, 6), 2), round(rnd.uniform(0, 1), 2)) for i in range(900)]
    points += [(1000 + k, f"d{k}", 3.0, 3.0, 0.5) for k in range(20)]  # one place
    points += [(2000, "n", None, 1.0, 1.0), (2001, "n", float("nan"), 1.0, 1.0)]
    boxes = [(k, *(v for _ in range(3) for v in sorted((rnd.uniform(0, 6), rnd.uniform(0, 6)))), "c") for k in range(12)] + [(99, None, 1.0, 0.0, 1.0, 0.0, 1.0, "c")]
    found = near_or_inside(spark.createDataFrame(points, POINTS), 0.25, spark.createDataFrame(boxes, BOXES), differ=F.xxhash64("cell_id"), leaf_points=30)
    rows = [tuple(r)[:3] for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(points, boxes, 0.25)


def test_empty_tables(spark):
    assert near_or_inside(spark.createDataFrame([], POINTS), 1.0, spark.createDataFrame([], BOXES)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "a", 1.0), (2, 0.1, 0.0, 0.0, "b", 2.0)], "row_id bigint, x double, y double, z double, leaf string, near_id double")
    assert [tuple(r)[:3] for r in near_or_inside(points, 0.2).collect()] == [("spot", 1, 2)]
