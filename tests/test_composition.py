import math
import os
import random

import pytest
from pyspark.sql import functions as F

from nucleoframe.operators import nearest, tiles
from nucleoframe.plans import analyses

SPOTS = "row_id bigint, cell_id string, chrom string, trace_id string, start_bp bigint, x double, y double, z double"
TRACKS = "chrom string, lo bigint, hi bigint, track string"


def brute(spots, tracks, ks):
    held = {s[0]: [t[3] for t in tracks if t[0] == s[2] and s[4] is not None and t[1] <= s[4] < t[2]] for s in spots}
    cells, total, raw, copies = {}, {}, {}, {}
    for s in spots:
        cells.setdefault(s[1], []).append(s)
        for t in held[s[0]]:
            total[t] = total.get(t, 0) + 1
    for a in spots:
        others = sorted((sum((p - q) * (p - q) for p, q in zip(a[5:], b[5:])), b[0], b) for b in cells[a[1]] if b[0] != a[0]) if a[1] is not None else []
        for k in ks:
            seen = {}
            for _, _, b in others[:k]:
                if a[2] != b[2] or (a[3] is not None and b[3] is not None and a[3] != b[3]):
                    for t in held[b[0]]:
                        seen.setdefault(t, []).append(b[2:4])
            for s in held[a[0]]:
                for t, near in seen.items():
                    raw[s, t, k] = raw.get((s, t, k), 0) + len(near)
            for s in set(held[a[0]]):
                for t, near in seen.items():
                    copies[s, t, k] = copies.get((s, t, k), 0) + len(set(near))
    return {key: (total[key[0]], n / total[key[0]], copies[key] / total[key[0]]) for key, n in raw.items()}


@pytest.mark.parametrize("cell_rows, tile_rows", [(50_000, 25_000), (40, 60)])
def test_composition_whole_and_in_tiles(spark, monkeypatch, cell_rows, tile_rows):
    """Large cells in tiles, a heap on one place, far spots, ties, lines without trace or cell, tracks that overlap."""
    monkeypatch.setattr(tiles, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(tiles, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(tiles, "BUCKET_ROWS", 50)
    monkeypatch.setattr(tiles, "BOX_POINTS", 12)
    monkeypatch.setattr("nucleoframe.functions.neighbours.BOX_POINTS", 12)
    rnd = random.Random(5)
    spots = []
    for i in range(900):
        cell = "wide" if i % 2 else "dense" if i % 3 else f"c{i % 7}"
        place = [round(rnd.uniform(0, 30), 1) for _ in range(3)] if cell == "wide" else [round(rnd.gauss(50, 1), 1) for _ in range(3)]
        place = [9.0, 9.0, 9.0] if i % 13 == 0 else [5_000.0 + i, 1.0, 1.0] if i % 149 == 0 else place
        spots.append((i * 7919 % 900, cell if i % 97 else None, f"chr{i % 3}", str(i % 5) if i % 11 else None, 1000 * rnd.randrange(30) if i % 17 else None, *place))
    tracks = [("chr0", 0, 12_000, "a"), ("chr0", 8_000, 20_000, "a"), ("chr1", 0, 30_000, "b"), ("chr0", 0, 30_000, "b"), ("chr2", 5_000, 9_000, "c"), ("chr9", 0, 10, "none")]
    got = {(r["track"], r["near_track"], r["k"]): (r["n_spots"], r["raw"], r["copies"]) for r in nearest.composition(spark.createDataFrame(spots, SPOTS), spark.createDataFrame(tracks, TRACKS), [3, 10, 40]).collect()}
    want = brute(spots, tracks, [3, 10, 40])
    assert set(got) == set(want)
    for key, (n, raw, copies) in want.items():
        assert got[key][0] == n and math.isclose(got[key][1], raw, rel_tol=1e-12) and math.isclose(got[key][2], copies, rel_tol=1e-12)


def test_composition_of_nothing(spark):
    none, tracks = spark.createDataFrame([], SPOTS), spark.createDataFrame([("chr1", 0, 10, "a")], TRACKS)
    one = spark.createDataFrame([(1, "c", "chr1", "1", 5, 1.0, 1.0, 1.0)], SPOTS)
    assert nearest.composition(none, tracks, [5]).count() == 0 and nearest.composition(one, tracks, [5]).count() == 0
    assert nearest.composition(one, tracks.where("false"), [5]).count() == 0


def on_disk(spark):
    shuffled = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:") if spark.sparkContext.getCheckpointDir() else None
    return sum(shuffled.apply(i).length() for i in range(shuffled.size())) + sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(kept or "") for f in files)


@pytest.mark.parametrize("query", ["k15_composition", "k15_sweep"])
def test_disk_stays_in_proportion(spark, tmp_path, query):
    rnd = random.Random(6)
    spots = [(i, f"c{i % 20}", "chr1", str(i % 9), str(i), *[rnd.uniform(1, 3) for _ in range(3)], 1000 * (i % 3000), 1000 * (i % 3000 + 1), 1.0) for i in range(20_000)]
    spark.createDataFrame(spots, "row_id bigint, cell_id string, chrom string, trace_id string, spot_id string, x double, y double, z double, start_bp bigint, end_bp bigint, lum double").coalesce(1).write.parquet(f"{tmp_path}/spots.parquet")
    spark.createDataFrame([("chr1", 8_000_000)], "chrom string, length_bp bigint").write.parquet(f"{tmp_path}/genome.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "spots.parquet").glob("*.parquet"))
    before = on_disk(spark)
    assert len(analyses.QUERIES[query](spark, str(tmp_path)).collect()) > 0
    assert on_disk(spark) - before < 4 * size


def test_composition_with_boxes_split_again(spark, monkeypatch):
    monkeypatch.setattr(tiles, "COSTLY_ROWS", 30)
    monkeypatch.setattr(tiles, "COSTLY_TIMES", 1)
    monkeypatch.setattr("nucleoframe.functions.neighbours.GROUP", 4)
    test_composition_whole_and_in_tiles(spark, monkeypatch, 40, 60)


def test_strays_do_not_multiply_tiles(spark, monkeypatch):
    """A heap and one far spot in a hundred: a tile doesn't get most of the cell."""
    monkeypatch.setattr(tiles, "TILE_ROWS", 20_000)
    stray = F.col("id") % 100 == 0
    spots = spark.range(200_000, numPartitions=4).select(F.lit("c").alias("cell_id"), *[F.when(stray, 1 + 1_200 * F.rand(i)).otherwise(50 + 5 * F.randn(i)).alias(c) for i, c in enumerate("xyz")])
    units = tiles.parted(spots, 100).groupBy("unit").agg(F.count("*").alias("n"), F.count_if("home").alias("own")).collect()
    assert sum(u["own"] for u in units) == 200_000 and len(units) > 6
    assert sum(u["n"] for u in units) < 7 * 200_000
