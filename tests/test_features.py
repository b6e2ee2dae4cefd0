import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from nucleoframe.operators import containers, cycle, features, matrices, pairwise, replication, traces
from nucleoframe.sources import markers
from nucleoframe.sources.fofct_spots import fofct_spots, repeated_spots

SPOTS = "row_id bigint, cell_id string, chrom string, trace_id string, spot_id string, start_bp bigint, end_bp bigint, x double, y double, z double, lum double, value int"
LOCI = [(0, "chr1", 0, 100), (1, "chr1", 100, 200), (2, "chr1", 200, 300), (3, "chr2", 0, 100)]


def world(n=260, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        start = 100 * rnd.randrange(12)
        cell = "hot" if i % 3 == 0 else f"c{i % 4}"
        rows.append((i, cell, f"chr{i % 2 + 1}", "-1" if i % 11 == 0 else f"t{i % 3}", str(i), start, start + 100, *[round(rnd.uniform(1, 3), 2) for _ in range(3)], None if i % 5 == 0 else float(i % 17), 9))
    return rows + [(9000 + r[0], *r[1:]) for r in rows[:12]]


def far(a, b):
    return math.dist(a[7:10], b[7:10])


def loci(spark):
    return spark.createDataFrame(LOCI, "locus int, chrom string, start_bp bigint, end_bp bigint")


def test_counts_and_light_have_zeros_where_a_copy_has_no_spot(spark):
    rows = [(1, "a", "chr1", "t1", "1", 0, 100, 1.0, 1.0, 1.0, 5.0, 0), (2, "a", "chr1", "t1", "2", 0, 100, 1.0, 1.0, 3.0, None, 0), (3, "a", "chr1", "t2", "3", 100, 200, 1.0, 1.0, 1.0, None, 0), (4, "a", "chr2", "t0", "4", 700, 800, 1.0, 1.0, 1.0, 1.0, 0)]
    s = spark.createDataFrame(rows, SPOTS)
    assert {(r["locus"], r["copy"]): r["value"] for r in features.spot_count(s, loci(spark)).collect()} == {(0, 0): 2, (1, 0): 0, (2, 0): 0, (0, 1): 0, (1, 1): 1, (2, 1): 0, (3, 0): 0}
    light = {(r["locus"], r["copy"]): r["value"] for r in features.intensity(s, loci(spark)).collect()}
    assert light[0, 0] == 5.0 and light[1, 1] is None and light[2, 1] == 0.0
    assert {r["value"] for r in features.intensity(s, loci(spark), "sum").collect()} == {5.0, 0.0}
    assert [r["row_id"] for r in features.unplaced(s, loci(spark)).collect()] == [4]
    assert features.height(s, loci(spark)).where("locus = 0 AND copy = 0").first()["value"] == 2.0


@pytest.mark.parametrize("leaf", [40, 20_000])
def test_neighbours_by_trying_all(spark, leaf, monkeypatch):
    monkeypatch.setattr("nucleoframe.operators.spatial.LEAF_POINTS", leaf)
    rows = world()
    got = {r["row_id"]: r for r in features.sphere(spark.createDataFrame(rows, SPOTS), 0.5, 300).collect()}
    assert set(got) == {r[0] for r in rows}
    for a in rows:
        near = [b for b in rows if b[1] == a[1] and b[0] != a[0] and far(a, b) < 0.5]
        r, apart = got[a[0]], [far(a, b) for b in near if far(a, b) > 0]
        assert r["n_contacts"] == len(near) and math.isclose(r["density"], len(apart) / (4 / 3 * math.pi * 0.125))
        if near:
            assert math.isclose(r["inter"], sum(b[2] != a[2] for b in near) / len(near)) and math.isclose(r["trans"], sum((b[2], b[3]) != (a[2], a[3]) for b in near) / len(near))
            assert math.isclose(r["long_intra"], sum(b[2] == a[2] and abs(b[5] - a[5]) >= 300 for b in near) / len(near))
        assert (r["mean_dist"] is None) == (not apart) and (not apart or math.isclose(r["mean_dist"], statistics.mean(apart)))


@pytest.mark.parametrize("some", [False, True])
def test_kernel_density_counts_every_source(spark, some):
    rows = world(90) + [(7000, "alone", "chr1", "t1", "x", 0, 100, 1.0, 1.0, 1.0, 1.0, 0)]
    got = {r["row_id"]: r["value"] for r in features.kernel_density(spark.createDataFrame(rows, SPOTS), 0.1, F.col("lum") > 8 if some else None).collect()}
    for a in rows:
        d = [far(a, b) for b in rows if b[1] == a[1] and far(a, b) > 0 and (not some or (b[10] or 0) > 8)]
        want = sum(math.exp(-v * v / 0.02) for v in d) / len(d) / ((2 * math.pi) ** 1.5 * 1e-3) if d else None
        assert got[a[0]] == want or math.isclose(got[a[0]], want, rel_tol=1e-9, abs_tol=1e-12)


def test_window_pairs_by_trying_all(spark):
    rows = world()
    got = {r["row_id"]: r["value"] for r in features.window_pairs(spark.createDataFrame(rows, SPOTS), 400).collect()}
    for a in rows:
        inside = [b for b in rows if b[1:4] == a[1:4] and abs(b[5] - a[5]) <= 200]
        d = [far(b, c) for i, b in enumerate(inside) for c in inside[i + 1 :]]
        assert (got[a[0]] is None) == (not d) and (not d or math.isclose(got[a[0]], statistics.mean(d)))


def test_percentiles_of_large_groups(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", None if i % 13 == 0 else float(rnd.randrange(50))) for i in range(900)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    runs = [{r["g"]: r["edges"] for r in matrices.percentiles(df, ["g"], "v", [0.0, 0.05, 0.5, 0.9, 1.0], hot).collect()} for hot in (50, 100_000)]
    assert runs[0].keys() == runs[1].keys() and "none" not in runs[0]
    for g in runs[0]:
        want = np.percentile([v for k, v in rows if k == g and v is not None], [0, 5, 50, 90, 100])
        assert np.allclose(runs[0][g], want) and np.allclose(runs[1][g], want)
    low = matrices.sliced(spark.createDataFrame([("a", float(v)) for v in range(5)], "g string, v double"), ["g"], "v", 2).collect()
    assert [r["slice"] for r in sorted(low, key=lambda r: r["v"])] == [0, 0, 0, 1, 1]


def test_tails_of_distributions(spark):
    x = np.linspace(-6, 12, 400)
    assert np.allclose(pairwise.erfc(x), [math.erfc(v) for v in x], rtol=1e-12, atol=0)
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 3.0), (-12.706204736, 1.0), (5.0, 400.0), (None, 2.0), (1.0, None)], "t double, dof double")
    got = [r["p"] for r in df.select(replication.t_tails(F.col("t"), F.col("dof")).alias("p")).collect()]
    assert np.allclose(got[:4], [0.07338803, 1.0, 0.05, 8.594825e-07], rtol=1e-4) and got[4:] == [None, None]


def test_differences_have_signs(spark):
    rnd = random.Random(5)
    rows = [(f"c{i}", "G1" if i % 2 else "S", "chr1", blk, rnd.gauss(3 if blk == 0 and i % 2 else 0, 1)) for blk in range(6) for i in range(40)]
    got = {r["locus"]: r for r in replication.differential(spark.createDataFrame(rows, "cell_id string, state string, chrom string, locus int, value double"), "state", "G1", "S", ["chrom", "locus"]).collect()}
    assert got[0]["sign"] == 1 and all(r["sign"] == 0 for k, r in got.items() if k) and all(r["q"] >= r["p"] for r in got.values())


def test_resampling_is_even_and_repeatable(spark):
    wanted, pool = (spark.createDataFrame([(f"{p}{i}",) for i in range(n)], "cell_id string") for p, n in (("s", 23), ("g", 5)))
    runs = [sorted(tuple(r) for r in cycle.resampled(wanted, pool, 3, 7).select("repeat", "cell_id", "picked").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 69
    for k in range(3):
        n = [sum(1 for r, _, p in runs[0] if r == k and p == f"g{i}") for i in range(5)]
        assert sorted(n) == [4, 4, 5, 5, 5]
    assert cycle.resampled(wanted, pool.limit(0), 2, 1).count() == 0


def test_bootstrap_finds_the_probability(spark):
    rnd = random.Random(11)
    cells, counts = [], []
    for c in range(60):
        state = ("G1", "S", "G2")[c % 3]
        p = {"G1": 0.0, "S": 0.5, "G2": 1.0}[state]
        cells.append((f"c{c}", state, 500.0, 0.6))
        for locus in range(60):
            copies = 1 + (rnd.random() < p)
            counts.append((f"c{c}", state, "chr1", locus, 0, float(sum(rnd.random() < 0.6 for _ in range(copies)))))
    out = cycle.bootstrap(spark.createDataFrame(counts, "cell_id string, state string, chrom string, locus int, copy int, value double"), spark.createDataFrame(cells, "cell_id string, state string, volume double, eps double"), F.lit(True), 4).collect()
    assert len(out) == 4 and all(abs(r["p"] - 0.5) < 0.15 and abs(r["eps"] - 0.6) < 0.05 for r in out)


def test_containers(spark):
    s = spark.createDataFrame(world(), SPOTS)
    with pytest.raises(ValueError):
        containers.merge(s, s, "x", "x", loci(spark), loci(spark))
    with pytest.raises(ValueError):
        containers.merge(s, s, "x", "y", loci(spark), loci(spark).where("locus > 0"))
    assert containers.merge(s, s, "x", "y", loci(spark), loci(spark)).count() == 2 * s.count()
    assert containers.lost_loci(loci(spark), loci(spark).where("locus <> 2")).count() == 1
    bins = {r["locus"]: r["bin"] for r in containers.target_bins(loci(spark), spark.createDataFrame([("chr1", 50), ("chr2", 0)], "chrom string, origin_bp bigint"), 100).collect()}
    assert bins == {0: None, 1: None, 2: None, 3: 0}
    assert [r["chrom"] for r in containers.chromosomes(spark.createDataFrame([("chr1",), ("chrX",), ("chrY",)], "chrom string"), ["#", "chrY"]).orderBy("chrom").collect()] == ["chr1", "chrY"]
    empty = s.limit(0)
    for out in (containers.index_of(empty), containers.triads(empty), traces.completed(empty, loci(spark)), features.spot_count(empty, loci(spark)), features.sphere(empty, 0.5, 1), features.kernel_density(empty, 0.1), features.window_pairs(empty, 400), markers.cmm_lines(empty, by=["cell_id"])):
        assert out.count() == 0


def test_spots_of_files_have_defaults(spark):
    head = "##columns=(Trace_ID,X,Y,Z,Chrom,Chrom_Start,Chrom_End"
    raw = {1: [head + ")", "7,1,2,3,chr1,0,100", "8,1,2,3,chr1,0,100", "7,1,2,zz,chr1,100,"], 2: [head + ",Spot_ID,Cell_ID,Lum,Gene_ID)", "7,1,2,3,chr1,0,100,a,c1,2.5,g", "7,1,2,3,chr1,0,100,,c1,inf,", "7,1,2,3,chr1,0,100,a,c1,x,"]}
    lines = spark.createDataFrame([(f * 100 + k, f, k, r) for f, rs in raw.items() for k, r in enumerate(rs, 1)], "line_id bigint, file_id bigint, line_no int, raw_line string")
    got = {r["line_id"]: r for r in fofct_spots(lines, (2.0, 1.0, 1.0)).collect()}
    assert {k: (r["cell_id"], r["spot_id"]) for k, r in got.items()} == {102: ("7", "1"), 103: ("8", "1"), 104: ("7", "2"), 202: ("c1", "a"), 203: ("c1", "2"), 204: ("c1", "a")}
    assert got[102]["x"] == 2.0 and got[104]["z"] is None and got[104]["end_bp"] is None and got[202]["gene_id"] == "g" and (got[202]["lum"], got[203]["lum"], got[204]["lum"]) == (2.5, None, None)
    assert [tuple(r)[:5] for r in repeated_spots(fofct_spots(lines)).collect()] == [("c1", "chr1", "7", "a", 2)]
