import math
import random

import pytest
from pyspark.sql import functions as F

from nucleoframe.operators import cycle, features, matrices, nearest, pairwise, replication
from nucleoframe.plans import analyses
from nucleoframe.session import ranked
from nucleoframe.sources import markers
from nucleoframe.streaming import ingest

SPOTS = "row_id bigint, cell_id string, chrom string, trace_id string, start_bp bigint, end_bp bigint, x double, y double, z double, lum double, track string"
CUBE = "cell_id string, state string, chrom string, locus int, copy_no int, value double"


def world(n=240, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        cell = "hot" if i % 3 == 0 else f"c{i % 5}"
        wide = 60 if cell == "hot" and i % 2 else 2
        p = [round(rnd.uniform(1, 1 + wide), 1) for _ in range(3)]
        start = 100_000 * rnd.randrange(30)
        rows.append((i, cell, f"chr{i % 2 + 1}", "-1" if i % 11 == 0 else str(i % 3), start, start + 100_000, *p, None if i % 7 == 0 else float(i), "clash"))
    rows += [(1000 + r[0], *r[1:]) for r in rows[:20]]  # delivered twice
    return rows + [(5000, "alone", "chr1", "1", 0, 100_000, 1.0, 1.0, 1.0, None, None)]


def square(a, b):
    d = [a[6 + k] - b[6 + k] for k in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


@pytest.mark.parametrize("apart", [False, True])
def test_nearest_k(spark, apart):
    rows = world()
    got = {}
    for r in nearest.nearest_k(spark.createDataFrame(rows, SPOTS), 4, 0.3, apart).collect():
        got.setdefault(r["row_id"], []).append((r["rank"], r["dist2"], r["near_id"]))
    for a in rows:
        want = sorted((square(a, b), b[0]) for b in rows if b[1] == a[1] and b[0] != a[0] and (square(a, b) > 0 or not apart))[:4]
        assert [g[1:] for g in sorted(got.get(a[0], []))] == want
    assert nearest.nearest_k(spark.createDataFrame([], SPOTS), 4).count() == 0


def test_ranked_over_partitions(spark):
    rows = [(i, None if i % 9 == 0 else float(i % 13)) for i in range(500)]
    got = {r["i"]: r["place"] for r in ranked(spark.createDataFrame(rows, "i bigint, v double"), [F.col("v").asc_nulls_last(), F.col("i").asc()]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    assert [r[0] for r in want] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 501))
    assert ranked(spark.createDataFrame([], "i bigint"), [F.col("i").asc()]).count() == 0


def test_pooled_by_volume_crosses_blocks(spark, monkeypatch):
    n = 2_300  # more than two blocks
    cells = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cell_id"), F.lit("S").alias("state"), F.col("id").cast("double").alias("volume"))
    counts = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cell_id"), (F.col("id") % 3).cast("double").alias("value"))
    got = {r["r"]: (r["nsamples"], r["n"], r["f"]) for r in cycle.pooled_by_volume(counts, cells, 6).collect()}
    assert len(got) == n
    for r in (1, 2, 1023, 1024, 1025, 2047, 2048, n):
        near = [(k - 1) % 3 for k in range(max(1, r - 3), min(n, r + 3) + 1)]
        assert got[r][0] == len(near) and math.isclose(got[r][1], sum(near) / len(near)) and math.isclose(got[r][2], near.count(0) / len(near))


def test_null_cells_are_a_group(spark):
    rows = [(None, "S", "chr1", 0, 0, 1.0), (None, "S", "chr1", 1, 0, 3.0), ("a", None, None, None, None, None), ("b", "S", "chr1", 0, 0, 2.0)]
    cube = spark.createDataFrame(rows, CUBE)
    z = {(r["cell_id"], r["locus"]): r["zscore"] for r in matrices.z_scores(cube, ["cell_id"]).collect()}
    assert z == {(None, 0): -1.0, (None, 1): 1.0, ("a", None): None, ("b", 0): None}
    norm = [r["norm"] for r in matrices.normalised_by_cell(cube).orderBy("cell_id", "locus").collect()]
    assert norm == [0.5, 1.5, None, 1.0]


def test_empty_tables(spark):
    spots, cube = spark.createDataFrame([], SPOTS), spark.createDataFrame([], CUBE)
    cells = spark.createDataFrame([], "cell_id string, state string, volume double")
    loci = spark.createDataFrame([], "locus int, chrom string, start_bp bigint, end_bp bigint")
    bodies = spark.createDataFrame([], "cell_id string, " + ", ".join(f"{c}_{s} double" for c in "xyz" for s in ("lo", "hi")))
    maps = spark.createDataFrame([], "state string, chrom string, bin1 int, bin2 int, nsamples bigint, f double, f_var double, control double")
    for out in (
        features.of_spots(spots, loci, cube), features.body_distance(spots, bodies, 1.0), pairwise.inter_contacts(spots, cells, 10, 0.5), pairwise.rescaled(maps),
        pairwise.compartments(maps, spark.createDataFrame([], "chrom string, bin int, density double")), cycle.per_cell(cube.drop("state"), cells, 0.0, 4), cycle.biased_timing(cube),
        replication.states_by_volume(cells, 0.4, 0.2), matrices.sorted_cells(cube), markers.cmm_lines(spots), markers.pdb_lines(spots),
    ):
        assert out.count() == 0


def test_threshold_sweep_and_curve(spark):
    rnd = random.Random(3)
    rows = [(rnd.random() < 0.4, round(rnd.random(), 1)) for _ in range(200)]
    judged = spark.createDataFrame([*rows, (None, 0.5), (True, None), (False, float("nan"))], "real boolean, score double")
    for r in cycle.threshold_sweep(judged, "real", "score", [0.0, 0.45, 1.0]).collect():
        t = r["threshold"]
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == tuple(sum((s > t) == up and real == yes for real, s in rows) for up, yes in ((True, True), (True, False), (False, False), (False, True)))
    assert cycle.threshold_sweep(judged, "real", "score", [1.0]).first()["ppv"] is None
    scored = judged.where("real IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").select(F.col("real").cast("double").alias("label"), F.col("score").alias("probability"))
    ups, downs = [s for r, s in rows if r], [s for r, s in rows if not r]
    want = sum((u > d) + (u == d) / 2 for u in ups for d in downs) / len(ups) / len(downs)
    assert math.isclose(cycle.area_under_curve(scored, []).first()["auc"], want)


def test_classifier_learns_and_holds_out(spark):
    rnd = random.Random(7)
    rows = []
    for c in range(40):
        state = ("G1", "G2", "S", None)[c % 4]
        rows += [(f"c{c}", state, rnd.gauss({"G1": 0, "G2": 2}.get(state, 1), 0.7), rnd.randrange(3)) for _ in range(20)]
    rows.append((None, "G1", float("nan"), 1))
    samples = spark.createDataFrame(rows, "cell_id string, state string, v double, kind int")
    scored, _ = cycle.replication_classifier(samples, ["v"], "kind", rounds=4)
    assert scored.count() == 800 and cycle.area_under_curve(scored.where("held_out"), []).first()["auc"] > 0.9
    with pytest.raises(ValueError):
        cycle.replication_classifier(samples.where("state = 'S'"), ["v"], "kind")


def test_compartments_find_blocks(spark):
    # Of ten bins the edge of the map would outweigh the blocks.
    rows = [("all", "chr1", i, j, 5, (0.9 if (i < 10) == (j < 10) else 0.1) / (j - i), 0.1) for i in range(20) for j in range(i + 1, 20)]
    maps = spark.createDataFrame(rows, "state string, chrom string, bin1 int, bin2 int, nsamples int, f double, f_var double")
    bins = spark.createDataFrame([("chr1", 20)], "chrom string, n_bins int")
    assert pairwise.control(maps, bins, 38).where("control IS NULL AND bin2 - bin1 = 1").count() == 0 and pairwise.control(maps, bins, 39).where("control IS NOT NULL").count() == 0
    maps = pairwise.control(maps, bins, 2)
    density = spark.createDataFrame([("chr1", b, 1.0 if b < 10 else 0.0) for b in range(20)], "chrom string, bin int, density double")
    got = {r["bin"]: r["compartment"] for r in pairwise.compartments(maps, density).collect()}
    assert math.isclose(sum(v * v for v in got.values()), 1.0) and all((got[b] > 0) == (b < 10) for b in range(20))
    assert pairwise.compartments(maps, density, least_share=1.1).count() == 0


def test_bed_and_exports(spark, tmp_path):
    bed = tmp_path / "a.bed"
    bed.write_text("track name=x\n#c\nchr1\t0\t100000\t2.5\nchr1\t100000\t200000\nchr2 x y oops\n\n")
    rows = [tuple(r) for r in markers.read_bed(spark, str(bed)).collect()]
    assert rows == [("chr1", 0, 100_000, 2.5), ("chr1", 100_000, 200_000, None), ("chr2", None, None, None)]
    spots = spark.createDataFrame(world(), SPOTS)
    assert markers.bed_of_spots(spots, markers.read_bed(spark, str(bed))).where("bed_value = 2.5").count() == spots.where("chrom = 'chr1' AND start_bp = 0").count()
    lines = markers.pdb_lines(spots)
    assert lines.count() == spots.count() and lines.groupBy("cell_id").agg((F.max("line_no") == F.count("*")).alias("ok")).where("NOT ok").count() == 0
    out = str(tmp_path / "cmm")
    markers.write_lines(markers.cmm_lines(spots), out, ["cell_id", "chrom", "trace_id"])
    assert spark.read.text(out).where("value LIKE '<marker%'").count() == spots.count()


def test_streams(spark, tmp_path):
    schema = "id bigint, ts timestamp, kind string, value double"
    rows = [(i % 90, f"2024-01-0{i % 3 + 1} 00:{i % 60:02d}:00", None if i % 10 == 0 else "k", float(i)) for i in range(120)]
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "id bigint, t string, kind string, value double").select("id", F.to_timestamp("t").alias("ts"), "kind", "value")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = lambda: ingest.arrivals(spark, str(tmp_path / "in"), df.schema, 1)
    ingest.run_available(ingest.windowed_counts(got(), "ts", ["kind"], "1 day"), str(tmp_path / "a"), str(tmp_path / "sa"), "complete")
    want = df.groupBy(F.date_trunc("day", "ts").alias("begins"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {tuple(r) for r in want.collect()}
    ingest.run_available(ingest.deduplicated(got(), ["id"], "ts", "30 days"), str(tmp_path / "b"), str(tmp_path / "sb"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 90


def test_loci_are_fitted_one_by_one(spark, tmp_path):
    # Two loci of one block of 20: only the first is sensitive to position.
    rows = [("c", ("G1", "G2", "S")[i % 3], "chr1", locus, i % 4, i / 24, i / 24 + (i % 4 if locus == 0 else 0) + (i * 7 % 5) / 50) for locus in (0, 1) for i in range(24)]
    spark.createDataFrame(rows, "cellids string, states string, chrom string, locus int, locale_no int, t double, rt double").write.parquet(f"{tmp_path}/sc_repliseq.parquet")
    got = {r["locus"]: r for r in analyses.QUERIES["l22_loci"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1} and all(r["n"] == 24 and r["n_locales"] == 4 for r in got.values())
    assert got[0]["sensitivity"] > 0.9 > got[1]["sensitivity"] and got[0]["f_stat"] > 100 > got[1]["f_stat"]
    counts = spark.createDataFrame([(s, 0 if s != "G2" else 1, float(v)) for s in ("G1", "G2", "S") for v in (0, 1, 1, 2)] + [("S", 9, 0.0)], "state string, locus int, value double")
    got = {r["locus"]: r["p"] for r in replication.by_group(counts, ["locus"]).collect()}
    assert got[9] is None and 0 <= got[0] <= 1  # nothing known of the efficiency at locus 9


def test_sweep(spark, tmp_path):
    rnd = random.Random(4)
    spots = [(i, "c", "chr1", "1" if i % 2 else "2", str(i), *[rnd.uniform(1, 3) for _ in range(3)], 100_000 * (1 + i % 30), 100_000 * (2 + i % 30), 1.0) for i in range(520)]
    spark.createDataFrame(spots, "row_id bigint, cell_id string, chrom string, trace_id string, spot_id string, x double, y double, z double, start_bp bigint, end_bp bigint, lum double").write.parquet(f"{tmp_path}/spots.parquet")
    spark.createDataFrame([("chr1", 8_000_000)], "chrom string, length_bp bigint").write.parquet(f"{tmp_path}/genome.parquet")
    got = {r["k"]: r for r in analyses.QUERIES["k15_sweep"](spark, str(tmp_path)).collect()}
    near = {a[0]: sorted((sum((a[c] - b[c]) ** 2 for c in (5, 6, 7)), b[0]) for b in spots if b[0] != a[0]) for a in spots}
    assert set(got) == {25, 50, 100, 250, 500}
    for k, r in got.items():
        assert math.isclose(r["raw"], sum((a - b) % 2 for a in near for _, b in near[a][:k]) / 520, abs_tol=1e-6) and r["copies"] == 1.0
