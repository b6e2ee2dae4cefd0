"""Queries of the analysis operators, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.model import clean_spots, clean_state
from nucleoframe.operators import containers, features, matrices, pairwise, replication, traces
from nucleoframe.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = ["cell_id", "chrom", "trace_id"]
RESOLUTION, WINDOW, COARSE, RADIUS = 100_000, 1_000_000, 1_000_000, 0.6

_S = """s AS (SELECT row_id, cell_id, chrom, trace_id, spot_id, x, y, z, start_bp, end_bp, CASE WHEN CAST(lum AS VARCHAR) <> 'nan' THEN lum END AS lum
  FROM spots WHERE x > 0 AND x < 200000 AND y > 0 AND y < 200000 AND z > 0 AND z < 200000 AND start_bp BETWEEN 0 AND 400000000
  AND chrom IN (SELECT chrom FROM genome))"""
_STATE = """regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"""
_STATE = f"CASE WHEN {_STATE} LIKE 'G1%' THEN 'G1' WHEN {_STATE} LIKE 'G2%' THEN 'G2' WHEN {_STATE} LIKE 'S%' THEN 'S' END"
_C = "c AS (SELECT cell_id, max(" + _STATE.format("state") + ") AS state, max(CASE WHEN CAST(volume AS VARCHAR) <> 'nan' THEN CAST(volume AS DOUBLE) END) AS volume FROM cells GROUP BY cell_id)"
_M = "m AS (SELECT cellids AS cell_id, chrom, locus, copy_no, max(" + _STATE.format("states") + ") AS state, avg(CASE WHEN CAST(rt AS VARCHAR) <> 'nan' THEN rt END) AS value FROM sc_repliseq WHERE trim(cellids) <> '' GROUP BY ALL)"
_M = _M.replace("GROUP BY ALL", "GROUP BY cellids, chrom, locus, copy_no")
_COPY = "k AS (SELECT DISTINCT cell_id, chrom, trace_id, dense_rank() OVER (PARTITION BY cell_id, chrom ORDER BY trace_id) - 1 AS copy FROM s)"
_PLACED = f"{_S}, {_COPY}, p AS (SELECT s.*, l.locus, k.copy FROM s JOIN loci l USING (chrom, start_bp, end_bp) JOIN k USING (cell_id, chrom, trace_id))"


_GRID = "gr AS (SELECT cell_id, chrom, copy, locus FROM k JOIN loci USING (chrom))"
_J1 = f"{_PLACED}, {_GRID}, j1 AS (SELECT g.cell_id, g.chrom, g.locus, g.copy, count(p.row_id) AS value FROM gr g LEFT JOIN p ON p.cell_id = g.cell_id AND p.locus = g.locus AND p.copy = g.copy GROUP BY ALL)"
_N = f"{_J1}, {_C}, n AS (SELECT cell_id, chrom, locus, copy, state, CAST(value AS DOUBLE) AS value FROM j1 LEFT JOIN c USING (cell_id))"


def _of_loci(values: str) -> str:
    """SQL for the mean of spots' values (row_id, value) per cell, locus and copy."""
    return f"WITH {_PLACED}, v AS ({values}) SELECT cell_id, locus, copy, round(avg(v.value), 6) AS value FROM p JOIN v USING (row_id) GROUP BY ALL"


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean_spots(table(spark, sf_dir, "spots"), table(spark, sf_dir, "genome"))
    return s.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND start_bp IS NOT NULL AND chrom IS NOT NULL").withColumn("lum", F.when(~F.isnan("lum"), F.col("lum")))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = F.when(~F.isnan("volume"), F.col("volume").cast("double"))
    return table(spark, sf_dir, "cells").groupBy("cell_id").agg(F.max(clean_state(F.col("state"))).alias("state"), F.max(volume).alias("volume"))


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "sc_repliseq").where(F.trim("cellids") != "")
    return m.groupBy(F.col("cellids").alias("cell_id"), "chrom", "locus", "copy_no").agg(F.max(clean_state(F.col("states"))).alias("state"), F.avg(F.when(~F.isnan("rt"), F.col("rt"))).alias("value"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots at each locus and copy, zeros included, with the state of the cell."""
    counts = features.spot_count(_spots(spark, sf_dir), table(spark, sf_dir, "loci")).withColumn("value", F.col("value").cast("double"))
    return counts.join(_cells(spark, sf_dir).select("cell_id", "state"), "cell_id", "left")


def _means(spark: SparkSession, sf_dir: str, values: DataFrame) -> DataFrame:
    return features.per_locus(_spots(spark, sf_dir), table(spark, sf_dir, "loci"), values).withColumn("value", F.round("value", 6))


def _r(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _add(name: str, sql: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = make, sql


# Containers
_add("b1_lookup", f"WITH {_S} SELECT row_id, trace_id, spot_id FROM s WHERE cell_id = (SELECT min(cell_id) FROM cells WHERE cell_id <> 'unsegmented') AND chrom = 'chr1'",
     lambda k, d: containers.lookup(_spots(k, d), table(k, d, "cells").where("cell_id <> 'unsegmented'").agg(F.min("cell_id")).first()[0], "chr1").select("row_id", "trace_id", "spot_id"))
_add("b2_pop_cells", f"WITH {_S} SELECT count(DISTINCT cell_id) AS ncell, count(DISTINCT CASE WHEN cell_id IN (SELECT cell_id FROM cells WHERE volume < 800) THEN cell_id END) AS ncell_removed, count(DISTINCT CASE WHEN cell_id NOT IN (SELECT cell_id FROM cells WHERE volume < 800) THEN cell_id END) AS ncell_remaining FROM s",
     lambda k, d: containers.removal_counts(_spots(k, d), containers.pop_cells(_spots(k, d), table(k, d, "cells").where("volume < 800"))))
_add("b3_pop_spots", f"WITH {_S}, g AS (SELECT cell_id, chrom, trace_id, spot_id FROM s GROUP BY ALL HAVING count(*) > 1) SELECT row_id FROM s WHERE (cell_id, chrom, trace_id, spot_id) NOT IN (SELECT cell_id, chrom, trace_id, spot_id FROM g)",
     lambda k, d: containers.pop_spots(_spots(k, d), _spots(k, d).groupBy("cell_id", "chrom", "trace_id", "spot_id").count().where("count > 1")).select("row_id"))
_add("b11_same_index", "SELECT chrom, start_bp, end_bp, 'left' AS side FROM (SELECT chrom, start_bp, end_bp FROM loci EXCEPT SELECT chrom, start_bp, end_bp FROM spots) UNION ALL SELECT chrom, start_bp, end_bp, 'right' FROM (SELECT chrom, start_bp, end_bp FROM spots EXCEPT SELECT chrom, start_bp, end_bp FROM loci)",
     lambda k, d: containers.same_index(table(k, d, "loci"), table(k, d, "spots").select("chrom", "start_bp", "end_bp").distinct()))
_add("b13_consistency", f"WITH {_S}, a AS (SELECT DISTINCT cell_id FROM s), b AS (SELECT DISTINCT cell_id FROM cells) SELECT cell_id, 'cells' AS missing_in FROM a WHERE cell_id NOT IN (SELECT cell_id FROM b) UNION ALL SELECT cell_id, 'spots' FROM b WHERE cell_id NOT IN (SELECT cell_id FROM a)",
     lambda k, d: containers.consistency(_spots(k, d), table(k, d, "cells")))
_add("g1_merge", f"WITH {_S} SELECT concat(cell_id, '_', CASE WHEN trace_id LIKE '%-%' THEN 'noise' ELSE 'valid' END) AS cell_id, count(*) AS n FROM s GROUP BY 1",
     lambda k, d: containers.merge(_spots(k, d).where(~traces.is_noisy(F.col("trace_id"))), _spots(k, d).where(traces.is_noisy(F.col("trace_id"))), "valid", "noise").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")))

# Traces
_add("e1_trace_ranks", f"WITH {_S}, t AS (SELECT cell_id, chrom, trace_id, count(*) AS n_spots, trace_id LIKE '%-%' AS noisy FROM s GROUP BY ALL) SELECT cell_id, chrom, trace_id, n_spots, CASE WHEN noisy THEN -1 ELSE 1 END * row_number() OVER (PARTITION BY cell_id, chrom, noisy ORDER BY n_spots DESC, trace_id) AS trace_rank FROM t",
     lambda k, d: traces.trace_ranks(_spots(k, d)))
_add("e2_copy_numbers", f"WITH {_S}, {_COPY} SELECT * FROM k", lambda k, d: traces.copy_numbers(_spots(k, d)))
_add("d1_attributes", f"WITH {_S}, a AS (SELECT cell_id, chrom, trace_id, start_bp, end_bp, count(*) n FROM s GROUP BY ALL), b AS (SELECT cell_id, chrom, trace_id, sum(n) n, max(n) d FROM a GROUP BY ALL) SELECT (SELECT count(DISTINCT cell_id) FROM s) AS ncell, (SELECT max(n) FROM (SELECT count(DISTINCT chrom) n FROM s GROUP BY cell_id)) AS nchrom, (SELECT count(*) FROM s) AS nspot, (SELECT max(n) FROM (SELECT count(*) n FROM b GROUP BY cell_id, chrom)) AS max_ntrace_per_chrom, CAST(max(n) AS BIGINT) AS max_nspot_per_trace, max(d) AS max_nspot_per_domain FROM b",
     lambda k, d: traces.attributes(_spots(k, d)))
_add("d3_spots_per_trace", f"WITH {_S} SELECT cell_id, chrom, trace_id, count(*) AS n_spots FROM s WHERE trace_id NOT LIKE '%-%' GROUP BY ALL", lambda k, d: traces.spots_per_trace(_spots(k, d)))
_add("d4_traces_per_chromosome", f"WITH {_S} SELECT cell_id, chrom, count(DISTINCT CASE WHEN trace_id NOT LIKE '%-%' THEN trace_id END) AS n_traces FROM s GROUP BY ALL", lambda k, d: traces.traces_per_chromosome(_spots(k, d)))
_add("d5_coverage", f"WITH {_S}, l AS (SELECT chrom, count(*) n FROM loci GROUP BY 1) SELECT cell_id, chrom, trace_id, round(count(DISTINCT start_bp) / max(n), 6) AS coverage FROM (SELECT DISTINCT cell_id, chrom, trace_id, start_bp, end_bp FROM s WHERE end_bp IS NOT NULL) JOIN l USING (chrom) GROUP BY ALL".replace("count(DISTINCT start_bp)", "count(*)"),
     lambda k, d: traces.coverage(_spots(k, d).where("end_bp IS NOT NULL"), table(k, d, "loci")).select(*K, *_r("coverage")))
_add("d6_spots_by_rank", f"WITH {_S}, t AS (SELECT cell_id, chrom, trace_id, count(*) AS n, trace_id LIKE '%-%' AS noisy FROM s GROUP BY ALL), r AS (SELECT n, CASE WHEN noisy THEN -1 ELSE 1 END * row_number() OVER (PARTITION BY cell_id, chrom, noisy ORDER BY n DESC, trace_id) AS trace_rank FROM t) SELECT trace_rank, round(avg(n), 6) AS avg_spots, count(*) AS n_traces FROM r GROUP BY 1",
     lambda k, d: traces.spots_by_rank(_spots(k, d)).select("trace_rank", *_r("avg_spots"), "n_traces"))
_NB = f"{_S}, q AS (SELECT cell_id, chrom, trace_id, start_bp - lag(start_bp) OVER w AS g, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS d FROM s WINDOW w AS (PARTITION BY cell_id, chrom, trace_id ORDER BY start_bp, spot_id, row_id))"
_add("d7_neighbour_distances", f"WITH {_NB} SELECT cell_id, chrom, trace_id, round(avg(g), 6) AS avg_gdist, min(g) AS min_gdist, max(g) AS max_gdist, round(avg(d), 6) AS avg_dist, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist FROM q WHERE g IS NOT NULL GROUP BY ALL",
     lambda k, d: traces.neighbour_distances(_spots(k, d)).select(*K, *_r("avg_gdist"), "min_gdist", "max_gdist", *_r("avg_dist", "min_dist", "max_dist")))
_add("d8_sisters", f"WITH {_S} SELECT a.cell_id, a.chrom, a.trace_id, a.start_bp, a.row_id, b.row_id AS sister_id, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 6) AS dist FROM s a JOIN s b ON a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.trace_id = b.trace_id AND a.start_bp = b.start_bp AND a.row_id < b.row_id",
     lambda k, d: traces.sisters(_spots(k, d)).withColumn("dist", F.round("dist", 6)))
_add("d9_homologue_proximity", f"WITH {_S}, v AS (SELECT * FROM s WHERE trace_id NOT LIKE '%-%'), m AS (SELECT cell_id, chrom FROM v GROUP BY 1, 2 HAVING count(DISTINCT trace_id) >= 2), h AS (SELECT DISTINCT a.cell_id, a.chrom FROM v a JOIN v b ON a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.trace_id < b.trace_id AND abs(a.x - b.x) <= 0.6 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 0.36) SELECT chrom, round(avg(CASE WHEN h.cell_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share, count(*) AS n_cells FROM m LEFT JOIN h USING (cell_id, chrom) GROUP BY 1",
     lambda k, d: traces.homologue_proximity(_spots(k, d), RADIUS).select("chrom", *_r("share"), "n_cells"))
_add("d10_projection", f"WITH {_S} SELECT cell_id, chrom, trace_id, CAST(floor(start_bp / 1000000) * 1000000 AS BIGINT) AS start_bp, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(lum), 6) AS lum, count(*) AS n_spots FROM s GROUP BY cell_id, chrom, trace_id, floor(start_bp / 1000000)",
     lambda k, d: traces.projection(_spots(k, d), COARSE).select(*K, "start_bp", *_r("x", "y", "z", "lum"), "n_spots"))
_add("b6_cleaning", f"WITH {_NB}, l AS (SELECT chrom, count(*) n FROM loci GROUP BY 1), c AS (SELECT cell_id, chrom, trace_id, count(*) / max(n) AS cov FROM (SELECT DISTINCT cell_id, chrom, trace_id, start_bp, end_bp FROM s WHERE end_bp IS NOT NULL) JOIN l USING (chrom) GROUP BY ALL), g AS (SELECT cell_id, chrom, trace_id FROM q WHERE g IS NOT NULL GROUP BY ALL HAVING avg(g) <= 1000000) SELECT row_id FROM s JOIN c USING (cell_id, chrom, trace_id) JOIN g USING (cell_id, chrom, trace_id) WHERE cov >= 0.1 AND trace_id NOT LIKE '%-%'",
     lambda k, d: traces.clean(_spots(k, d), table(k, d, "loci"), 0.1, 1_000_000).select("row_id"))
_add("k6_imputation", f"""WITH {_S}, v AS (SELECT cell_id, chrom, trace_id, start_bp, arg_max(x, row_id) x, arg_max(y, row_id) y, arg_max(z, row_id) z FROM s WHERE trace_id NOT LIKE '%-%' GROUP BY ALL), t AS (SELECT DISTINCT cell_id, chrom, trace_id FROM v),
 w AS (SELECT t.*, l.start_bp, l.end_bp FROM t JOIN loci l USING (chrom)), a AS (SELECT w.*, v.x IS NULL AS gap, l.start_bp AS ls, l.x AS lx, l.y AS ly, l.z AS lz, r.start_bp AS rs, r.x AS rx, r.y AS ry, r.z AS rz FROM w LEFT JOIN v ON v.cell_id = w.cell_id AND v.chrom = w.chrom AND v.trace_id = w.trace_id AND v.start_bp = w.start_bp
 ASOF LEFT JOIN v l ON l.cell_id = w.cell_id AND l.chrom = w.chrom AND l.trace_id = w.trace_id AND w.start_bp >= l.start_bp ASOF LEFT JOIN v r ON r.cell_id = w.cell_id AND r.chrom = w.chrom AND r.trace_id = w.trace_id AND w.start_bp <= r.start_bp)
 SELECT cell_id, chrom, trace_id, start_bp, end_bp, round(0.00001234 + coalesce(lx + (rx - lx) * ((start_bp - ls) / (rs - ls)), lx, rx), 3) AS x, round(0.00001234 + coalesce(ly + (ry - ly) * ((start_bp - ls) / (rs - ls)), ly, ry), 3) AS y, round(0.00001234 + coalesce(lz + (rz - lz) * ((start_bp - ls) / (rs - ls)), lz, rz), 3) AS z FROM a WHERE gap AND (ls IS NOT NULL OR rs IS NOT NULL)""",
     lambda k, d: traces.imputed(_spots(k, d), table(k, d, "loci")).select(*K, "start_bp", "end_bp", *[F.round(F.col(c) + 0.00001234, 3).alias(c) for c in "xyz"]))
_add("k8_nearest_trace", f"WITH {_S}, j AS (SELECT a.row_id, b.trace_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d FROM s a JOIN s b USING (cell_id, chrom, start_bp, end_bp) WHERE a.trace_id LIKE '%-%' AND b.trace_id NOT LIKE '%-%'), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, trace_id) AS k FROM j) SELECT row_id, trace_id, round(d, 6) AS dist FROM r WHERE k = 1 AND d <= 5",
     lambda k, d: traces.nearest_trace(_spots(k, d).where(traces.is_noisy(F.col("trace_id"))), _spots(k, d).where(~traces.is_noisy(F.col("trace_id"))), 5.0).withColumn("dist", F.round("dist", 6)))

# Features
_D = lambda a, b: f"sqrt(power({a}.x - {b}.x, 2) + power({a}.y - {b}.y, 2) + power({a}.z - {b}.z, 2))"
_SAME = "a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.trace_id = b.trace_id"
_add("c1_unplaced", f"WITH {_S}, h AS (SELECT chrom, start_bp, end_bp, count(*) AS hits FROM loci GROUP BY ALL) SELECT row_id, coalesce(hits, 0) AS hits FROM s LEFT JOIN h USING (chrom, start_bp, end_bp) WHERE coalesce(hits, 0) <> 1",
     lambda k, d: features.unplaced(_spots(k, d), table(k, d, "loci")).select("row_id", "hits"))
_add("j1_spot_count", f"WITH {_J1} SELECT cell_id, chrom, locus, copy, value FROM j1", lambda k, d: features.spot_count(_spots(k, d), table(k, d, "loci")))
_LIGHT = f"WITH {_PLACED}, {_GRID} SELECT g.cell_id, g.locus, g.copy, AGG AS value FROM gr g LEFT JOIN p ON p.cell_id = g.cell_id AND p.locus = g.locus AND p.copy = g.copy GROUP BY ALL"
_add("j2_intensity", _LIGHT.replace("AGG", "round(CASE WHEN count(p.row_id) = 0 THEN 0.0 ELSE avg(p.lum) END, 6)"), lambda k, d: features.intensity(_spots(k, d), table(k, d, "loci")).withColumn("value", F.round("value", 6)))
_add("j2_intensity_sum", _LIGHT.replace("AGG", "round(coalesce(sum(p.lum), 0.0), 4)"), lambda k, d: features.intensity(_spots(k, d), table(k, d, "loci"), "sum").withColumn("value", F.round("value", 4)))
_add("j4_height", f"WITH {_PLACED} SELECT cell_id, locus, copy, round(avg(z), 6) AS value FROM p GROUP BY ALL", lambda k, d: features.height(_spots(k, d), table(k, d, "loci")).withColumn("value", F.round("value", 6)))
_add("j6_chain_distance", _of_loci(f"SELECT a.row_id, avg({_D('a', 'b')}) AS value FROM s a JOIN s b ON {_SAME} AND abs(a.start_bp - b.start_bp) = 100000 GROUP BY 1"), lambda k, d: _means(k, d, features.chain_distance(_spots(k, d), RESOLUTION)))
_add("j7_gyration", _of_loci(f"SELECT a.row_id, CASE WHEN count(*) > 1 THEN sqrt(var_pop(b.x) + var_pop(b.y) + var_pop(b.z)) END AS value FROM s a JOIN s b ON {_SAME} AND abs(a.start_bp - b.start_bp) <= 500000 GROUP BY 1"), lambda k, d: _means(k, d, features.gyration(_spots(k, d), WINDOW)))
_add("j8_window_pairs", _of_loci(f"SELECT a.row_id, avg({_D('t', 'b')}) AS value FROM s a JOIN s b ON {_SAME} AND abs(a.start_bp - b.start_bp) <= 200000 LEFT JOIN s t ON {_SAME.replace('b.', 't.')} AND abs(a.start_bp - t.start_bp) <= 200000 AND b.row_id < t.row_id GROUP BY 1"), lambda k, d: _means(k, d, features.window_pairs(_spots(k, d), 400_000)))
_SPHERE = f"SELECT a.row_id, count(*) AS n, count_if(a.chrom <> b.chrom) / count(*) AS inter, count_if(a.chrom <> b.chrom OR a.trace_id <> b.trace_id) / count(*) AS trans, count_if(a.chrom = b.chrom AND abs(a.start_bp - b.start_bp) >= 1000000) / count(*) AS long_intra, avg(CASE WHEN {_D('a', 'b')} > 0 THEN {_D('a', 'b')} END) AS mean_dist, count_if({_D('a', 'b')} > 0) AS na FROM s a JOIN s b ON a.cell_id = b.cell_id AND a.row_id <> b.row_id AND abs(a.x - b.x) < 0.6 AND abs(a.y - b.y) < 0.6 WHERE {_D('a', 'b')} < 0.6 GROUP BY 1"
_add("j11_j13_sphere", f"WITH {_PLACED}, q AS ({_SPHERE}) SELECT cell_id, locus, copy, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("inter", "trans", "long_intra", "mean_dist")) + ", round(avg(coalesce(na, 0) / (4.0 / 3 * pi() * power(0.6, 3))), 6) AS density FROM p LEFT JOIN q USING (row_id) GROUP BY ALL",
     lambda k, d: features.placed(_spots(k, d), table(k, d, "loci")).select("cell_id", "locus", "copy", "row_id").join(features.sphere(_spots(k, d), RADIUS, 1_000_000), "row_id").groupBy("cell_id", "locus", "copy").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("inter", "trans", "long_intra", "mean_dist", "density")]))
_KERNEL = f"SELECT a.row_id, sum(exp(-{_D('a', 'b')} * {_D('a', 'b')} / (2 * 0.15 * 0.15))) / count(*) / (power(2 * pi(), 1.5) * power(0.15, 3)) AS value FROM s a JOIN s b ON a.cell_id = b.cell_id AND {_D('a', 'b')} <> 0 GROUP BY 1"
_add("j17_kernel_density", _of_loci(_KERNEL), lambda k, d: _means(k, d, features.kernel_density(_spots(k, d), 0.15)))
_add("j17_kernel_of_light", _of_loci(_KERNEL.replace("<> 0 GROUP", "<> 0 AND b.lum > 500 GROUP")).replace("FROM p JOIN v", "FROM p LEFT JOIN v"), lambda k, d: _means(k, d, features.kernel_density(_spots(k, d), 0.15, F.col("lum") > 500)))
_add("j3_outside_values", f"WITH {_PLACED}, f AS (SELECT cell_id, spot_id, avg(lum) AS value FROM s WHERE lum IS NOT NULL GROUP BY ALL) SELECT cell_id, locus, copy, round(avg(value), 6) AS value FROM p LEFT JOIN f USING (cell_id, spot_id) GROUP BY ALL",
     lambda k, d: features.outside(_spots(k, d), table(k, d, "loci"), _spots(k, d).where("lum IS NOT NULL").select("cell_id", "spot_id", F.col("lum").alias("value")))[0].withColumn("value", F.round("value", 6)))

# Matrices
_CUBE = ["cell_id", "chrom", "locus", "copy_no"]
_add("d12_haploid_profile", f"WITH {_M} SELECT chrom, locus, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n, round(stddev_pop(value) / sqrt(count(value)), 6) AS sem FROM m GROUP BY 1, 2",
     lambda k, d: matrices.haploid_profile(_cube(k, d)).select("chrom", "locus", *_r("mean", "std"), "n", *_r("sem")))
_add("d13_coarse_grain", f"WITH {_M} SELECT cell_id, chrom, CAST(locus // 10 AS INTEGER) AS coarse, copy_no, round(avg(value), 6) AS value FROM m GROUP BY ALL", lambda k, d: matrices.coarse_grain(_cube(k, d), 10).withColumn("value", F.round("value", 6)))
_add("e4_sliding", f"WITH {_M} SELECT cell_id, chrom, locus, copy_no, round(avg(value) OVER (PARTITION BY cell_id, chrom, copy_no ORDER BY locus RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS slid FROM m", lambda k, d: matrices.sliding(_cube(k, d), 10).select(*_CUBE, *_r("slid")))
_add("e5_smooth", f"WITH {_M}, h AS (SELECT chrom, locus, avg(value) AS value FROM m GROUP BY 1, 2) SELECT chrom, locus, round(avg(value) OVER (PARTITION BY chrom ORDER BY locus ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), 6) AS smooth FROM h",
     lambda k, d: matrices.smoothed(_cube(k, d).groupBy("chrom", "locus").agg(F.avg("value").alias("value")), 12).select("chrom", "locus", *_r("smooth")))
_add("e7_quantise", f"WITH {_M}, e AS (SELECT cell_id, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM m GROUP BY 1) SELECT cell_id, chrom, locus, copy_no, CASE WHEN value IS NOT NULL THEN CAST(value >= q[1] AS INTEGER) + CAST(value >= q[2] AS INTEGER) + CAST(value >= q[3] AS INTEGER) END AS q FROM m JOIN e USING (cell_id)",
     lambda k, d: matrices.quantised(_cube(k, d), 4).select(*_CUBE, "q"))
_add("e8_z_score", f"WITH {_M} SELECT cell_id, chrom, locus, copy_no, round(CASE WHEN stddev_pop(value) OVER w > 1e-12 * (1 + abs(avg(value) OVER w)) THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS zscore FROM m WINDOW w AS (PARTITION BY cell_id)",
     lambda k, d: matrices.z_scores(_cube(k, d), ["cell_id"]).select(*_CUBE, *_r("zscore")))
_add("e9_normalise", f"WITH {_M} SELECT cell_id, chrom, locus, copy_no, round(CASE WHEN avg(value) OVER w <> 0 THEN value / avg(value) OVER w END, 4) + 0.0 AS norm FROM m WINDOW w AS (PARTITION BY cell_id)", lambda k, d: matrices.normalised_by_cell(_cube(k, d)).select(*_CUBE, F.round("norm", 4).alias("norm")))
_add("e12_curate", "WITH n AS (SELECT cellids AS cell_id, chrom, locus, copy_no, sample_id, CAST(CASE WHEN locale_no >= 0 THEN locale_no END AS DOUBLE) AS value FROM sc_repliseq) SELECT sample_id, CASE WHEN min(CASE WHEN value = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id, chrom, copy_no) = 0 THEN value END AS value FROM n",
     lambda k, d: matrices.without_missing_chromosomes(table(k, d, "sc_repliseq").select("sample_id", F.col("cellids").alias("cell_id"), "chrom", "copy_no", F.when(F.col("locale_no") >= 0, F.col("locale_no").cast("double")).alias("value"))).select("sample_id", "value"))
_add("f4_sorted_cells", f"WITH {_M} SELECT cell_id, round(avg(value) + 0.00001234, 3) AS mean, row_number() OVER (ORDER BY round(avg(value), 9) NULLS LAST, cell_id) AS place FROM m GROUP BY 1", lambda k, d: matrices.sorted_cells(_cube(k, d)).select("cell_id", F.round(F.col("mean") + 0.00001234, 3).alias("mean"), "place"))
_add("k7_feature_imputation", f"WITH {_M}, a AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN locus END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, min(CASE WHEN value IS NOT NULL THEN locus END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM m WINDOW w AS (PARTITION BY cell_id, chrom, copy_no ORDER BY locus)) SELECT a.cell_id, a.chrom, a.locus, a.copy_no, round(coalesce(a.value, x.value + (y.value - x.value) * ((a.locus - a.l) / (a.r - a.l)), x.value, y.value), 6) AS filled FROM a LEFT JOIN m x ON x.cell_id = a.cell_id AND x.chrom = a.chrom AND x.copy_no = a.copy_no AND x.locus = a.l LEFT JOIN m y ON y.cell_id = a.cell_id AND y.chrom = a.chrom AND y.copy_no = a.copy_no AND y.locus = a.r",
     lambda k, d: matrices.interpolated(_cube(k, d)).select(*_CUBE, *_r("filled")))

# Contacts
_CT = f"""{_S}, {_C}, b AS (SELECT s.*, c.state, CAST(start_bp // 1000000 AS INTEGER) AS bin FROM s JOIN c USING (cell_id)), q AS (SELECT a.cell_id, a.chrom, a.trace_id, a.state, a.bin AS bin1, b.bin AS bin2, count(*) AS n, count_if(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 0.6) AS c FROM b a JOIN b ON a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.trace_id = b.trace_id AND a.bin < b.bin GROUP BY ALL),
 u AS (SELECT cell_id, chrom, trace_id, bin1, bin2, n, c, state AS g FROM q WHERE state IS NOT NULL UNION ALL SELECT cell_id, chrom, trace_id, bin1, bin2, n, c, 'all' FROM q), t AS (SELECT g, chrom, count(*) AS ns FROM (SELECT DISTINCT g, cell_id, chrom, trace_id FROM u) GROUP BY ALL),
 z AS (SELECT g, chrom, bin1, bin2, CAST(sum(n) AS DOUBLE) n, CAST(sum(c) AS DOUBLE) c, CAST(sum(n * n) AS DOUBLE) nn, CAST(sum(c * c) AS DOUBLE) cc FROM u GROUP BY ALL),
 f AS (SELECT g AS state, chrom, bin1, bin2, ns AS nsamples, c / n AS f, CASE WHEN ns > 1 THEN ((cc - c * c / ns) / (ns - 1) - c / n * c / n * (nn - n * n / ns) / (ns - 1)) / (n * n / ns) END AS f_var FROM z JOIN t USING (g, chrom))"""
_add("k9_contacts", f"WITH {_CT} SELECT state, chrom, bin1, bin2, nsamples, round(f, 6) AS f, round(f_var, 6) + 0.0 AS f_var FROM f",
     lambda k, d: pairwise.intra_contacts(_spots(k, d), _cells(k, d).select("cell_id", "state"), COARSE, RADIUS).select("state", "chrom", "bin1", "bin2", "nsamples", *_r("f", "f_var")))
_add("k9_single_traces", f"WITH {_CT} SELECT cell_id, chrom, trace_id, bin1, bin2, n, c FROM q", lambda k, d: pairwise.sample_contacts(_spots(k, d).join(_cells(k, d).select("cell_id"), "cell_id", "left_semi"), COARSE, RADIUS))
_add("k9_binarised", f"WITH {_CT.replace('count(*) AS n, count_if', '1 AS n, max(CASE WHEN ').replace('<= 0.6) AS c FROM b a', '<= 0.6 THEN 1 ELSE 0 END) AS c FROM b a').replace('WHEN (sqrt', 'WHEN sqrt')} SELECT state, chrom, bin1, bin2, nsamples, round(f, 6) AS f FROM f",
     lambda k, d: pairwise.intra_contacts(_spots(k, d), _cells(k, d).select("cell_id", "state"), COARSE, RADIUS, True).select("state", "chrom", "bin1", "bin2", "nsamples", *_r("f")))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "loci").groupBy("chrom").agg((F.max(F.floor(F.col("start_bp") / COARSE)) + 1).cast("int").alias("n_bins"))


def _controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.control(pairwise.intra_contacts(_spots(spark, sf_dir), _cells(spark, sf_dir).select("cell_id", "state"), COARSE, RADIUS), _bins(spark, sf_dir))


_BINS = "nb AS (SELECT max(start_bp // 1000000) + 1 AS n FROM loci GROUP BY chrom), en AS (SELECT d, 2 * sum(greatest(n - d, 0)) AS entries FROM nb, range(1, 400) r(d) GROUP BY 1)"
_add("d17_control", f"WITH {_CT}, {_BINS} SELECT state, chrom, bin1, bin2, round(CASE WHEN entries >= 100 THEN avg(f) OVER (PARTITION BY state, bin2 - bin1) END, 6) AS control FROM f JOIN en ON d = bin2 - bin1",
     lambda k, d: _controlled(k, d).select("state", "chrom", "bin1", "bin2", *_r("control")))
QUERIES["k11_significance"] = lambda k, d: pairwise.significance(pairwise.intra_contacts(_spots(k, d), _cells(k, d).select("cell_id", "state"), COARSE, RADIUS), _bins(k, d)).select("state", "chrom", "bin1", "bin2", "p", "significant")

# Replication
_MOM = "count(value) AS nsamples, avg(value) AS n, avg(CASE WHEN value IS NULL THEN NULL WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS f"
_add("d18_moments", f"WITH {_N} SELECT state, count(value) AS nsamples, round(avg(value), 6) AS n, round(var_samp(value) / count(value), 6) AS n_var, round(avg(CASE WHEN value = 0 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), 6) AS f FROM n GROUP BY 1",
     lambda k, d: replication.moments(_counts(k, d), ["state"]).select("state", "nsamples", *_r("n", "n_var", "f")))
_add("l3_population", f"WITH {_N}, a AS (SELECT state, {_MOM} FROM n WHERE state IS NOT NULL GROUP BY 1), e AS (SELECT avg(CASE WHEN state = 'G1' THEN 1 - f WHEN state = 'G2' THEN 1 - sqrt(f) END) AS es FROM a), r AS (SELECT *, CASE state WHEN 'G1' THEN 0 WHEN 'G2' THEN 1 ELSE (1 - es - f) / (es * (1 - es)) END AS p, CASE state WHEN 'G1' THEN 1 - f WHEN 'G2' THEN 1 - sqrt(f) ELSE es END AS eps FROM a, e) SELECT state, nsamples, round(n, 6) AS n, round(f, 6) AS f, round(p, 6) AS p, round(eps, 6) AS eps, round(n / ((1 + p) * eps), 6) AS beta FROM r",
     lambda k, d: replication.population(_counts(k, d).where("state IS NOT NULL")).select("state", "nsamples", *_r("n", "f", "p", "eps", "beta")))
_add("l5_locus_run", f"WITH {_N}, a AS (SELECT chrom, locus // 20 AS blk, state, {_MOM} FROM n WHERE state IS NOT NULL GROUP BY ALL), e AS (SELECT chrom, blk, avg(CASE WHEN state = 'G1' THEN 1 - f WHEN state = 'G2' THEN 1 - sqrt(f) END) AS es FROM a GROUP BY ALL) SELECT chrom, CAST(blk AS INTEGER) AS blk, round(n, 6) AS n, round(f, 6) AS f, round(es, 6) AS eps, round(CASE WHEN es * (1 - es) <> 0 THEN greatest(0.0, least(1.0, (1 - es - f) / (es * (1 - es)))) END, 6) AS p FROM a JOIN e USING (chrom, blk) WHERE state = 'S'",
     lambda k, d: replication.by_group(_counts(k, d).where("state IS NOT NULL").withColumn("blk", F.floor(F.col("locus") / 20).cast("int")), ["chrom", "blk"]).select("chrom", "blk", *_r("n", "f", "eps", "p")))
_add("l5_loci", ORACLES["l5_locus_run"].replace("locus // 20 AS blk", "locus AS blk").replace("CAST(blk AS INTEGER) AS blk", "CAST(blk AS INTEGER) AS locus"),
     lambda k, d: replication.by_group(_counts(k, d).where("state IS NOT NULL"), ["chrom", "locus"]).select("chrom", "locus", *_r("n", "f", "eps", "p")))
_add("l9_simulated_timing", f"WITH {_N} SELECT chrom, locus, round(CASE WHEN avg(CASE WHEN state IN ('G1', 'G2') THEN value END) <> 0 THEN avg(CASE WHEN state = 'S' THEN value END) / avg(CASE WHEN state IN ('G1', 'G2') THEN value END) END, 6) AS rt FROM n GROUP BY 1, 2", lambda k, d: replication.simulated_timing(_counts(k, d)).select("chrom", "locus", *_r("rt")))
_add("l14_states_by_volume", f"WITH {_C}, r AS (SELECT cell_id, row_number() OVER (ORDER BY volume, cell_id) AS r, count(*) OVER () AS n FROM c WHERE volume IS NOT NULL) SELECT cell_id, CASE WHEN r <= floor(n * 0.4) THEN 'G1' WHEN r > n - floor(n * 0.2) THEN 'G2' ELSE 'S' END AS state FROM r", lambda k, d: replication.states_by_volume(_cells(k, d), 0.4, 0.2))
_add("l23_welch", f"WITH {_M}, w AS (SELECT chrom, locus // 20 AS blk, avg(CASE WHEN state = 'G1' THEN value END) ma, var_samp(CASE WHEN state = 'G1' THEN value END) va, count(CASE WHEN state = 'G1' THEN value END) na, avg(CASE WHEN state = 'S' THEN value END) mb, var_samp(CASE WHEN state = 'S' THEN value END) vb, count(CASE WHEN state = 'S' THEN value END) nb FROM m GROUP BY ALL) SELECT chrom, CAST(blk AS INTEGER) AS blk, round((ma - mb) / sqrt(va / na + vb / nb), 5) AS t FROM w",
     lambda k, d: replication.welch(_cube(k, d).withColumn("blk", F.floor(F.col("locus") / 20).cast("int")), "state", "G1", "S", ["chrom", "blk"]).select("chrom", "blk", F.round("t", 5).alias("t")))
