"""Queries of containers, reading, masks and small operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.operators import containers, features, traces
from nucleoframe.plans.problems import _COORD, _FLOAT, _PLAIN, _VALUE, LINES_SQL
from nucleoframe.plans.reference import _GRID, _J1, _PLACED, _S, _STATE, _cells, _spots
from nucleoframe.session import table
from nucleoframe.sources.fofct_spots import fofct_spots, repeated_spots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = make, sql


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spots of valid and of noisy traces."""
    s = _spots(spark, sf_dir)
    noisy = traces.is_noisy(F.col("trace_id"))
    return s.where(~noisy), s.where(noisy)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cells")
    return c.groupBy("cell_id").agg(F.min("cell_num").alias("cell_num")).join(_cells(spark, sf_dir), "cell_id")


# Reading
_BY_NAME = lambda n: "nullif(" + _PLAIN(f"trim(fs[list_position(names, '{n}')], ' ' || chr(9) || chr(13) || chr(10))") + ", '')"
_FOF = f"""WITH {LINES_SQL}, g AS (SELECT l.line_id, l.file_id, f.line_no, coalesce({_VALUE("Cell_ID")}, tr) AS cell_id, ch AS chrom, tr AS trace_id, {_VALUE("Spot_ID")} AS sid, 0.5 * xv AS x, 0.5 * {_COORD("yt")} AS y, 2 * {_COORD("zt")} AS z, CAST(st AS BIGINT) AS start_bp, TRY_CAST({_BY_NAME("Chrom_End")} AS BIGINT) AS end_bp, {_VALUE("Intensity")} AS li, {_BY_NAME("Gene_ID")} AS gene_id FROM ln l JOIN (SELECT line_id, line_no FROM fofct_lines) f USING (line_id) WHERE reason IS NULL),
q AS (SELECT line_id, file_id, cell_id, chrom, trace_id, coalesce(sid, CAST(row_number() OVER (PARTITION BY file_id, cell_id ORDER BY line_no, line_id) AS VARCHAR)) AS spot_id, x, y, z, start_bp, end_bp, {_FLOAT.format("li")} AS lum, gene_id FROM g)"""
_add("a1_fofct_spots", lambda k, d: fofct_spots(table(k, d, "fofct_lines"), (0.5, 0.5, 2.0)), f"{_FOF} SELECT * FROM q")
_add("a6_repeated_spots", lambda k, d: repeated_spots(fofct_spots(table(k, d, "fofct_lines")), ["file_id"]), f"{_FOF} SELECT file_id, cell_id, chrom, trace_id, spot_id, count(*) AS n FROM q GROUP BY ALL HAVING count(*) > 1")

# Containers
_add("a11_index", lambda k, d: containers.index_of(_spots(k, d)), f"WITH {_S}, i AS (SELECT DISTINCT chrom, start_bp, end_bp FROM s WHERE end_bp IS NOT NULL) SELECT CAST(row_number() OVER (ORDER BY chrom, start_bp, end_bp) - 1 AS INTEGER) AS locus, chrom, start_bp, end_bp FROM i")
_add("a13_shape_faults", lambda k, d: containers.shape_faults(features.height(_spots(k, d), table(k, d, "loci")), features.grid(_spots(k, d), table(k, d, "loci")), ["cell_id", "locus", "copy"]),
     f"WITH {_PLACED}, {_GRID} SELECT cell_id, locus, copy, 'missing' AS fault FROM gr WHERE (cell_id, locus, copy) NOT IN (SELECT (cell_id, locus, copy) FROM p)")
_add("b4_pop_feature_cells", lambda k, d: _popped(k, d), f"""WITH {_J1}, c0 AS (SELECT cell_id, min(cell_num) AS n, max({_STATE.format("state")}) AS state FROM cells GROUP BY 1), c1 AS (SELECT cell_id, CAST(row_number() OVER (ORDER BY n, cell_id) - 1 AS INTEGER) AS cell_num FROM c0 WHERE state IS DISTINCT FROM 'G1') SELECT cell_num, locus, copy, value FROM j1 JOIN c1 USING (cell_id)""")


def _popped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _numbered(spark, sf_dir)
    cube = features.spot_count(_spots(spark, sf_dir), table(spark, sf_dir, "loci")).join(cells.select("cell_id", "cell_num"), "cell_id")
    return containers.pop_feature_cells(cube, cells, cells.where("state = 'G1'"))[1].select("cell_num", "locus", "copy", "value")


_add("b10_without_imputed", lambda k, d: traces.without_imputed(traces.completed(_spots(k, d), table(k, d, "loci"))).groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n")), f"WITH {_S} SELECT cell_id, chrom, count(*) AS n FROM s WHERE NOT contains(spot_id, 'IMPUTED') GROUP BY ALL")
_add("b12_lost_loci", lambda k, d: containers.lost_loci(_spots(k, d), table(k, d, "loci").where("locus % 2 = 0")), f"WITH {_S} SELECT DISTINCT chrom, start_bp, end_bp FROM s WHERE NOT EXISTS (SELECT 1 FROM loci l WHERE l.locus % 2 = 0 AND l.chrom = s.chrom AND l.start_bp = s.start_bp AND l.end_bp IS NOT DISTINCT FROM s.end_bp)")
_add("b15_autosomes", lambda k, d: _spots(k, d).join(containers.chromosomes(table(k, d, "genome"), ["#", "chrX"]), "chrom", "left_semi").groupBy("chrom").agg(F.count(F.lit(1)).alias("n")), f"WITH {_S} SELECT chrom, count(*) AS n FROM s WHERE chrom <> 'chrY' GROUP BY 1")
_add("b16_flat_index", lambda k, d: table(k, d, "sc_repliseq").join(_numbered(k, d), F.col("cellids") == F.col("cell_id")).crossJoin(F.broadcast(table(k, d, "loci").agg(F.count(F.lit(1)).alias("n_loci")))).select("sample_id", "state", containers.flat_index(F.col("cell_num"), F.col("locus"), F.col("copy_no"), F.col("n_loci"), 2).alias("place")),
     f"""WITH c0 AS (SELECT cell_id, min(cell_num) AS n, max({_STATE.format("state")}) AS state FROM cells GROUP BY 1) SELECT sample_id, state, (CAST(n AS BIGINT) * (SELECT count(*) FROM loci) + locus) * 2 + copy_no AS place FROM sc_repliseq JOIN c0 ON cellids = cell_id""")
_ATTR = "a{0} AS (SELECT cell_id, chrom, trace_id, start_bp, end_bp, count(*) n FROM s WHERE {1} GROUP BY ALL), b{0} AS (SELECT cell_id, chrom, trace_id, sum(n) n, max(n) d FROM a{0} GROUP BY ALL), d{0} AS (SELECT (SELECT count(DISTINCT cell_id) FROM b{0}) AS ncell, (SELECT max(n) FROM (SELECT count(DISTINCT chrom) n FROM b{0} GROUP BY cell_id)) AS nchrom, CAST(sum(n) AS BIGINT) AS nspot, (SELECT max(n) FROM (SELECT count(*) n FROM b{0} GROUP BY cell_id, chrom)) AS max_ntrace_per_chrom, CAST(max(n) AS BIGINT) AS max_nspot_per_trace, max(d) AS max_nspot_per_domain FROM b{0})"
_add("d2_merged_attributes", lambda k, d: containers.merged_attributes(*[traces.attributes(p) for p in _parts(k, d)]),
     f"""WITH {_S}, {_ATTR.format(1, "trace_id NOT LIKE '%-%'")}, {_ATTR.format(2, "trace_id LIKE '%-%'")}, u AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2) SELECT CAST(sum(ncell) AS BIGINT) AS ncell, CAST(sum(nspot) AS BIGINT) AS nspot, CASE WHEN min(nchrom) = max(nchrom) THEN max(nchrom) END AS nchrom, max(max_ntrace_per_chrom) AS max_ntrace_per_chrom, max(max_nspot_per_trace) AS max_nspot_per_trace, max(max_nspot_per_domain) AS max_nspot_per_domain FROM u""")
_add("f1_sorted_cells", lambda k, d: containers.sorted_by(_numbered(k, d).select("cell_id", "volume"), [F.col("volume").desc_nulls_last(), F.col("cell_id").asc()]).select("cell_id", "cell_num"),
     "WITH c0 AS (SELECT cell_id, max(CASE WHEN CAST(volume AS VARCHAR) <> 'nan' THEN CAST(volume AS DOUBLE) END) AS volume FROM cells GROUP BY 1) SELECT cell_id, CAST(row_number() OVER (ORDER BY volume DESC NULLS LAST, cell_id) - 1 AS INTEGER) AS cell_num FROM c0")
_add("g2_overlap", lambda k, d: containers.overlap(*_parts(k, d)), f"WITH {_S} SELECT cell_id FROM s WHERE trace_id NOT LIKE '%-%' INTERSECT SELECT cell_id FROM s WHERE trace_id LIKE '%-%'")
_add("g4_completed", lambda k, d: traces.completed(_spots(k, d), table(k, d, "loci")).groupBy("cell_id", "chrom", "trace_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("spot_id", F.lit("IMPUTED"))).alias("n_imputed")),
     f"WITH {_S}, t AS (SELECT cell_id, chrom, trace_id, count(*) AS n, count(DISTINCT start_bp) AS seen, count_if(contains(spot_id, 'IMPUTED')) AS old FROM s GROUP BY ALL), l AS (SELECT chrom, count(*) AS m FROM loci GROUP BY 1) SELECT cell_id, chrom, trace_id, n + CASE WHEN trace_id LIKE '%-%' THEN 0 ELSE m - seen END AS n, old + CASE WHEN trace_id LIKE '%-%' THEN 0 ELSE m - seen END AS n_imputed FROM t JOIN l USING (chrom)")
_add("m_triads", lambda k, d: containers.triads(_spots(k, d)), f"WITH {_PLACED} SELECT cell_id, chrom, trace_id, copy, concat_ws('/', cell_id, chrom, trace_id) AS label FROM k")
