"""Queries of profiles, cell-cycle phases and tests of differences, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.operators import containers, cycle, features, matrices, replication, traces
from nucleoframe.plans.analyses import _classifier_rows, _CLIP, _E6, _FILLED, _OWN, LEAST_VOLUME, WINDOW_CELLS, _feature_counts
from nucleoframe.plans.reference import _C, _M, _MOM, _N, _PLACED, _S, COARSE, ORACLES as _REF, _cells, _counts, _cube, _r, _spots
from nucleoframe.session import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CUBE = ["cell_id", "chrom", "locus", "copy_no"]


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = make, sql


# Spots, bins and profiles
_V = f"{_PLACED}, {_M}, v AS (SELECT p.row_id, p.cell_id, m.value FROM p LEFT JOIN m ON m.cell_id = p.cell_id AND m.locus = p.locus AND m.copy_no = p.copy)"
_add("b7_spots_by_feature", lambda k, d: containers.spots_above(features.of_spots(_spots(k, d), table(k, d, "loci"), _cube(k, d)), 0.8).select("row_id"), f"WITH {_V}, e AS (SELECT cell_id, quantile_cont(value, 0.8) AS e FROM v GROUP BY 1) SELECT row_id FROM v JOIN e USING (cell_id) WHERE value >= e")
_add("c3_quantile_of_spots", lambda k, d: features.of_spots(_spots(k, d), table(k, d, "loci"), matrices.quantised(_cube(k, d), 5).withColumn("value", F.col("q"))).select("row_id", "value"),
     f"WITH {_PLACED}, {_M}, e AS (SELECT cell_id, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM m GROUP BY 1) SELECT row_id, CASE WHEN value IS NOT NULL THEN CAST(value >= q[1] AS INTEGER) + CAST(value >= q[2] AS INTEGER) + CAST(value >= q[3] AS INTEGER) + CAST(value >= q[4] AS INTEGER) END AS value FROM p LEFT JOIN m ON m.cell_id = p.cell_id AND m.locus = p.locus AND m.copy_no = p.copy LEFT JOIN e ON e.cell_id = p.cell_id")
_add("c6_bins", lambda k, d: containers.target_bins(table(k, d, "loci"), table(k, d, "genome"), COARSE), "SELECT locus, chrom, CASE WHEN end_bp - origin_bp <= (floor((start_bp - origin_bp) / 1000000) + 1) * 1000000 THEN CAST(floor((start_bp - origin_bp) / 1000000) AS INTEGER) END AS bin FROM loci JOIN genome USING (chrom)")
_add("d8_sisters_by_state", lambda k, d: traces.sister_summary(_spots(k, d), _cells(k, d).select("cell_id", "state")).select("state", "n", *_r("mean", "most")),
     f"WITH {_S}, {_C}, q AS (SELECT a.cell_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS dist FROM s a JOIN s b ON a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.trace_id = b.trace_id AND a.start_bp = b.start_bp AND a.row_id < b.row_id), u AS (SELECT state, dist FROM q JOIN c USING (cell_id) WHERE state IS NOT NULL UNION ALL SELECT 'all', dist FROM q) SELECT state, count(*) AS n, round(avg(dist), 6) AS mean, round(max(dist), 6) AS most FROM u GROUP BY 1")
_add("d10_projected_spots", lambda k, d: traces.projected_spots(_spots(k, d).where("end_bp IS NOT NULL"), None).select("cell_id", "chrom", "trace_id", "start_bp", "spot_id", *_r("x", "y", "z")),
     f"WITH {_S}, m AS (SELECT cell_id, chrom, trace_id, start_bp, end_bp, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM s WHERE end_bp IS NOT NULL GROUP BY ALL) SELECT cell_id, chrom, trace_id, start_bp, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY chrom, trace_id, start_bp, end_bp) AS VARCHAR) AS spot_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM m")
_COARSE = "g AS (SELECT cell_id, chrom, CAST(locus // 10 AS INTEGER) AS locus, copy_no, avg(value) AS value FROM m GROUP BY ALL)"
_PROFILE = "chrom, locus, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n, round(stddev_pop(v) / sqrt(count(v)), 6) AS sem"
_add("d12_by_radius", lambda k, d: matrices.normalised_profile(_cube(k, d).drop("state"), _cells(k, d), "radius", "S", 10).select("chrom", "locus", *_r("mean", "std"), "n", *_r("sem")), f"WITH {_M}, {_C}, {_COARSE} SELECT {_PROFILE.replace('(v)', '(value / power(0.75 / pi() * volume, 1.0 / 3))')} FROM g JOIN c USING (cell_id) WHERE c.state = 'S' GROUP BY 1, 2")
_add("d12_by_zscore", lambda k, d: matrices.normalised_profile(_cube(k, d).drop("state"), _cells(k, d), "zscore", None, 10).select("chrom", "locus", *_r("mean", "std"), "n", *_r("sem")), f"WITH {_M}, {_COARSE}, h AS (SELECT chrom, locus, CASE WHEN stddev_pop(value) OVER (PARTITION BY cell_id) > 0 THEN (value - avg(value) OVER (PARTITION BY cell_id)) / stddev_pop(value) OVER (PARTITION BY cell_id) END AS v FROM g) SELECT {_PROFILE} FROM h GROUP BY 1, 2")
for _m, _sql in (("sum", "coalesce(sum(value), 0.0)"), ("consensus", "CASE WHEN coalesce(sum(value), 0.0) > count(*) / 2 THEN 1.0 ELSE 0.0 END")):
    _add(f"d13_{_m}", lambda k, d, m=_m: matrices.coarse_grain(_cube(k, d), 10, m).withColumn("value", F.round("value", 6)), f"WITH {_M} SELECT cell_id, chrom, CAST(locus // 10 AS INTEGER) AS coarse, copy_no, round({_sql}, 6) AS value FROM m GROUP BY ALL")
for _m, _sql in (("median", "median(value)"), ("sum", "coalesce(sum(value), 0.0)")):
    _add(f"e4_sliding_{_m}", lambda k, d, m=_m: matrices.sliding(_cube(k, d), 10, m).select(*_CUBE, *_r("slid")), f"WITH {_M} SELECT a.cell_id, a.chrom, a.locus, a.copy_no, round({_sql.replace('value', 'b.value')}, 6) AS slid FROM m a JOIN m b ON a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.copy_no = b.copy_no AND b.locus BETWEEN a.locus - 5 AND a.locus + 5 GROUP BY ALL")
_add("e8_z_score_by_locus", lambda k, d: matrices.z_scores(_cube(k, d), ["state", "locus"]).select(*_CUBE, *_r("zscore")), f"WITH {_M} SELECT cell_id, chrom, locus, copy_no, round(CASE WHEN stddev_pop(value) OVER w > 1e-12 * (1 + abs(avg(value) OVER w)) THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS zscore FROM m WINDOW w AS (PARTITION BY state, locus)")
_add("e10_slices", lambda k, d: matrices.sliced(_spots(k, d), ["cell_id"], "z", 4).select("row_id", "slice"), f"WITH {_S}, e AS (SELECT cell_id, quantile_cont(z, [0.25, 0.5, 0.75]) AS q FROM s GROUP BY 1) SELECT row_id, CAST(z > q[1] AS INTEGER) + CAST(z > q[2] AS INTEGER) + CAST(z > q[3] AS INTEGER) AS slice FROM s JOIN e USING (cell_id)")
_add("h2_clipped", lambda k, d: table(k, d, "sc_repliseq").select("sample_id", matrices.clipped(F.col("rt"), -1.0, 1.0).alias("rt")), "SELECT sample_id, CASE WHEN CAST(rt AS VARCHAR) NOT IN ('nan', 'inf', '-inf') THEN greatest(-1.0, least(1.0, rt)) END AS rt FROM sc_repliseq")
_add("h3_radius", lambda k, d: _cells(k, d).where("volume IS NOT NULL").select("cell_id", F.round(matrices.effective_radius(F.col("volume")), 6).alias("radius")), f"WITH {_C} SELECT cell_id, round(power(0.75 / pi() * volume, 1.0 / 3), 6) AS radius FROM c WHERE volume IS NOT NULL")
_add("h12_voxels", lambda k, d: containers.voxels(_spots(k, d), 0.2), f"WITH {_S} SELECT row_id, " + ", ".join(f"CAST(round_even({c} / 0.2, 0) AS INTEGER) AS i{c}" for c in "xyz") + " FROM s")


# Replication and phases
def _phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.per_cell(_counts(spark, sf_dir).drop("state"), _cells(spark, sf_dir), LEAST_VOLUME, WINDOW_CELLS)


_PC = f"""{_E6}, a AS (SELECT avg({_OWN}) FILTER (state = 'G1') AS e1, avg({_OWN}) FILTER (state = 'G2') AS e2, avg(volume) FILTER (state = 'G1') AS v1, avg(volume) FILTER (state = 'G2') AS v2 FROM pm WHERE volume > 400), e AS (SELECT pm.*, coalesce({_OWN}, e1 + (e2 - e1) * greatest(0.0, least(1.0, (volume - v1) / (v2 - v1)))) AS eps FROM pm, a), sv AS (SELECT *, CASE WHEN eps * (1 - eps) <> 0 THEN (1 - eps - f) / (eps * (1 - eps)) END AS p FROM e), pc AS (SELECT cell_id, state, volume, eps, round({_CLIP.format('p')}, 9) AS p FROM sv)"""
_rounded = lambda k, d: _phased(k, d).withColumn("p", F.round("p", 9))
_add("b9_stage", lambda k, d: cycle.masked(cycle.stage(_counts(k, d), _rounded(k, d), 0.05, 0.95), F.lit(True)).select("nsamples", *_r("n", "f")), f"WITH {_PC} SELECT count(value) AS nsamples, round(avg(value), 6) AS n, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 6) AS f FROM n JOIN pc USING (cell_id) WHERE pc.state = 'S' AND p > 0.05 AND p < 0.95 HAVING count(*) > 0")
_add("e11_phase_intervals", lambda k, d: cycle.phase_intervals(_rounded(k, d), 4).select("part", *_r("lo", "hi")), f"WITH {_PC}, q AS (SELECT quantile_cont(p, [0, 0.25, 0.5, 0.75, 1]) AS q FROM pc WHERE state = 'S') SELECT CAST(k AS INTEGER) AS part, round(q[k + 1], 6) AS lo, round(q[k + 2], 6) AS hi FROM q, range(4) r(k) WHERE q IS NOT NULL")
_add("f3_by_phase", lambda k, d: cycle.by_phase(_rounded(k, d)).select("cell_id", "place"), f"WITH {_PC} SELECT cell_id, row_number() OVER (ORDER BY CASE state WHEN 'G1' THEN 0 WHEN 'S' THEN 1 ELSE 2 END, CASE WHEN state = 'S' THEN p ELSE volume END NULLS LAST, cell_id) AS place FROM pc WHERE state IS NOT NULL")
_add("f7_latest_s_cells", lambda k, d: _rounded(k, d).where("state = 'S' AND p IS NOT NULL").orderBy(F.desc("p"), "cell_id").limit(10).select("cell_id", *_r("p")), f"WITH {_PC} SELECT cell_id, round(p, 6) AS p FROM pc WHERE state = 'S' AND p IS NOT NULL ORDER BY pc.p DESC, cell_id LIMIT 10")
QUERIES["l8_bootstrap"] = lambda k, d: cycle.bootstrap(_counts(k, d), _phased(k, d), ~F.col("chrom").isin("chrX", "chrY"), 5, LEAST_VOLUME)
_RTS = "hm2 AS (SELECT cellids AS cell_id, chrom, locus, copy_no, avg(CASE WHEN CAST({0} AS VARCHAR) <> 'nan' THEN {0} END) AS value FROM sc_repliseq WHERE trim(cellids) <> '' GROUP BY 1, 2, 3, 4)"


def _matrix(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    m = table(spark, sf_dir, "sc_repliseq").where(F.trim("cellids") != "")
    return m.groupBy(F.col("cellids").alias("cell_id"), "chrom", "locus", "copy_no").agg(F.avg(F.when(~F.isnan(column), F.col(column))).alias("value"))


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "sc_repliseq").where(F.trim("cellids") != "")
    locales = m.groupBy(F.col("cellids").alias("cell_id"), "chrom", "locus", "copy_no").agg(F.max(F.when(F.col("locale_no") >= 0, F.col("locale_no"))).alias("value"))
    out = matrices.feature_rows({"rt": _matrix(spark, sf_dir, "rt"), "z": _matrix(spark, sf_dir, "z")}, locales, [0, 1, 2], 4, 5)
    return out.select(*_CUBE, *_r("rt", "z", "locale_0", "locale_1", "locale_2"))


_SLID = lambda c: f"avg({c}) OVER (PARTITION BY cell_id, chrom, copy_no ORDER BY locus RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_Q5 = lambda v: f"CASE WHEN {v} IS NOT NULL THEN CAST({v} >= q_{v}[1] AS INTEGER) + CAST({v} >= q_{v}[2] AS INTEGER) + CAST({v} >= q_{v}[3] AS INTEGER) + CAST({v} >= q_{v}[4] AS INTEGER) END"
_add("l19_feature_rows", _feature_rows, f"""WITH g AS (SELECT cellids AS cell_id, chrom, locus, copy_no, avg(CASE WHEN CAST(rt AS VARCHAR) <> 'nan' THEN rt END) AS rt, avg(CASE WHEN CAST(z AS VARCHAR) <> 'nan' THEN z END) AS z, coalesce(max(CASE WHEN locale_no >= 0 THEN locale_no END), -1) AS l FROM sc_repliseq WHERE trim(cellids) <> '' GROUP BY 1, 2, 3, 4),
 e AS (SELECT cell_id, quantile_cont(rt, [0.2, 0.4, 0.6, 0.8]) AS q_rt, quantile_cont(z, [0.2, 0.4, 0.6, 0.8]) AS q_z FROM g GROUP BY 1), h AS (SELECT g.cell_id, chrom, locus, copy_no, {_Q5('rt')} AS rt, {_Q5('z')} AS z, l FROM g JOIN e USING (cell_id) WHERE q_rt IS NOT NULL AND q_z IS NOT NULL),
 w AS (SELECT cell_id, chrom, locus, copy_no, round({_SLID('rt')}, 6) AS rt, round({_SLID('z')}, 6) AS z, {', '.join('round(' + _SLID(f'CASE WHEN l = {k} THEN 1.0 ELSE 0.0 END') + f', 6) AS locale_{k}' for k in range(3))} FROM h) SELECT * FROM w WHERE rt IS NOT NULL AND z IS NOT NULL""")
QUERIES["l21_predicted"] = lambda k, d: _classifier_rows(k, d).where("state = 'S'").groupBy("cell_id", "chrom", "locus", "copy_no").agg(F.avg("probability").alias("p"))
QUERIES["l23_differential"] = lambda k, d: replication.differential(_cube(k, d).withColumn("blk", F.floor(F.col("locus") / 20).cast("int")), "state", "G1", "S", ["chrom", "blk"])
_add("l23_shifted_regions", lambda k, d: replication.shifted_regions(_matrix(k, d, "z").join(_cube(k, d).select(*_CUBE, "state"), _CUBE), "state", "G1", "S", 0.1).select("chrom", "locus", *_r("ratio"), "sign"),
     f"WITH {_M}, {_RTS.format('z')}, r0 AS (SELECT chrom, locus, avg(CASE WHEN m.state = 'G1' THEN h.value END) AS ma, avg(CASE WHEN m.state = 'S' THEN h.value END) AS mb FROM hm2 h JOIN m USING (cell_id, chrom, locus, copy_no) GROUP BY 1, 2), r AS (SELECT chrom, locus, CASE WHEN ma > 0 AND mb > 0 THEN log2(ma / mb) END AS ratio FROM r0), e AS (SELECT quantile_cont(ratio, [0.1, 0.9]) AS q FROM r) SELECT chrom, locus, round(ratio, 6) AS ratio, CASE WHEN ratio >= q[2] THEN 1 WHEN ratio <= q[1] THEN -1 ELSE 0 END AS sign FROM r, e")
_FQ = f"{_N.replace('n AS (SELECT cell_id', 'n0 AS (SELECT cell_id')}, {_FILLED}, e AS (SELECT cell_id, quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM hf GROUP BY 1), n AS (SELECT chrom, n0.locus, CAST(hf.value >= e[1] AS INTEGER) + CAST(hf.value >= e[2] AS INTEGER) + CAST(hf.value >= e[3] AS INTEGER) AS q, state, n0.value FROM n0 JOIN hf USING (cell_id, locus, copy) JOIN e USING (cell_id) WHERE hf.value IS NOT NULL)"
_add("l25a_locus_and_quantile", lambda k, d: replication.by_group(_feature_counts(k, d).where("state IS NOT NULL AND q IS NOT NULL"), ["chrom", "locus", "q"]).select("chrom", "locus", "q", *_r("n", "f", "eps", "p")),
     f"WITH {_FQ}, a AS (SELECT chrom, locus, q, state, {_MOM} FROM n WHERE state IS NOT NULL GROUP BY ALL), w AS (SELECT chrom, locus, q, avg({_OWN}) AS es FROM a GROUP BY ALL) SELECT chrom, locus, q, round(n, 6) AS n, round(f, 6) AS f, round(es, 6) AS eps, round({_CLIP.format('CASE WHEN es * (1 - es) <> 0 THEN (1 - es - f) / (es * (1 - es)) END')}, 6) AS p FROM a JOIN w USING (chrom, locus, q) WHERE state = 'S'")
_by_locus = lambda k, d: replication.by_group(_counts(k, d).where("state IS NOT NULL"), ["chrom", "locus"])
_LOCI = _REF["l5_loci"].replace("round(n, 6)", "n").replace("round(f, 6)", "f").replace("round(es, 6)", "es")
_add("l25d_quality", lambda k, d: cycle.good_loci(_by_locus(k, d), 10, 0.85, 0.15).select("chrom", "locus", *_r("f", "eps"), "good"), f"WITH b AS ({_LOCI}), w AS (SELECT chrom, locus, avg(f) OVER v AS f, avg(eps) OVER v AS eps FROM b WINDOW v AS (PARTITION BY chrom ORDER BY locus RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT chrom, locus, round(f, 6) AS f, round(eps, 6) AS eps, coalesce(f < 0.85 AND eps > 0.15, false) AS good FROM w")
_add("l25i_sliding_probability", lambda k, d: cycle.sliding_probability(_by_locus(k, d).withColumn("beta", F.try_divide("n", (1 + F.col("p")) * F.col("eps"))), 10).select("chrom", "locus", *_r("p")), f"WITH b0 AS ({_LOCI.replace(', 6) AS p', ', 99) AS p')}), b AS (SELECT *, CASE WHEN (1 + p) * eps <> 0 THEN n / ((1 + p) * eps) END AS beta FROM b0), w AS (SELECT chrom, locus, avg(n) OVER v AS n, avg(eps) OVER v AS eps, avg(beta) OVER v AS beta FROM b WINDOW v AS (PARTITION BY chrom ORDER BY locus RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT chrom, locus, round(CASE WHEN eps * beta <> 0 THEN n / (eps * beta) - 1 END, 6) AS p FROM w")
_add("e9_by_volume", lambda k, d: matrices.normalised_by_cell(_cube(k, d), _cells(k, d).select("cell_id", F.col("volume").alias("scalar"))).select(*_CUBE, *_r("norm")), f"WITH {_M}, {_C} SELECT m.cell_id, chrom, locus, copy_no, round(CASE WHEN volume <> 0 THEN value / volume END, 6) AS norm FROM m LEFT JOIN c ON c.cell_id = m.cell_id")


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = replication.moments(_counts(spark, sf_dir).where("state = 'S'"), ["chrom"])
    known_p, known_beta = replication.solve_known_p(F.col("n"), F.col("f"), F.lit(0.5)), replication.solve_known_beta(F.col("n"), F.col("f"), F.lit(0.9))
    return m.select("chrom", *[F.round(c, 6).alias(n) for n, c in (("eps_of_p", known_p["eps"]), ("beta_of_p", known_p["beta"]), ("eps_of_beta", known_beta["eps"]), ("p_of_beta", known_beta["p"]))])


_add("l1_solved", _solved, f"""WITH {_N}, w AS (SELECT chrom, {_MOM} FROM n WHERE state = 'S' GROUP BY 1), x AS (SELECT chrom, n, f, 2.25 - 2 * (1 - f) AS y, n / 0.9 AS d, 1 - 4 * (f + n / 0.9 - 1) / ((n / 0.9) * (n / 0.9)) AS x FROM w),
 z AS (SELECT chrom, n, d, x, CASE WHEN y >= 0 THEN 1.5 - sqrt(y) END AS ep, CASE WHEN x < 0 THEN 1 - sqrt(f) ELSE d / 2 * (1 + sqrt(x)) END AS eb FROM x) SELECT chrom, round(ep, 6) AS eps_of_p, round(n / (1.5 * ep), 6) AS beta_of_p, round(eb, 6) AS eps_of_beta, round(CASE WHEN x < 0 THEN 1 ELSE d / eb - 1 END, 6) AS p_of_beta FROM z""")
_NQ = f"{_PC}, {_FILLED}, ed AS (SELECT cell_id, quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM hf GROUP BY 1), nq0 AS (SELECT n.cell_id, n.chrom, CAST(hf.value >= e[1] AS INTEGER) + CAST(hf.value >= e[2] AS INTEGER) + CAST(hf.value >= e[3] AS INTEGER) AS q, n.state, n.value FROM n JOIN hf USING (cell_id, locus, copy) JOIN ed USING (cell_id) WHERE hf.value IS NOT NULL AND chrom NOT IN ('chrX', 'chrY') AND n.state IS NOT NULL)"
_MEANS = "avg(value) AS n, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS f"
_BQ = f"aq AS (SELECT q, state, {_MEANS} FROM nq GROUP BY 1, 2), gq AS (SELECT q, avg({_OWN}) AS es FROM aq GROUP BY 1), wq AS (SELECT state, {_MEANS} FROM nq GROUP BY 1), ws AS (SELECT avg({_OWN}) AS es FROM wq), ps AS (SELECT greatest(0.0, least(1.0, (1 - es - f) / (es * (1 - es)))) AS p FROM wq, ws WHERE state = 'S'), rq AS (SELECT q, n, f, es, greatest(0.0, least(1.0, (1 - es - f) / (es * (1 - es)))) AS p FROM aq JOIN gq USING (q) WHERE state = 'S'), pq AS (SELECT q, n, f, es, rq.p + ps.p - (SELECT avg(p) FROM rq) AS p FROM rq, ps)"


def _quantised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as moments of states, quantiles and cells all read it."""
    return cut_lineage(cycle.without_sex_chromosomes(_feature_counts(spark, sf_dir)).where("state IS NOT NULL AND q IS NOT NULL"))


def _stage_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _quantised_counts(spark, sf_dir)
    kept = counts.where("state <> 'S'").unionByName(cycle.stage(counts, _rounded(spark, sf_dir), 0.0, 1.0))
    return cycle.by_quantile(cut_lineage(kept), "q").select("q", *_r("n", "f", "eps", "p"))


_add("l24_stage_and_quantile", _stage_quantiles,
     f"WITH {_NQ}, nq AS (SELECT nq0.* FROM nq0 LEFT JOIN pc USING (cell_id) WHERE nq0.state <> 'S' OR (pc.state = 'S' AND p > 0 AND p < 1)), {_BQ} SELECT q, round(n, 6) AS n, round(f, 6) AS f, round(es, 6) AS eps, round(p, 6) AS p FROM pq")
_add("l25b_cell_and_quantile", lambda k, d: cycle.by_cell_and_quantile(_quantised_counts(k, d), "q", _rounded(k, d)).select("cell_id", "q", "nsamples", *_r("n", "f", "p", "eps", "beta")),
     f"WITH {_NQ}, nq AS (SELECT * FROM nq0), {_BQ}, mc AS (SELECT cell_id, q, count(value) AS ns, {_MEANS} FROM nq GROUP BY 1, 2), jc AS (SELECT mc.cell_id, mc.q, ns, mc.n, mc.f, CASE WHEN pc.p IS NOT NULL AND pq.p IS NOT NULL AND (SELECT avg(p) FROM pq) <> 0 THEN greatest(0.0, least(1.0, pc.p * pq.p / (SELECT avg(p) FROM pq))) END AS p FROM mc JOIN pq ON pq.q = mc.q JOIN pc ON pc.cell_id = mc.cell_id), ec AS (SELECT *, CASE WHEN p = 0 THEN 1 - f WHEN (1 + p) * (1 + p) - 4 * p * (1 - f) >= 0 THEN (1 + p - sqrt((1 + p) * (1 + p) - 4 * p * (1 - f))) / (2 * p) END AS eps FROM jc) SELECT cell_id, q, ns AS nsamples, round(n, 6) AS n, round(f, 6) AS f, round(p, 6) AS p, round(eps, 6) AS eps, round(CASE WHEN (1 + p) * eps <> 0 THEN n / ((1 + p) * eps) END, 6) AS beta FROM ec")
