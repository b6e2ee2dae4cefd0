"""More queries of the analysis operators: neighbours, bodies, maps of contacts, cell cycle, exports, streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.model import clean_state
from nucleoframe.operators import cycle, features, matrices, nearest, pairwise, tracing
from nucleoframe.plans.reference import _C, _CT, _M, _N, _PLACED, _S, COARSE, RADIUS, _cells, _controlled, _counts, _cube, _means, _of_loci, _r, _spots
from nucleoframe.session import cut_lineage, shared_checkpoint_dir, table
from nucleoframe.sources import markers
from nucleoframe.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WINDOW_CELLS, LEAST_VOLUME, PARTS, BLOCK = 20, 400.0, 100, 20
EARLY, LATE = 0.05, 0.95
THRESHOLDS = [0.1, 0.25, 0.5, 0.75, 0.9]
_CLIP = "CASE WHEN {0} IS NOT NULL THEN greatest(0.0, least(1.0, {0})) END"
_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_SAFE = "CASE WHEN {1} <> 0 THEN {0} / {1} END"


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = make, sql


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("length_bp") / 2)
    g = table(spark, sf_dir, "genome").select("chrom", F.inline(F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), half.alias("hi"), F.lit("front").alias("track")), F.struct(half.alias("lo"), F.col("length_bp").alias("hi"), F.lit("back").alias("track")))))
    return g


# Neighbours and bodies
_add("j10_closest", lambda k, d: _means(k, d, nearest.closest(_spots(k, d), 5)),
     _of_loci(f"SELECT row_id, list_avg(ds) AS value FROM (SELECT a.row_id, min(sqrt{_D2}, 5) AS ds FROM s a JOIN s b ON a.cell_id = b.cell_id AND a.row_id <> b.row_id AND {_D2} > 0 GROUP BY 1)"))
_add("k15_composition", lambda k, d: nearest.composition(_spots(k, d), _tracks(k, d), [5, 25]).select("track", "near_track", "k", "n_spots", *_r("raw", "copies")),
     f"""WITH {_S}, t AS (SELECT chrom, 0 AS lo, length_bp // 2 AS hi, 'front' AS track FROM genome UNION ALL SELECT chrom, length_bp // 2, length_bp, 'back' FROM genome), q AS (SELECT row_id, s.chrom, trace_id, track FROM s JOIN t ON s.chrom = t.chrom AND start_bp >= lo AND start_bp < hi),
 n AS (SELECT a.row_id, unnest(min(struct_pack(d := {_D2}, near_id := b.row_id), 25)) AS e, unnest(range(1, 26)) AS r FROM s a JOIN s b ON a.cell_id = b.cell_id AND a.row_id <> b.row_id GROUP BY 1), k AS (SELECT unnest([5, 25]) AS k),
 h AS (SELECT n.row_id, a.track, b.track AS near_track, k.k, count(*) AS raw, count(DISTINCT (b.chrom, b.trace_id)) AS copies FROM n JOIN q a ON a.row_id = n.row_id JOIN q b ON b.row_id = n.e.near_id JOIN k ON n.r <= k.k WHERE a.chrom <> b.chrom OR a.trace_id <> b.trace_id GROUP BY ALL), z AS (SELECT track, count(*) AS n_spots FROM q GROUP BY 1)
 SELECT h.track, near_track, CAST(k AS INTEGER) AS k, n_spots, round(sum(raw) / n_spots, 6) AS raw, round(sum(copies) / n_spots, 6) AS copies FROM h JOIN z ON h.track = z.track GROUP BY h.track, near_track, k, n_spots""")
SWEEP = [25, 50, 100, 250, 500]
_add("k15_sweep", lambda k, d: nearest.composition(_spots(k, d), _tracks(k, d), SWEEP).select("track", "near_track", "k", "n_spots", *_r("raw", "copies")),
     ORACLES["k15_composition"].replace("[5, 25]", str(SWEEP)).replace("row_id), 25)", "row_id), 500)").replace("range(1, 26)", "range(1, 501)"))
_add("j5_bodies", lambda k, d: features.placed(_spots(k, d), table(k, d, "loci")).select("cell_id", "locus", "copy", "row_id").join(features.body_distance(_spots(k, d), table(k, d, "bodies"), 1.0), "row_id").groupBy("cell_id", "locus", "copy").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("closest", "tsa")]),
     f"WITH {_PLACED}, q AS (SELECT row_id, sqrt(power(greatest(x_lo - x, x - x_hi, 0), 2) + power(greatest(y_lo - y, y - y_hi, 0), 2) + power(greatest(z_lo - z, z - z_hi, 0), 2)) AS d FROM s JOIN bodies USING (cell_id) WHERE x_lo IS NOT NULL AND x_hi IS NOT NULL AND y_lo IS NOT NULL AND y_hi IS NOT NULL AND z_lo IS NOT NULL AND z_hi IS NOT NULL), u AS (SELECT row_id, min(d) AS closest, avg(exp(-d)) AS tsa FROM q GROUP BY 1) SELECT cell_id, locus, copy, round(avg(closest), 6) AS closest, round(avg(tsa), 6) AS tsa FROM p JOIN u USING (row_id) GROUP BY ALL")
_V = f"{_PLACED}, {_M}, v AS (SELECT p.row_id, p.cell_id, p.x, p.y, p.z, m.value FROM p LEFT JOIN m ON m.cell_id = p.cell_id AND m.locus = p.locus AND m.copy_no = p.copy)"
_add("c3_feature_of_spots", lambda k, d: features.of_spots(_spots(k, d), table(k, d, "loci"), _cube(k, d)).select("row_id", *_r("value")), f"WITH {_V} SELECT row_id, round(value, 6) AS value FROM v")
_add("j19_smoothed_in_space", lambda k, d: _means(k, d, features.smoothed_in_space(features.of_spots(_spots(k, d), table(k, d, "loci"), _cube(k, d)), RADIUS)),
     f"WITH {_V}, w AS (SELECT a.row_id, avg(b.value) AS value FROM v a JOIN v b ON a.cell_id = b.cell_id AND (a.row_id = b.row_id OR sqrt{_D2} < 0.6) GROUP BY 1) SELECT p.cell_id, locus, copy, round(avg(w.value), 6) AS value FROM p JOIN w USING (row_id) GROUP BY ALL")

# Maps of contacts
_add("k9_inter_contacts", lambda k, d: pairwise.inter_contacts(_spots(k, d), _cells(k, d).select("cell_id", "state"), COARSE, RADIUS).select("state", "chrom1", "bin1", "chrom2", "bin2", "n", "c", *_r("f")),
     f"WITH {_S}, {_C}, q AS (SELECT c.state, a.chrom AS chrom1, CAST(a.start_bp // 1000000 AS INTEGER) AS bin1, b.chrom AS chrom2, CAST(b.start_bp // 1000000 AS INTEGER) AS bin2, count(*) AS n, count_if(sqrt{_D2} <= 0.6) AS c FROM s a JOIN s b ON a.cell_id = b.cell_id AND a.chrom < b.chrom JOIN c ON c.cell_id = a.cell_id GROUP BY ALL), u AS (SELECT * FROM q WHERE state IS NOT NULL UNION ALL SELECT 'all', chrom1, bin1, chrom2, bin2, n, c FROM q) SELECT state, chrom1, bin1, chrom2, bin2, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c, round(sum(c) / sum(n), 6) AS f FROM u GROUP BY ALL".replace("GROUP BY ALL)", "GROUP BY 1, 2, 3, 4, 5)"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.intra_contacts(_spots(spark, sf_dir), _cells(spark, sf_dir).select("cell_id", "state"), COARSE, RADIUS)


_add("k13_rescaled", lambda k, d: pairwise.rescaled(_maps(k, d)).select("state", "chrom", "bin1", "bin2", "nsamples", F.round("f", 9).alias("f"), *_r("f_var")),
     f"WITH {_CT}, r AS (SELECT state, (SELECT avg(f) FROM f WHERE state = 'all') / avg(f) AS r FROM f GROUP BY 1 HAVING avg(f) <> 0) SELECT f.state, chrom, bin1, bin2, nsamples, round(f * r, 9) AS f, round(f_var * r * r, 6) + 0.0 AS f_var FROM f LEFT JOIN r ON r.state = f.state")
_add("l11_adjusted_correlation", lambda k, d: pairwise.adjusted_correlation(_maps(k, d), "G1", "S", 20).select(*_r("r"), "n_distances"),
     f"WITH {_CT}, y AS (SELECT count(*) AS n, CASE WHEN stddev_pop(a.f) > 0 AND stddev_pop(b.f) > 0 THEN corr(a.f, b.f) END AS r FROM f a JOIN f b USING (chrom, bin1, bin2) WHERE a.state = 'G1' AND b.state = 'S' GROUP BY bin2 - bin1) SELECT round(avg(r), 6) AS r, count(*) AS n_distances FROM y WHERE n >= 20 AND r IS NOT NULL")
QUERIES["k12_compartments"] = lambda k, d: pairwise.compartments(_controlled(k, d), _spots(k, d).groupBy("chrom", F.floor(F.col("start_bp") / COARSE).cast("int").alias("bin")).agg(F.avg("lum").alias("density")))

# Cell cycle
_E6 = f"{_N}, per AS (SELECT cell_id, count(value) AS ns, sum(value) AS s, count_if(value = 0) AS z FROM n GROUP BY 1), pv AS (SELECT cell_id, state, volume, row_number() OVER (ORDER BY volume, cell_id) AS r, sum(ns) OVER w AS ns, sum(s) OVER w AS s, sum(z) OVER w AS z FROM c JOIN per USING (cell_id) WHERE volume IS NOT NULL WINDOW w AS (ORDER BY volume, cell_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)), pm AS (SELECT cell_id, state, volume, r, CAST(ns AS BIGINT) AS nsamples, {_SAFE.format('s', 'ns')} AS n, {_SAFE.format('z', 'ns')} AS f FROM pv)"
_add("e6_pooled_by_volume", lambda k, d: cycle.pooled_by_volume(_counts(k, d).drop("state"), _cells(k, d), WINDOW_CELLS).select("cell_id", "r", "nsamples", *_r("n", "f")), f"WITH {_E6} SELECT cell_id, r, nsamples, round(n, 6) AS n, round(f, 6) AS f FROM pm")
_OWN = "CASE state WHEN 'G1' THEN 1 - f WHEN 'G2' THEN 1 - sqrt(f) END"
_add("l6_per_cell", lambda k, d: cycle.per_cell(_counts(k, d).drop("state"), _cells(k, d), LEAST_VOLUME, WINDOW_CELLS).select("cell_id", "state", "nsamples", *_r("n", "f", "eps", "p", "beta")),
     f"WITH {_E6}, a AS (SELECT avg({_OWN}) FILTER (state = 'G1') AS e1, avg({_OWN}) FILTER (state = 'G2') AS e2, avg(volume) FILTER (state = 'G1') AS v1, avg(volume) FILTER (state = 'G2') AS v2 FROM pm WHERE volume > 400), e AS (SELECT pm.*, coalesce({_OWN}, e1 + (e2 - e1) * greatest(0.0, least(1.0, (volume - v1) / (v2 - v1)))) AS eps FROM pm, a), sv AS (SELECT *, CASE WHEN eps * (1 - eps) <> 0 THEN (1 - eps - f) / (eps * (1 - eps)) END AS p FROM e) SELECT cell_id, state, nsamples, round(n, 6) AS n, round(f, 6) AS f, round(eps, 6) AS eps, round({_CLIP.format('p')}, 6) AS p, round(CASE WHEN (1 + p) * eps <> 0 THEN n / ((1 + p) * eps) END, 6) AS beta FROM sv")


def _feature_counts(spark: SparkSession, sf_dir: str, quantiles: int = 4) -> DataFrame:
    """Spot counts with the quantile, in its cell, of a feature of their locus: the height, interpolated where there is no spot."""
    spots, loci = _spots(spark, sf_dir), table(spark, sf_dir, "loci")
    height = features.height(spots, loci).withColumnRenamed("copy", "copy_no")
    whole = features.grid(spots, loci).withColumnRenamed("copy", "copy_no").join(height, ["cell_id", "locus", "copy_no"], "left")
    filled = matrices.interpolated(whole).select("cell_id", "chrom", "locus", "copy_no", F.round("filled", 9).alias("value"))
    q = matrices.quantised(filled, quantiles).select("cell_id", "locus", F.col("copy_no").alias("copy"), "q")
    return cut_lineage(_counts(spark, sf_dir).join(q, ["cell_id", "locus", "copy"]))


_FILLED = "hm AS (SELECT g.cell_id, g.chrom, g.locus, g.copy, avg(p.z) AS value FROM gr g LEFT JOIN p ON p.cell_id = g.cell_id AND p.locus = g.locus AND p.copy = g.copy GROUP BY ALL), ha AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN locus END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, min(CASE WHEN value IS NOT NULL THEN locus END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM hm WINDOW w AS (PARTITION BY cell_id, chrom, copy ORDER BY locus)), hf AS (SELECT a.cell_id, a.locus, a.copy, round(coalesce(a.value, x.value + (y.value - x.value) * ((a.locus - a.l) / (a.r - a.l)), x.value, y.value), 9) AS value FROM ha a LEFT JOIN hm x ON x.cell_id = a.cell_id AND x.chrom = a.chrom AND x.copy = a.copy AND x.locus = a.l LEFT JOIN hm y ON y.cell_id = a.cell_id AND y.chrom = a.chrom AND y.copy = a.copy AND y.locus = a.r)"
_ZQ = f"{_N.replace('n AS (SELECT cell_id', 'n0 AS (SELECT cell_id')}, {_FILLED}, e AS (SELECT cell_id, quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM hf GROUP BY 1), n AS (SELECT CAST(hf.value >= e[1] AS INTEGER) + CAST(hf.value >= e[2] AS INTEGER) + CAST(hf.value >= e[3] AS INTEGER) AS q, state, n0.value FROM n0 JOIN hf USING (cell_id, locus, copy) JOIN e USING (cell_id) WHERE hf.value IS NOT NULL AND chrom NOT IN ('chrX', 'chrY'))"
_MOM = "avg(value) AS n, avg(CASE WHEN value IS NULL THEN NULL WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS f"
_add("l4_by_quantile", lambda k, d: cycle.by_quantile(cycle.without_sex_chromosomes(_feature_counts(k, d)).where("state IS NOT NULL"), "q").select("q", *_r("n", "f", "eps", "p")),
     f"WITH {_ZQ}, a AS (SELECT q, state, {_MOM} FROM n WHERE state IS NOT NULL GROUP BY 1, 2), g AS (SELECT q, avg({_OWN}) AS es FROM a GROUP BY 1), w AS (SELECT state, {_MOM} FROM n WHERE state IS NOT NULL GROUP BY 1), ws AS (SELECT avg({_OWN}) AS es FROM w), ps AS (SELECT greatest(0.0, least(1.0, (1 - es - f) / (es * (1 - es)))) AS p FROM w, ws WHERE state = 'S'), r AS (SELECT q, n, f, es, greatest(0.0, least(1.0, (1 - es - f) / (es * (1 - es)))) AS p FROM a JOIN g USING (q) WHERE state = 'S') SELECT q, round(n, 6) AS n, round(f, 6) AS f, round(es, 6) AS eps, round(r.p + ps.p - (SELECT avg(p) FROM r), 6) AS p FROM r, ps")
_add("l4_by_twentieth", lambda k, d: cycle.by_quantile(cycle.without_sex_chromosomes(_feature_counts(k, d, 20)).where("state IS NOT NULL"), "q").select("q", *_r("n", "f", "eps", "p")),
     ORACLES["l4_by_quantile"].replace("[0.25, 0.5, 0.75]", str([q / 20 for q in range(1, 20)])).replace("CAST(hf.value >= e[1] AS INTEGER) + CAST(hf.value >= e[2] AS INTEGER) + CAST(hf.value >= e[3] AS INTEGER)", " + ".join(f"CAST(hf.value >= e[{q}] AS INTEGER)" for q in range(1, 20))))
_add("l7_masked", lambda k, d: cycle.masked(_counts(k, d), (F.col("chrom") == "chr1") & (F.col("state").isNotNull())).select("state", "nsamples", *_r("n", "n_var", "f")),
     f"WITH {_N} SELECT state, count(value) AS nsamples, round(avg(value), 6) AS n, round(var_samp(value) / count(value), 6) AS n_var, round(avg(CASE WHEN value = 0 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), 6) AS f FROM n WHERE chrom = 'chr1' AND state IS NOT NULL GROUP BY 1")
_add("l10_biased_timing", lambda k, d: cycle.biased_timing(_counts(k, d)).select("chrom", "locus", *_r("rt")), f"WITH {_N} SELECT chrom, locus, round(CASE WHEN avg(value) <> 0 THEN sum(CASE WHEN state = 'S' THEN value END) / avg(value) END, 6) AS rt FROM n GROUP BY 1, 2")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sc_repliseq").groupBy("chrom", "locus").agg(F.avg(F.when(~F.isnan("rt"), F.col("rt"))).alias("rt"), F.avg(F.when(~F.isnan("t"), F.col("t"))).alias("t"))


_add("l11_correlations", lambda k, d: cycle.correlations(_profiles(k, d).select("chrom", F.round("rt", 9).alias("rt"), F.round("t", 9).alias("t")), ["chrom"], "rt", "t").select("chrom", "n", *_r("pearson", "spearman")),
     "WITH p AS (SELECT chrom, locus, round(avg(CASE WHEN CAST(rt AS VARCHAR) <> 'nan' THEN rt END), 9) AS rt, round(avg(CASE WHEN CAST(t AS VARCHAR) <> 'nan' THEN t END), 9) AS t FROM sc_repliseq GROUP BY 1, 2), r AS (SELECT chrom, rt, t, rank() OVER (PARTITION BY chrom ORDER BY rt) + (count(*) OVER (PARTITION BY chrom, rt) - 1) / 2 AS a, rank() OVER (PARTITION BY chrom ORDER BY t) + (count(*) OVER (PARTITION BY chrom, t) - 1) / 2 AS b FROM p WHERE rt IS NOT NULL AND t IS NOT NULL) SELECT chrom, count(*) AS n, round(corr(rt, t), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
_SPLITS = f"""{_N}, v AS (SELECT cell_id, CAST((row_number() OVER (ORDER BY volume, cell_id) - 1) * 100 // count(*) OVER () AS INTEGER) AS part FROM c WHERE volume IS NOT NULL), u AS (SELECT chrom, locus, part, sum(value) AS s, count(value) AS k FROM n JOIN v USING (cell_id) GROUP BY 1, 2, 3),
 al AS (SELECT DISTINCT chrom, locus FROM u), ct AS (SELECT al.chrom, al.locus, i, coalesce(sum(s), 0) AS s, coalesce(sum(k), 0) AS k FROM al CROSS JOIN range(0, 101) r(i) LEFT JOIN u ON u.chrom = al.chrom AND u.locus = al.locus AND u.part < i GROUP BY 1, 2, 3),
 t AS (SELECT a.chrom, a.locus, a.i AS g1, 100 - b.i AS g2, b.s - a.s AS ss, b.k - a.k AS sk, w.s - (b.s - a.s) AS gs, w.k - (b.k - a.k) AS gk FROM ct a JOIN ct b ON a.chrom = b.chrom AND a.locus = b.locus JOIN ct w ON w.chrom = a.chrom AND w.locus = a.locus AND w.i = 100 WHERE a.i <= 40 AND b.i >= 60),
 mm AS (SELECT g1, g2, chrom, locus, CASE WHEN sk <> 0 AND gk <> 0 AND gs <> 0 THEN (ss / sk) / (gs / gk) END AS sim FROM t), tm AS (SELECT chrom, locus, avg(CASE WHEN CAST(rt AS VARCHAR) <> 'nan' THEN rt END) AS rt FROM sc_repliseq GROUP BY 1, 2), sp AS (SELECT g1, g2, count(*) AS n, corr(sim, rt) AS r FROM mm JOIN tm USING (chrom, locus) WHERE sim IS NOT NULL AND rt IS NOT NULL GROUP BY 1, 2)"""
_add("l13_volume_splits", lambda k, d: cycle.volume_splits(_counts(k, d), _cells(k, d), _profiles(k, d), PARTS).select("g1", "g2", "n", *_r("r")), f"WITH {_SPLITS} SELECT CAST(g1 AS INTEGER) AS g1, CAST(g2 AS INTEGER) AS g2, n, round(r, 6) AS r FROM sp")
_add("l13_best_states", lambda k, d: cycle.states_of_split(_cells(k, d), cycle.best_split(cycle.volume_splits(_counts(k, d), _cells(k, d), _profiles(k, d), PARTS)), PARTS),
     f"WITH {_SPLITS}, bs AS (SELECT g1, g2 FROM sp WHERE r IS NOT NULL ORDER BY round(r, 9) DESC, g1, g2 LIMIT 1) SELECT cell_id, CASE WHEN part < g1 THEN 'G1' WHEN part >= 100 - g2 THEN 'G2' ELSE 'S' END AS state FROM v, bs")
_add("l22_position_sensitivity", lambda k, d: cycle.position_sensitivity(table(k, d, "sc_repliseq").where("locale_no >= 0").select("chrom", F.floor(F.col("locus") / BLOCK).cast("int").alias("locus"), F.col("locale_no").alias("locale"), "t", F.col("rt").alias("y"))).select("chrom", "locus", "n", "n_locales", F.round("sensitivity", 5).alias("sensitivity"), F.round("f_stat", 4).alias("f_stat")),
     "WITH q AS (SELECT chrom, locus // 20 AS b, locale_no AS l, t, rt AS y FROM sc_repliseq WHERE locale_no >= 0 AND t IS NOT NULL AND rt IS NOT NULL AND CAST(t AS VARCHAR) <> 'nan' AND CAST(rt AS VARCHAR) <> 'nan'), i AS (SELECT chrom, b, l, var_pop(t) * count(*) AS tt, var_pop(y) * count(*) AS yy, covar_pop(t, y) * count(*) AS ty FROM q GROUP BY 1, 2, 3), w AS (SELECT chrom, b, count(*) AS k, sum(yy) - sum(ty) * sum(ty) / sum(tt) AS f FROM i GROUP BY 1, 2), r AS (SELECT chrom, b, count(*) AS n, var_pop(y) * count(*) - covar_pop(t, y) * count(*) * covar_pop(t, y) * count(*) / (var_pop(t) * count(*)) AS r FROM q GROUP BY 1, 2) SELECT chrom, CAST(b AS INTEGER) AS locus, n, k AS n_locales, round(sqrt((r - f) / r), 5) AS sensitivity, round(((r - f) / (k - 1)) / (f / (n - k - 1)), 4) AS f_stat FROM r JOIN w USING (chrom, b) WHERE n >= 10 AND k >= 3 AND n - k - 1 > 0")
_add("l22_loci", lambda k, d: cycle.position_sensitivity(table(k, d, "sc_repliseq").where("locale_no >= 0").select("chrom", "locus", F.col("locale_no").alias("locale"), "t", F.col("rt").alias("y"))).select("chrom", "locus", "n", "n_locales", F.round("sensitivity", 5).alias("sensitivity"), F.round("f_stat", 4).alias("f_stat")),
     ORACLES["l22_position_sensitivity"].replace("locus // 20 AS b", "locus AS b"))
_add("l25g_threshold_sweep", lambda k, d: cycle.threshold_sweep(table(k, d, "sc_repliseq").select((F.col("rt") < 0).alias("early"), F.when(~F.isnan("rt"), F.col("rt")).alias("rt"), (1 - F.col("t")).alias("score")).where("rt IS NOT NULL"), "early", "score", THRESHOLDS).select("threshold", "tp", "fp", "tn", "fn", *_r("accuracy", "ppv", "npv", "tpr", "tnr")),
     f"WITH q AS (SELECT rt < 0 AS e, 1 - t AS s FROM sc_repliseq WHERE CAST(rt AS VARCHAR) <> 'nan' AND CAST(t AS VARCHAR) <> 'nan'), h AS (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS th), c AS (SELECT th, count_if(s > th AND e) AS tp, count_if(s > th AND NOT e) AS fp, count_if(s <= th AND NOT e) AS tn, count_if(s <= th AND e) AS fn FROM q, h GROUP BY 1) SELECT th AS threshold, tp, fp, tn, fn, round(100.0 * (tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, " + ", ".join(f"round(CASE WHEN {a} + {b} <> 0 THEN CAST(100 AS DOUBLE) * {a} / ({a} + {b}) END, 6) AS {n}" for n, a, b in (("ppv", "tp", "fp"), ("npv", "tn", "fn"), ("tpr", "tp", "fn"), ("tnr", "tn", "fp"))) + " FROM c")
_add("l25f_yields", lambda k, d: cycle.yields(table(k, d, "sc_repliseq").where("t IS NOT NULL AND NOT isnan(t)").select("chrom", "locus", cycle.replication_states(F.col("t"), 0.2, 0.8).alias("rep_state")), ["chrom", "locus"]).select("chrom", "locus", "n", *_r("rep", "nonrep", "determined")),
     "SELECT chrom, locus, count(*) AS n, round(count_if(t > 0.8) / count(*), 6) AS rep, round(count_if(t < 0.2) / count(*), 6) AS nonrep, round(count_if(t > 0.8 OR t < 0.2) / count(*), 6) AS determined FROM sc_repliseq WHERE t IS NOT NULL AND CAST(t AS VARCHAR) <> 'nan' GROUP BY 1, 2")


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.col("rt") < 0
    m = table(spark, sf_dir, "sc_repliseq").where("NOT isnan(rt) AND NOT isnan(t) AND trim(cellids) <> ''")
    return cycle.states_by_mixture(m.groupBy(F.col("cellids").alias("cell_id")).agg(F.avg(F.when(early, F.col("t"))).alias("early"), F.avg(F.when(~early, F.col("t"))).alias("late")))


QUERIES["l17_mixture"] = _mixture


def _classifier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples with the probability that they are replicated."""
    m = table(spark, sf_dir, "sc_repliseq").where("NOT isnan(rt) AND NOT isnan(t)").select("sample_id", F.col("cellids").alias("cell_id"), clean_state(F.col("states")).alias("written"), "chrom", "locus", "copy_no", "locale_no", "z", "rt", "t")
    # Time tells which samples are surely labelled; it isn't a feature.
    sure = m.withColumn("state", F.when((F.col("written") == "G1") & (F.col("t") <= EARLY) | (F.col("written") == "G2") & (F.col("t") >= LATE), F.col("written")))
    scored, _ = cycle.replication_classifier(sure, ["z", "rt"], "locale_no", group="chrom")
    return scored.withColumn("state", F.col("written"))


def _classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.area_under_curve(_classifier_rows(spark, sf_dir).where("held_out"), ["chrom"])


QUERIES["l20_classifier"] = _classifier

# Tracing
QUERIES["k1_traces"] = lambda k, d: tracing.traced(_spots(k, d), 0.5, 2, 4_000_000, 2.0, 1_000_000, 0.3, 1.0)
QUERIES["k4_sister_outliers"] = lambda k, d: tracing.sister_outliers(_spots(k, d), 0.5, 500_000)

# Exports
_add("a22_markers", lambda k, d: markers.cmm_lines(_spots(k, d)),
     f"""WITH {_S}, o AS (SELECT cell_id, chrom, trace_id, x, y, z, row_number() OVER w AS k, lead(row_id) OVER w AS nx FROM s WINDOW w AS (PARTITION BY cell_id, chrom, trace_id ORDER BY start_bp, row_id)) SELECT cell_id, chrom, trace_id, CAST(2 * k - 1 AS INTEGER) AS line_no, printf('<marker id="%d" x="%.3f" y="%.3f" z="%.3f" radius="0.05"/>', k, x, y, z) AS line FROM o UNION ALL SELECT cell_id, chrom, trace_id, CAST(2 * k AS INTEGER), printf('<link id1="%d" id2="%d" radius="0.03"/>', k, k + 1) FROM o WHERE nx IS NOT NULL""")
_PDB = """WITH {s}, t AS (SELECT cell_id, chrom, trace_id, count(*) AS n, trace_id LIKE '%-%' AS noisy FROM s GROUP BY ALL), r AS (SELECT cell_id, chrom, trace_id, CASE WHEN noisy THEN -1 ELSE 1 END * row_number() OVER (PARTITION BY cell_id, chrom, noisy ORDER BY n DESC, trace_id) AS rk FROM t),
 v AS (SELECT s.*, rk, coalesce({v}, min({v}) OVER w, 0) AS val, power(10, greatest(length(CAST(max(start_bp) OVER w AS VARCHAR)) - 3, 0)) AS sc FROM s JOIN r USING (cell_id, chrom, trace_id) WINDOW w AS (PARTITION BY cell_id)), e AS (SELECT cell_id, quantile_cont(val, [0.05, 0.95]) AS q FROM v GROUP BY 1),
 b AS (SELECT v.*, CASE WHEN q[2] > q[1] THEN 999 * (greatest(q[1], least(q[2], val)) - q[1]) / (q[2] - q[1]) ELSE 0 END AS beta, row_number() OVER (PARTITION BY cell_id ORDER BY chrom, rk, start_bp, row_id) AS line_no FROM v JOIN e USING (cell_id))
 SELECT cell_id, line_no, printf('ATOM  %5d %-4s%4s %s%4d    %8.3f%8.3f%8.3f%6.1f%6.1f          %2s', CAST(line_no % 100000 AS INTEGER), 'CA', substr(chrom, 4), chr(CAST(65 + ((CASE WHEN rk > 0 THEN rk - 1 ELSE rk END) % 26 + 26) % 26 AS INTEGER)), CAST(abs(rk) AS INTEGER), x, y, z, start_bp / sc, beta, CASE WHEN {v} IS NULL THEN 'Na' ELSE 'O' END) AS line FROM b"""
_add("a20_pdb", lambda k, d: markers.pdb_lines(_spots(k, d)), _PDB.format(s=_S, v="lum"))
_add("a21_pdb_of_feature", lambda k, d: markers.pdb_lines(features.of_spots(_spots(k, d), table(k, d, "loci"), _cube(k, d)), "value"), _PDB.replace("WITH {s}", "WITH {s}, v0 AS (SELECT p.*, m.value AS fv FROM p LEFT JOIN m ON m.cell_id = p.cell_id AND m.locus = p.locus AND m.copy_no = p.copy)").replace("FROM s ", "FROM v0 ").replace("SELECT s.*", "SELECT v0.*").format(s=f"{_PLACED}, {_M}", v="fv"))
_add("a22_by_quantile", lambda k, d: markers.cmm_lines(matrices.sliced(_spots(k, d), ["cell_id"], "z", 4), by=["cell_id", "slice"]),
     f"""WITH {_S}, e AS (SELECT cell_id, quantile_cont(z, [0.25, 0.5, 0.75]) AS q FROM s GROUP BY 1), g AS (SELECT s.*, CAST(z > q[1] AS INTEGER) + CAST(z > q[2] AS INTEGER) + CAST(z > q[3] AS INTEGER) AS slice FROM s JOIN e USING (cell_id)), o AS (SELECT cell_id, slice, x, y, z, row_number() OVER w AS k, lead(row_id) OVER w AS nx FROM g WINDOW w AS (PARTITION BY cell_id, slice ORDER BY start_bp, row_id)) SELECT cell_id, slice, CAST(2 * k - 1 AS INTEGER) AS line_no, printf('<marker id="%d" x="%.3f" y="%.3f" z="%.3f" radius="0.05"/>', k, x, y, z) AS line FROM o UNION ALL SELECT cell_id, slice, CAST(2 * k AS INTEGER), printf('<link id1="%d" id2="%d" radius="0.03"/>', k, k + 1) FROM o WHERE nx IS NOT NULL""")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # A pattern, as a stream's plain path must be a folder and the table may be one file.
    rows = ingest.arrivals(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)
    ingest.run_available(ingest.windowed_counts(rows, "ts", ["event_type"], "1 day"), f"{place}/out", f"{place}/state", "complete")
    return spark.read.parquet(f"{place}/out").select(F.date_format("begins", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_add("s1_stream_counts", _stream, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
