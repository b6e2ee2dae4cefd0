"""Trace metrics over spots: ranks, copies, coverage, neighbours, sisters, homologues, projection.

All take a spots table (see ``model.SPOTS``) and return tables; null keys form groups like any
other value, null coordinates give null distances, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.model import TRACE_KEY
from nucleoframe.operators.spatial import pair_counts
from nucleoframe.session import ranked


def is_noisy(trace: Column) -> Column:
    """A trace id that holds a minus sign anywhere."""
    return F.contains(trace, F.lit("-"))


def spots_per_trace(spots: DataFrame, ignore_noisy: bool = True) -> DataFrame:
    kept = spots.where(~is_noisy(F.col("trace_id"))) if ignore_noisy else spots
    return kept.groupBy(*TRACE_KEY).agg(F.count(F.lit(1)).alias("n_spots"))


def traces_per_chromosome(spots: DataFrame, ignore_noisy: bool = True) -> DataFrame:
    """Traces of each cell and chromosome; 0 where all are noisy."""
    trace = F.when(~is_noisy(F.col("trace_id")), F.col("trace_id")) if ignore_noisy else F.col("trace_id")
    return spots.groupBy("cell_id", "chrom").agg(F.count_distinct(trace).alias("n_traces"))


def trace_ranks(spots: DataFrame) -> DataFrame:
    """Ranks of traces by falling number of spots: 1, 2, ... for valid ones, -1, -2, ... for noisy ones."""
    sizes = spots.groupBy(*TRACE_KEY).agg(F.count(F.lit(1)).alias("n_spots")).withColumn("noisy", is_noisy(F.col("trace_id")))
    rank = F.row_number().over(Window.partitionBy("cell_id", "chrom", "noisy").orderBy(F.desc("n_spots"), "trace_id"))
    return sizes.select(*TRACE_KEY, "n_spots", F.when(F.col("noisy"), -rank).otherwise(rank).alias("trace_rank"))


def copy_numbers(spots: DataFrame) -> DataFrame:
    """The copy of each trace: its place among the sorted traces of its cell and chromosome, from 0."""
    traces = spots.select(*TRACE_KEY).distinct()
    return traces.select(*TRACE_KEY, (F.dense_rank().over(Window.partitionBy("cell_id", "chrom").orderBy("trace_id")) - 1).alias("copy"))


def spots_by_rank(spots: DataFrame) -> DataFrame:
    return trace_ranks(spots).groupBy("trace_rank").agg(F.avg("n_spots").alias("avg_spots"), F.count(F.lit(1)).alias("n_traces"))


def coverage(spots: DataFrame, loci: DataFrame) -> DataFrame:
    """Share of a chromosome's loci that a trace covers."""
    n = loci.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_loci"))
    seen = spots.groupBy(*TRACE_KEY).agg(F.count_distinct("start_bp", "end_bp").alias("n_seen"))
    return seen.join(n, "chrom").select(*TRACE_KEY, (F.col("n_seen") / F.col("n_loci")).alias("coverage"))


def distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(2.0)) for c in "xyz"), F.lit(0.0)))


def neighbour_distances(spots: DataFrame) -> DataFrame:
    """Genomic and spatial distances of consecutive spots of a trace: mean, least and greatest."""
    order = Window.partitionBy(*TRACE_KEY).orderBy("start_bp", "spot_id", "row_id")
    gap = F.col("start_bp") - F.lag("start_bp").over(order)
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(order), F.lit(2.0)) for c in "xyz"), F.lit(0.0)))
    pairs = spots.select(*TRACE_KEY, gap.alias("g"), step.alias("d")).where("g IS NOT NULL")
    return pairs.groupBy(*TRACE_KEY).agg(*[f(c).alias(f"{n}_{m}") for c, m in (("g", "gdist"), ("d", "dist")) for f, n in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))])


def sisters(spots: DataFrame) -> DataFrame:
    """Pairs of spots of one domain in one trace, with their distance."""
    a, b = spots.alias("a"), spots.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*TRACE_KEY, "start_bp"]]
    return a.join(b, [*same, F.col("a.row_id") < F.col("b.row_id")]).select(*[F.col(f"a.{c}") for c in [*TRACE_KEY, "start_bp"]], F.col("a.row_id").alias("row_id"), F.col("b.row_id").alias("sister_id"), distance("a", "b").alias("dist"))


def homologue_proximity(spots: DataFrame, threshold: float) -> DataFrame:
    """Per chromosome the share of cells, of those with two traces or more, in which some pair of
    traces comes within the threshold. Only spots that near are paired."""
    valid = spots.where(~is_noisy(F.col("trace_id")))
    several = valid.groupBy("cell_id", "chrom").agg(F.count_distinct("trace_id").alias("n")).where("n >= 2").select("cell_id", "chrom")
    near = pair_counts(valid.join(several, ["cell_id", "chrom"]), threshold, ["cell_id", "chrom"], ["trace_id"])
    hits = near.select("cell_id", "chrom").distinct().withColumn("hit", F.lit(1))
    return several.join(hits, ["cell_id", "chrom"], "left").groupBy("chrom").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"), F.count(F.lit(1)).alias("n_cells"))


#: A grid cell itself and those of its neighbours that come behind it.
_HALF = [(0, 0, 0)] + [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]


def grid_pairs(spots: DataFrame, radius: float, key: list[str], columns: list[str]) -> DataFrame:
    """Pairs a, b of different spots with equal keys at most ``radius`` apart, each once.

    A spot waits in its cell of a grid as wide as the radius and asks there and in the 13
    neighbouring cells behind it. The join is an equi-join on one number, a hash of key and grid cell; what it
    matches is compared exactly. Side a has the key, both have the id, the place and ``columns``.
    """
    at = [F.floor(F.col(c) / radius) for c in "xyz"]
    thin = spots.select(*dict.fromkeys([*key, "row_id", "x", "y", "z", *columns]), F.xxhash64(*key).alias("_key"))
    moves = F.array(*[F.struct(*[F.lit(v).cast("tinyint").alias(f"m{c}") for c, v in zip("xyz", m)]) for m in _HALF])
    there = [g + F.col(f"m{c}") for g, c in zip(at, "xyz")]
    asking = thin.drop(*[k for k in key if k not in columns]).select("*", F.inline(moves)).withColumn("_at", F.xxhash64("_key", *there))
    home = thin.withColumn("_at", F.xxhash64("_key", *at))
    cell = lambda side, c: F.floor(F.col(f"{side}.{c}") / radius)
    same = [F.col("a._at") == F.col("b._at"), F.col("a._key") == F.col("b._key"), *[cell("a", c) == cell("b", c) + F.col(f"b.m{c}") for c in "xyz"]]
    at_home = (F.col("b.mx") == 0) & (F.col("b.my") == 0) & (F.col("b.mz") == 0)
    return home.alias("a").join(asking.alias("b"), [*same, ~at_home | (F.col("a.row_id") < F.col("b.row_id"))]).withColumn("dist", distance("a", "b")).where(F.col("dist") <= radius)


def projection(spots: DataFrame, resolution: int) -> DataFrame:
    """Mean position and light of a trace in each coarse domain."""
    coarse = (F.floor(F.col("start_bp") / resolution) * resolution).cast("bigint")
    return spots.groupBy(*TRACE_KEY, coarse.alias("start_bp")).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "lum")], F.count(F.lit(1)).alias("n_spots"))


def projected_spots(spots: DataFrame, resolution: int | None) -> DataFrame:
    """The projection on coarse domains, or on the spots' own (None), as spots numbered from 1 in each cell by chromosome, trace and start."""
    if resolution is None:
        mean = spots.groupBy(*TRACE_KEY, "start_bp", "end_bp").agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "lum")])
    else:
        mean = projection(spots, resolution).drop("n_spots").withColumn("end_bp", F.col("start_bp") + resolution)
    placed = ranked(mean, [F.col(c).asc() for c in ("cell_id", "chrom", "trace_id", "start_bp", "end_bp")])
    first = placed.groupBy("cell_id").agg(F.min("place").alias("first"))
    return placed.join(first, "cell_id").withColumn("spot_id", (F.col("place") - F.col("first") + 1).cast("string")).drop("place", "first")


def sister_summary(spots: DataFrame, states: DataFrame) -> DataFrame:
    """Distances of sisters per state (cell_id, state) and in all: how many, their mean and greatest."""
    each = sisters(spots).join(states, "cell_id", "left").select("dist", F.explode(F.array("state", F.lit("all"))).alias("state")).where("state IS NOT NULL")
    return each.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean"), F.max("dist").alias("most"))


def attributes(spots: DataFrame) -> DataFrame:
    """One row: cells, most chromosomes in a cell, spots, most traces per chromosome, most spots per trace and domain."""
    per_domain = spots.groupBy(*TRACE_KEY, "start_bp", "end_bp").agg(F.count(F.lit(1)).alias("n"))
    per_trace = per_domain.groupBy(*TRACE_KEY).agg(F.sum("n").alias("n"), F.max("n").alias("d"))
    per_chrom = per_trace.groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("n"), F.max("n").alias("m"), F.max("d").alias("d"))
    per_cell = per_chrom.groupBy("cell_id").agg(F.count(F.lit(1)).alias("c"), F.max("t").alias("t"), F.sum("n").alias("n"), F.max("m").alias("m"), F.max("d").alias("d"))
    return per_cell.agg(F.count(F.lit(1)).alias("ncell"), F.max("c").alias("nchrom"), F.sum("n").alias("nspot"), F.max("t").alias("max_ntrace_per_chrom"), F.max("m").alias("max_nspot_per_trace"), F.max("d").alias("max_nspot_per_domain"))


def clean(spots: DataFrame, loci: DataFrame, least_coverage: float, most_gap: float) -> DataFrame:
    """Spots of valid traces with enough coverage and no mean gap above the limit."""
    good = coverage(spots, loci).where(F.col("coverage") >= least_coverage).join(neighbour_distances(spots).where(F.col("avg_gdist") <= most_gap), TRACE_KEY)
    return spots.where(~is_noisy(F.col("trace_id"))).join(good.select(*TRACE_KEY), TRACE_KEY, "left_semi")


def imputed(spots: DataFrame, loci: DataFrame) -> DataFrame:
    """Positions for the loci that a valid trace misses: linear in the genome between the nearest
    imaged loci, copies of the nearest beyond the ends. Of sisters the last by id is the anchor."""
    seen = spots.where(~is_noisy(F.col("trace_id"))).groupBy(*TRACE_KEY, "start_bp").agg(F.max_by(F.struct("x", "y", "z"), "row_id").alias("p"))
    traces = seen.select(*TRACE_KEY).distinct()
    wanted = traces.join(loci.select("chrom", "start_bp", "end_bp"), "chrom").join(seen, [*TRACE_KEY, "start_bp"], "left")
    order = Window.partitionBy(*TRACE_KEY).orderBy("start_bp")
    at = F.when(F.col("p").isNotNull(), F.struct("start_bp", "p.x", "p.y", "p.z"))
    left, right = F.last(at, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = wanted.select("*", left.alias("l"), right.alias("r")).where("p IS NULL AND (l IS NOT NULL OR r IS NOT NULL)")
    share = (F.col("start_bp") - F.col("l.start_bp")) / (F.col("r.start_bp") - F.col("l.start_bp"))
    fill = lambda c: F.coalesce(F.col(f"l.{c}") + (F.col(f"r.{c}") - F.col(f"l.{c}")) * share, F.col(f"l.{c}"), F.col(f"r.{c}"))
    return both.select(*TRACE_KEY, "start_bp", "end_bp", *[fill(c).alias(c) for c in "xyz"])


def completed(spots: DataFrame, loci: DataFrame) -> DataFrame:
    """Observed spots with the imputed ones under them: spot_id ``IMPUTED_n``, n from 1 in each trace, without light or row_id."""
    order = Window.partitionBy(*TRACE_KEY).orderBy("start_bp")
    made = imputed(spots, loci).withColumn("spot_id", F.concat(F.lit("IMPUTED_"), F.row_number().over(order)))
    return spots.unionByName(made, allowMissingColumns=True)


def without_imputed(spots: DataFrame) -> DataFrame:
    return spots.where(~F.contains("spot_id", F.lit("IMPUTED")))


def nearest_trace(rna: DataFrame, dna: DataFrame, most: float) -> DataFrame:
    """For each RNA spot the trace of the nearest DNA spot of its domain, if within ``most``."""
    key = ["cell_id", "chrom", "start_bp", "end_bp"]
    a, b = rna.alias("a"), dna.alias("b")
    near = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key]).select(F.col("a.row_id").alias("row_id"), F.col("b.trace_id").alias("trace_id"), distance("a", "b").alias("dist"))
    return near.groupBy("row_id").agg(F.min(F.struct("dist", "trace_id")).alias("m")).where(F.col("m.dist") <= most).select("row_id", F.col("m.trace_id").alias("trace_id"), F.col("m.dist").alias("dist"))
