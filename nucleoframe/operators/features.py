"""Structural features: values of spots, and their table per (cell, locus, copy).

The table of a feature has a row for each copy that a cell has of a chromosome and each of its loci. (A
dense table would also hold copies that a cell doesn't have; these are all missing once chromosomes
without any spot are taken out.) Where several spots share locus and copy, their values are averaged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.model import TRACE_KEY
from nucleoframe.operators.spatial import neighbour_sums
from nucleoframe.operators.traces import copy_numbers, distance, grid_pairs

_LOCUS = ["cell_id", "locus", "copy"]


def placed(spots: DataFrame, loci: DataFrame) -> DataFrame:
    """Spots with their locus and copy. Spots that hit no locus are in ``unplaced``."""
    return spots.join(loci.select("locus", "chrom", "start_bp", "end_bp"), ["chrom", "start_bp", "end_bp"]).join(copy_numbers(spots), TRACE_KEY)


def unplaced(spots: DataFrame, loci: DataFrame) -> DataFrame:
    """Spots whose domain isn't exactly one locus: none means that all features cover all spots."""
    hits = loci.groupBy("chrom", "start_bp", "end_bp").agg(F.count(F.lit(1)).alias("hits"))
    return spots.join(hits, ["chrom", "start_bp", "end_bp"], "left").where("hits IS NULL OR hits > 1").select(*spots.columns, F.coalesce("hits", F.lit(0)).alias("hits"))


def grid(spots: DataFrame, loci: DataFrame) -> DataFrame:
    """(cell_id, chrom, copy, locus): every locus of every copy that a cell has."""
    return copy_numbers(spots).select("cell_id", "chrom", "copy").join(loci.select("chrom", "locus"), "chrom")


def per_locus(spots: DataFrame, loci: DataFrame, values: DataFrame) -> DataFrame:
    """The mean of spots' values (row_id, value) per cell, locus and copy; null values don't count."""
    return placed(spots, loci).select(*_LOCUS, "row_id").join(values, "row_id").groupBy(*_LOCUS).agg(F.avg("value").alias("value"))


def spot_count(spots: DataFrame, loci: DataFrame) -> DataFrame:
    """Spots per (cell_id, chrom, locus, copy); 0 where a copy has none."""
    none = grid(spots, loci).select(*_LOCUS, "chrom", F.lit(0).cast("bigint").alias("n"))
    seen = placed(spots, loci).select(*_LOCUS, "chrom", F.lit(1).cast("bigint").alias("n"))
    return none.unionByName(seen).groupBy("cell_id", "chrom", "locus", "copy").agg(F.sum("n").alias("value"))


def intensity(spots: DataFrame, loci: DataFrame, method: str = "mean") -> DataFrame:
    """Mean or sum of light per cell, locus and copy; 0 where there is no spot. Unknown light doesn't
    count; where all is unknown the mean is null and the sum 0."""
    none = grid(spots, loci).select(*_LOCUS, F.lit(None).cast("double").alias("lum"), F.lit(0).alias("n"))
    both = none.unionByName(placed(spots, loci).select(*_LOCUS, "lum", F.lit(1).alias("n"))).groupBy(*_LOCUS)
    value = F.coalesce(F.sum("lum"), F.lit(0.0)) if method == "sum" else F.when(F.sum("n") == 0, F.lit(0.0)).otherwise(F.avg("lum"))
    return both.agg(value.alias("value"))


def height(spots: DataFrame, loci: DataFrame) -> DataFrame:
    return placed(spots, loci).groupBy(*_LOCUS).agg(F.avg("z").alias("value"))


def outside(spots: DataFrame, loci: DataFrame, marker: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A marker's values (cell_id, spot_id, value) per cell, locus and copy, and the spots that have none."""
    known = marker.groupBy("cell_id", "spot_id").agg(F.avg("value").alias("value"))
    both = placed(spots, loci).join(known.withColumn("known", F.lit(True)), ["cell_id", "spot_id"], "left")
    return both.groupBy(*_LOCUS).agg(F.avg("value").alias("value")), both.where("known IS NULL").select("row_id", "cell_id", "spot_id")


def chain_distance(spots: DataFrame, resolution: int) -> DataFrame:
    """Per spot the mean distance to the spots of its trace one domain before and behind."""
    a = spots.alias("a")
    steps = spots.select("*", F.explode(F.array(F.col("start_bp") - resolution, F.col("start_bp") + resolution)).alias("to")).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in TRACE_KEY]
    return a.join(steps, [*same, F.col("a.start_bp") == F.col("b.to")]).groupBy(F.col("a.row_id").alias("row_id")).agg(F.avg(distance("a", "b")).alias("value"))


def gyration(spots: DataFrame, window: int) -> DataFrame:
    """Per spot the radius of gyration of its trace within window / 2; null for a single spot.

    Sums over a range frame; positions are taken from the trace's centre to keep digits.
    """
    centre = Window.partitionBy(*TRACE_KEY)
    w = centre.orderBy("start_bp").rangeBetween(-(window // 2), window // 2)
    near = spots.select("row_id", *TRACE_KEY, "start_bp", *[(F.col(c) - F.avg(c).over(centre)).alias(c) for c in "xyz"])
    spread = sum((F.var_pop(c).over(w) for c in "xyz"), F.lit(0.0))
    return near.select("row_id", F.when(F.count("x").over(w) > 1, F.sqrt(spread)).alias("value"))


def window_pairs(spots: DataFrame, window: int) -> DataFrame:
    """Per spot the mean distance of all pairs of spots of its trace within window / 2 of it; null for fewer than two.

    Pairs meet in buckets of the window's width and are folded by the two starts they lie at; a
    pair counts for the starts between the limits of both, found by bucket too. So work grows with the pairs in
    windows, not with the square of a trace.
    """
    half = window // 2
    thin = spots.select(*TRACE_KEY, "row_id", "start_bp", "x", "y", "z", F.floor(F.col("start_bp") / window).alias("bucket"))
    around = thin.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + m for m in (-1, 0, 1)])))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*TRACE_KEY, "bucket"]]
    pairs = thin.alias("a").join(around.alias("b"), [*same, F.col("a.row_id") < F.col("b.row_id"), F.abs(F.col("a.start_bp") - F.col("b.start_bp")) <= window])
    sums = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in TRACE_KEY], F.least("a.start_bp", "b.start_bp").alias("lo"), F.greatest("a.start_bp", "b.start_bp").alias("hi")).agg(F.sum(distance("a", "b")).alias("total"), F.count(F.lit(1)).alias("k"))
    first, last = F.floor((F.col("hi") - half) / window), F.floor((F.col("lo") + half) / window)
    reach = sums.where(F.col("hi") - half <= F.col("lo") + half).withColumn("bucket", F.explode(F.sequence(first, last)))
    at = thin.select(*TRACE_KEY, "start_bp", "bucket").distinct()
    inside = (F.col("start_bp") >= F.col("hi") - half) & (F.col("start_bp") <= F.col("lo") + half)
    means = at.join(reach, [*TRACE_KEY, "bucket"]).where(inside).groupBy(*TRACE_KEY, "start_bp").agg((F.sum("total") / F.sum("k")).alias("value"))
    return thin.select("row_id", *TRACE_KEY, "start_bp").join(means, [*TRACE_KEY, "start_bp"], "left").select("row_id", "value")


def sphere(spots: DataFrame, radius: float, far: int) -> DataFrame:
    """Contacts of each spot in its cell closer than the radius: how many, how many of another
    chromosome, of another chromosome or trace, of the same chromosome from ``far`` on, as shares (null without a contact);
    their mean distance (null without one apart), and their density."""
    c = neighbour_sums(spots, radius, far, radius)
    apart = F.col("n") - F.col("same_place")
    out = spots.select("row_id").join(c, "row_id", "left")
    share = lambda k: F.try_divide(F.col(k), F.col("n")).alias(k)
    return out.select("row_id", F.coalesce("n", F.lit(0)).alias("n_contacts"), share("inter"), share("trans"), F.try_divide("far", "n").alias("long_intra"), F.try_divide(F.col("distance"), apart).alias("mean_dist"), (F.coalesce(apart, F.lit(0)) / (4 / 3 * math.pi * radius**3)).alias("density"))


def kernel_density(spots: DataFrame, sigma: float, source: Column | None = None) -> DataFrame:
    """Per spot the Gaussian kernel density over all other spots of its cell that aren't at its place; null without one.

    The sum is divided by the number of those spots and normalised to a density. ``source`` keeps only
    spots for which it holds as sources. Beyond nine sigmas a term is under the last digit of a
    double, so only nearer spots are looked for; the number counts all.
    """
    near = neighbour_sums(spots, 9 * sigma, 0, sigma, source)
    is_source = F.lit(True) if source is None else F.coalesce(source, F.lit(False))
    total = spots.groupBy("cell_id").agg(F.count_if(is_source).alias("sources"))
    own = spots.select("row_id", "cell_id", is_source.cast("int").alias("own")).join(total, "cell_id").join(near, "row_id", "left")
    n = F.col("sources") - F.col("own") - F.coalesce("same_place", F.lit(0))
    return own.select("row_id", F.when(n > 0, F.coalesce("kernel", F.lit(0.0)) / n / ((2 * math.pi) ** 1.5 * sigma**3)).alias("value"))


def of_spots(spots: DataFrame, loci: DataFrame, cube: DataFrame) -> DataFrame:
    """Spots with the value that a feature table has at their cell, locus and copy; null where it has none."""
    values = cube.select("cell_id", "locus", F.col("copy_no").alias("copy"), "value")
    return placed(spots, loci).join(values, ["cell_id", "locus", "copy"], "left")


def smoothed_in_space(valued: DataFrame, radius: float) -> DataFrame:
    """Per spot the mean value of the spots of its cell closer than the radius, itself included."""
    pairs = grid_pairs(valued, radius, ["cell_id"], ["value"]).where(F.col("dist") < radius)
    ends = F.array(*[F.struct(F.col(f"{a}.row_id").alias("row_id"), F.col(f"{b}.value").alias("value")) for a, b in ("ab", "ba")])
    return valued.select("row_id", "value").unionByName(pairs.select(F.inline(ends))).groupBy("row_id").agg(F.avg("value").alias("value"))


def body_distance(spots: DataFrame, bodies: DataFrame, delta: float) -> DataFrame:
    """Per spot the distance to the nearest body of its cell (0 inside) and the mean of
    exp(-distance / delta) over them. Bodies with a missing bound don't count; spots of cells
    without bodies have no row."""
    whole = bodies
    for c in ("x_lo", "x_hi", "y_lo", "y_hi", "z_lo", "z_hi"):
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(c))
    gap = [F.greatest(F.col(f"{c}_lo") - F.col(c), F.col(c) - F.col(f"{c}_hi"), F.lit(0.0)) for c in "xyz"]
    dist = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
    boxes = whole.select("cell_id", *[f"{c}_{s}" for c in "xyz" for s in ("lo", "hi")])
    return spots.select("row_id", "cell_id", "x", "y", "z").join(boxes, "cell_id").groupBy("row_id").agg(F.min(dist).alias("closest"), F.avg(F.exp(-dist / delta)).alias("tsa"))
