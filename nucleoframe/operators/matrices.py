"""Operations on feature tables (cell_id, state, chrom, locus, copy_no, value): a missing value is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.session import cut_lineage, ranked


#: Groups of more values than this are ranked over range partitions instead of in one task.
HOT_VALUES = 200_000


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], hot_values: int = HOT_VALUES) -> DataFrame:
    """Exact percentiles (column ``edges``) of each group's values, by linear interpolation; null values don't count.

    Small groups are aggregated; the values of large ones are put in order over range partitions, and
    only the two values at each share are taken. Both give the same numbers.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    hot = cut_lineage(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_values))
    few = known if hot.isEmpty() else known.join(hot, by, "left_anti")
    out = few.groupBy(*by).agg(F.percentile("_v", shares).alias("edges"))
    if hot.isEmpty():
        return out
    placed = ranked(known.join(hot.drop("_n"), by, "left_semi"), [*[F.col(c).asc() for c in by], F.col("_v").asc()], "_place")
    placed = placed.join(placed.groupBy(*by).agg(F.min("_place").alias("_first")), by).select(*by, "_v", (F.col("_place") - F.col("_first")).alias("_at"))
    asked = hot.select(*by, F.posexplode(F.array(*[F.lit(p) * (F.col("_n") - 1) for p in shares]))).select(*by, "pos", F.col("col").alias("_pos"), F.inline(F.array(F.struct(F.floor("col").alias("_at"), (1 - (F.col("col") - F.floor("col"))).alias("_w")), F.struct((F.floor("col") + 1).alias("_at"), (F.col("col") - F.floor("col")).alias("_w"))))).where("_w > 0")
    values = asked.join(placed, [*by, "_at"]).groupBy(*by, "pos").agg(F.sum(F.col("_w") * F.col("_v")).alias("_v"))
    return out.unionByName(values.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_v"))), lambda e: e["_v"]).alias("edges")))


def sliced(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Rows with ``slice``, 0 to n-1, by the group's percentiles; a value at an inner edge belongs to the lower slice."""
    edges = percentiles(rows, by, value, [k / n for k in range(1, n)])
    below = F.size(F.filter("edges", lambda e: e < F.col(value)))
    return rows.join(edges, by).select(*rows.columns, F.when(F.col(value).isNotNull(), below).alias("slice"))


def coarse_grain(cube: DataFrame, factor: int, method: str = "average") -> DataFrame:
    """Per cell, coarse locus and copy the average, the sum (0 of nothing) or the consensus (1 if
    the sum exceeds half the fine loci, else 0)."""
    value = {"average": F.avg("value"), "sum": F.coalesce(F.sum("value"), F.lit(0.0)), "consensus": (F.coalesce(F.sum("value"), F.lit(0.0)) > F.count(F.lit(1)) / 2).cast("double")}[method]
    return cube.groupBy("cell_id", "chrom", F.floor(F.col("locus") / factor).cast("int").alias("coarse"), "copy_no").agg(value.alias("value"))


def quantised(cube: DataFrame, n: int) -> DataFrame:
    """The quantile, 0 to n-1, of each value among its cell's values; edges by linear interpolation."""
    edges = percentiles(cube, ["cell_id"], "value", [k / n for k in range(1, n)])
    q = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    return cube.join(edges, "cell_id").select(*cube.columns, F.when(F.col("value").isNotNull(), q).alias("q"))


def z_scores(cube: DataFrame, by: list[str]) -> DataFrame:
    """Values less their group's mean, in population deviations; null where that is 0. Groups are
    aggregated first, so that a hot one isn't sorted in one task."""
    stats = cube.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    # Values that are all the same have a deviation of 0, up to the last digits of their mean.
    spread = F.when(F.col("_sd") > 1e-12 * (1 + F.abs("_mean")), F.col("_sd"))
    return cube.join(stats, same).select(*cube.columns, F.try_divide(F.col("value") - F.col("_mean"), spread).alias("zscore"))


def normalised_by_cell(cube: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """Values over their cell's mean, or over a number given per cell (cell_id, scalar); null where that is 0 or missing."""
    if scalars is not None:
        given = scalars.select(F.col("cell_id").alias("_cell"), "scalar")
        return cube.join(given, F.col("cell_id") == F.col("_cell"), "left").select(*cube.columns, F.try_divide("value", "scalar").alias("norm"))
    mean = cube.groupBy(F.col("cell_id").alias("_cell")).agg(F.avg("value").alias("_mean"))
    return cube.join(mean, F.col("cell_id").eqNullSafe(F.col("_cell"))).select(*cube.columns, F.try_divide("value", "_mean").alias("norm"))


def sliding(cube: DataFrame, window: int, method: str = "mean") -> DataFrame:
    """Mean, median or sum over the loci within window // 2 of each, on the same chromosome, copy and cell."""
    w = Window.partitionBy("cell_id", "chrom", "copy_no").orderBy("locus").rangeBetween(-(window // 2), window // 2)
    if method == "median":
        near = F.array_sort(F.collect_list("value").over(w))
        middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
        return cube.withColumn("slid", middle(near))
    return cube.withColumn("slid", F.avg("value").over(w) if method == "mean" else F.coalesce(F.sum("value").over(w), F.lit(0.0)))


def smoothed(profile: DataFrame, k: int) -> DataFrame:
    """Centred moving mean of k loci that skips nulls; an even k reaches one less ahead. With the
    error of the mean if the profile has ``error``."""
    w = Window.partitionBy("chrom").orderBy("locus").rowsBetween(-(k // 2), k // 2 if k % 2 else k // 2 - 1)
    out = profile.withColumn("smooth", F.avg("value").over(w))
    return out.withColumn("smooth_error", F.try_divide(F.sqrt(F.sum(F.col("error") * F.col("error")).over(w)), F.count("error").over(w))) if "error" in profile.columns else out


def without_missing_chromosomes(cube: DataFrame) -> DataFrame:
    """Null where every value of a cell, chromosome and copy is 0; a null among them blocks it."""
    w = Window.partitionBy("cell_id", "chrom", "copy_no")
    zero = F.min(F.when(F.col("value") == 0, 1).otherwise(0)).over(w) == 1
    return cube.withColumn("value", F.when(~zero, F.col("value")))


def haploid_profile(cube: DataFrame) -> DataFrame:
    """Per locus mean, population deviation, count and error of the mean."""
    n, sd = F.count("value"), F.stddev_pop("value")
    return cube.groupBy("chrom", "locus").agg(F.avg("value").alias("mean"), sd.alias("std"), n.alias("n"), F.try_divide(sd, F.sqrt(n)).alias("sem"))


def normalised_profile(cube: DataFrame, cells: DataFrame, norm: str | None = None, state: str | None = None, factor: int = 1, method: str = "average") -> DataFrame:
    """The haploid profile of coarse loci, of the cells of one state if given.

    Values are coarse-grained first, then normalised by the cell's effective ``radius``, by ``zscore`` in the cell or by
    the ``cell`` mean, and only then are cells of other states left out. One row per chromosome and coarse locus.
    """
    coarse = coarse_grain(cube, factor, method).withColumnRenamed("coarse", "locus")
    if norm == "radius":
        coarse = coarse.join(cells.select("cell_id", effective_radius(F.col("volume")).alias("_r")), "cell_id").withColumn("value", F.try_divide("value", "_r"))
    elif norm == "zscore":
        coarse = z_scores(coarse, ["cell_id"]).withColumn("value", F.col("zscore"))
    elif norm == "cell":
        coarse = normalised_by_cell(coarse).withColumn("value", F.col("norm"))
    elif norm is not None:
        raise ValueError(f"unknown normalisation {norm}")
    kept = coarse if state is None else coarse.join(cells.where(F.col("state") == state).select("cell_id"), "cell_id", "left_semi")
    return haploid_profile(kept)


def clipped(c: Column, low: float, high: float) -> Column:
    """Values within limits; infinite ones, NaN and null are null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def feature_rows(features: dict[str, DataFrame], locales: DataFrame, known_locales: list[int], window: int, quantiles: int | None) -> DataFrame:
    """One row per (cell_id, chrom, locus, copy_no) with all features, as a classifier takes them.

    Each feature is quantised in its cell (if asked) and averaged over the window; of locales
    (value = locale, null unknown) the share of each in the window comes out. Rows that miss any feature are dropped.
    """
    key = ["cell_id", "chrom", "locus", "copy_no"]
    out = None
    for name, cube in features.items():
        if quantiles:
            cube = quantised(cube.select(*key, "value"), quantiles).withColumn("value", F.col("q").cast("double"))
        slid = sliding(cube.select(*key, "value"), window).select(*key, F.col("slid").alias(name))
        out = slid if out is None else out.join(slid, key)
    w = Window.partitionBy("cell_id", "chrom", "copy_no").orderBy("locus").rangeBetween(-(window // 2), window // 2)
    shares = locales.select(*key, *[F.avg((F.coalesce("value", F.lit(-1)) == k).cast("double")).over(w).alias(f"locale_{k}") for k in known_locales])
    return out.join(shares, key).dropna()


def interpolated(cube: DataFrame) -> DataFrame:
    """Values for null loci: linear between the nearest of the same cell, chromosome and copy, copies at the ends."""
    w = Window.partitionBy("cell_id", "chrom", "copy_no").orderBy("locus")
    at = F.when(F.col("value").isNotNull(), F.struct("locus", "value"))
    left, right = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    share = F.try_divide((F.col("locus") - F.col("l.locus")).cast("double"), (F.col("r.locus") - F.col("l.locus")).cast("double"))
    filled = F.coalesce("value", F.col("l.value") + (F.col("r.value") - F.col("l.value")) * share, "l.value", "r.value")
    return cube.select("*", left.alias("l"), right.alias("r")).select(*cube.columns, filled.alias("filled"))


def sorted_cells(cube: DataFrame) -> DataFrame:
    """The order of cells by their mean to nine decimals, nulls last, ties by id."""
    means = cube.groupBy("cell_id").agg(F.avg("value").alias("mean"))
    return ranked(means, [F.round("mean", 9).asc_nulls_last(), F.col("cell_id").asc()]).select("cell_id", "mean", "place")


def effective_radius(volume: Column) -> Column:
    return F.pow(F.lit(0.75 / 3.141592653589793) * volume, F.lit(1.0 / 3.0))
