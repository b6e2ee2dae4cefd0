"""Container operations on tables of spots and cells: lookup, removal, merging, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoframe.session import ranked


def lookup(spots: DataFrame, cell_id: str, chrom: str | None = None, trace_id: str | None = None) -> DataFrame | None:
    """Spots of a cell, of a chromosome in it, or of a trace in that; a trace without a chromosome is nothing."""
    if trace_id is not None and chrom is None:
        return None
    out = spots.where(F.col("cell_id") == cell_id)
    if chrom is not None:
        out = out.where(F.col("chrom") == chrom).drop("chrom")
    return out if trace_id is None else out.where(F.col("trace_id") == trace_id).drop("trace_id")


def pop_cells(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of cells that ``gone`` (cell_id) doesn't list; unknown ids are ignored, null cells stay."""
    return rows.join(gone.select("cell_id").distinct(), "cell_id", "left_anti")


def pop_spots(spots: DataFrame, gone: DataFrame) -> DataFrame:
    key = ["cell_id", "chrom", "trace_id", "spot_id"]
    return spots.join(gone.select(*key).distinct(), key, "left_anti")


def removal_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: cells before, removed and remaining."""
    b, a = before.agg(F.count_distinct("cell_id").alias("ncell")), after.agg(F.count_distinct("cell_id").alias("ncell_remaining"))
    return b.join(a).select("ncell", (F.col("ncell") - F.col("ncell_remaining")).alias("ncell_removed"), "ncell_remaining")


def overlap(a: DataFrame, b: DataFrame, tag_a: str = "", tag_b: str = "") -> DataFrame:
    """Cell ids that both tables would have once tagged."""
    ids = [t.select(F.concat_ws("_", "cell_id", F.lit(tag or None)).alias("cell_id")) for t, tag in ((a, tag_a), (b, tag_b))]
    return ids[0].intersect(ids[1])


def merge(a: DataFrame, b: DataFrame, tag_a: str, tag_b: str, index_a: DataFrame | None = None, index_b: DataFrame | None = None) -> DataFrame:
    """Both tables under one another; cell ids get the tag of their table behind them.

    With indexes given, tables of different loci raise ValueError, as do tables that share a tagged cell.
    """
    if index_a is not None and index_b is not None:
        if not same_index(index_a, index_b).isEmpty():
            raise ValueError("the tables have different loci")
        if not overlap(a, b, tag_a, tag_b).isEmpty():
            raise ValueError("the tables share cells")
    tagged = [t.withColumn("cell_id", F.concat_ws("_", "cell_id", F.lit(tag))) for t, tag in ((a, tag_a), (b, tag_b))]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True)


def same_index(a: DataFrame, b: DataFrame, chroms: list[str] | None = None) -> DataFrame:
    """Loci that only one of two indexes has; none means they are equal."""
    keep = lambda d: (d if chroms is None else d.where(F.col("chrom").isin(chroms))).select("chrom", "start_bp", "end_bp")
    return keep(a).exceptAll(keep(b)).withColumn("side", F.lit("left")).unionByName(keep(b).exceptAll(keep(a)).withColumn("side", F.lit("right")))


def consistency(spots: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that only the spots or only the cell table has."""
    s, c = spots.select("cell_id").distinct().withColumn("s", F.lit(1)), cells.select("cell_id").distinct().withColumn("c", F.lit(1))
    return s.join(c, "cell_id", "full").where("s IS NULL OR c IS NULL").select("cell_id", F.when(F.col("s").isNull(), "spots").otherwise("cells").alias("missing_in"))


def index_of(spots: DataFrame) -> DataFrame:
    """The index that spots imply: their distinct domains, numbered by chromosome and start."""
    domains = spots.select("chrom", "start_bp", "end_bp").dropna().distinct()
    return ranked(domains, [F.col(c).asc() for c in ("chrom", "start_bp", "end_bp")], "locus").select((F.col("locus") - 1).cast("int").alias("locus"), "chrom", "start_bp", "end_bp")


def lost_loci(old: DataFrame, new: DataFrame) -> DataFrame:
    """Loci that a change of index would lose; a new index must have none, that is be a superset."""
    return old.select("chrom", "start_bp", "end_bp").subtract(new.select("chrom", "start_bp", "end_bp"))


def sorted_by(cells: DataFrame, order: list[Column]) -> DataFrame:
    """Cells numbered anew from 0 in the order given; every cell stays."""
    return ranked(cells, order, "_place").withColumn("cell_num", (F.col("_place") - 1).cast("int")).drop("_place")


def pop_feature_cells(features: DataFrame, cells: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells without those in ``gone`` (cell_id), numbered anew in their order, and the feature rows of them.

    Both tables are keyed by cell_num before. Unknown ids are ignored.
    """
    left = pop_cells(cells, gone).withColumnRenamed("cell_num", "_old")
    kept = sorted_by(left, [F.col("_old").asc(), F.col("cell_id").asc()])
    moved = features.join(kept.select(F.col("_old").alias("cell_num"), F.col("cell_num").alias("_new")), "cell_num")
    return kept.drop("_old"), moved.withColumn("cell_num", F.col("_new")).drop("_new")


def shape_faults(features: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Keys of a feature table that it lacks, has too often, or shouldn't have; none means the table may be added."""
    seen = features.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(*key).distinct().withColumn("due", F.lit(1)).join(seen, key, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.withColumn("fault", fault).where("fault IS NOT NULL").select(*key, "fault")


def merged_attributes(a: DataFrame, b: DataFrame) -> DataFrame:
    """The attributes of two tables as one row: cells and spots add up, maxima are the larger; nchrom is null if they differ."""
    sums, most = ["ncell", "nspot"], ["max_ntrace_per_chrom", "max_nspot_per_trace", "max_nspot_per_domain"]
    same = F.when(F.min("nchrom") == F.max("nchrom"), F.max("nchrom")).alias("nchrom")
    return a.unionByName(b).agg(*[F.sum(c).alias(c) for c in sums], same, *[F.max(c).alias(c) for c in most])


def chromosomes(genome: DataFrame, wanted: list[str]) -> DataFrame:
    """Names that a genome has of those wanted; ``#`` stands for the autosomes chr1 to chr22."""
    names = [n for w in wanted for n in ([f"chr{k}" for k in range(1, 23)] if w == "#" else [w])]
    return genome.where(F.col("chrom").isin(names)).select("chrom").distinct()


def flat_index(cell: Column, locus: Column, copy: Column, n_loci: Column, n_copies: int) -> Column:
    """The place of (cell, locus, copy) when a table is laid out flat, copies running fastest."""
    return (cell.cast("bigint") * n_loci + locus) * n_copies + copy


def triads(spots: DataFrame) -> DataFrame:
    """The distinct (cell, chromosome, trace), each with the copy of its trace and a label."""
    from nucleoframe.operators.traces import copy_numbers

    return copy_numbers(spots).withColumn("label", F.concat_ws("/", "cell_id", "chrom", "trace_id"))


def target_bins(loci: DataFrame, genome: DataFrame, target: int | str) -> DataFrame:
    """(locus, chrom, bin): the bin that holds each locus whole: itself (``self``), its chromosome
    (``whole_chromosome``), or the one of so many base pairs counted from the chromosome's origin.

    Loci that no bin holds whole have a null bin.
    """
    l = loci.select("locus", "chrom", "start_bp", "end_bp")
    if target == "self":
        return l.select("locus", "chrom", F.col("locus").alias("bin"))
    if target == "whole_chromosome":
        return l.select("locus", "chrom", F.lit(0).alias("bin"))
    both = l.join(genome.select("chrom", "origin_bp"), "chrom")
    at = F.floor((F.col("start_bp") - F.col("origin_bp")) / target)
    return both.select("locus", "chrom", F.when(F.col("end_bp") - F.col("origin_bp") <= (at + 1) * target, at.cast("int")).alias("bin"))


def spots_above(valued: DataFrame, share: float) -> DataFrame:
    """Spots (with ``value``) at or above their cell's percentile; unknown values are below."""
    from nucleoframe.operators.matrices import percentiles

    edges = percentiles(valued, ["cell_id"], "value", [share])
    return valued.join(edges, "cell_id").where(F.col("value") >= F.col("edges")[0]).drop("edges")


def voxels(spots: DataFrame, resolution: float, origin: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """The voxel of each spot: place over resolution less the origin, rounded half to even."""
    return spots.select("row_id", *[F.rint(F.col(c) / resolution - o).cast("int").alias(f"i{c}") for c, o in zip("xyz", origin)])
