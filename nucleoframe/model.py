"""Schemas and the rules for what counts as a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COORD_LIMIT = 200_000.0
BP_LIMIT = 400_000_000
NOISE_TRACE = "-1"

SPOTS = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("spot_id", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("start_bp", T.LongType()),
        T.StructField("end_bp", T.LongType()),
        T.StructField("lum", T.DoubleType()),
        T.StructField("gene_id", T.StringType()),
    ]
)
LOCI = T.StructType(
    [
        T.StructField("locus", T.IntegerType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("start_bp", T.LongType()),
        T.StructField("end_bp", T.LongType()),
    ]
)
FEATURES = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("cell_num", T.IntegerType()),
        T.StructField("locus", T.IntegerType()),
        T.StructField("copy", T.IntegerType()),
        T.StructField("value", T.FloatType()),
    ]
)

#: One physical chromosome copy of one cell.
TRACE_KEY = ["cell_id", "chrom", "trace_id"]


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def known_coord(c: Column) -> Column:
    """True for a finite coordinate strictly between 0 and the limit; never null."""
    return F.coalesce(~F.isnan(c) & (c > 0) & (c < COORD_LIMIT), F.lit(False))


def known_bp(c: Column) -> Column:
    """True for a position from 0, the first of a chromosome, to the limit; never null."""
    return F.coalesce((c >= 0) & (c <= BP_LIMIT), F.lit(False))


def clean_spots(spots: DataFrame, genome: DataFrame | None = None) -> DataFrame:
    """Null out placeholders: coordinates and positions out of range, chromosomes the genome lacks.

    The genome is a dimension of a few chromosomes; only its names are joined.
    """
    out = spots
    for c in ("x", "y", "z"):
        out = out.withColumn(c, F.when(known_coord(F.col(c)), F.col(c)))
    out = out.withColumn("start_bp", F.when(known_bp(F.col("start_bp")), F.col("start_bp")))
    if genome is not None:
        names = genome.select(F.col("chrom").alias("_known")).where("_known is not null").distinct()
        out = out.join(names, F.col("chrom") == F.col("_known"), "left")
        out = out.withColumn("chrom", F.col("_known")).drop("_known")
    return out


def clean_state(state: Column) -> Column:
    """G1, S or G2 however written; null for blank and anything else."""
    s = F.upper(F.regexp_replace(F.coalesce(state, F.lit("")), r"[^A-Za-z0-9]", ""))
    return F.when(s.startswith("G1"), "G1").when(s.startswith("G2"), "G2").when(s.startswith("S"), "S")
