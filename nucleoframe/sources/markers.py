"""Text sinks for molecule viewers, and BED tracks. Each cell's lines come out in order, tagged by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nucleoframe.model import TRACE_KEY
from nucleoframe.operators.matrices import percentiles
from nucleoframe.operators.traces import trace_ranks
from nucleoframe.session import ranked


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """A BED track: chrom, start_bp, end_bp and value (the fourth column as a number, null if there is none)."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|track\b|browser\b|$)")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return lines.select(F.col("f")[0].alias("chrom"), F.try_to_number(F.col("f")[1], F.lit("9999999999")).cast("bigint").alias("start_bp"), F.try_to_number(F.col("f")[2], F.lit("9999999999")).cast("bigint").alias("end_bp"), F.expr("try_cast(get(f, 3) AS double)").alias("value"))


def bed_of_spots(spots: DataFrame, bed: DataFrame) -> DataFrame:
    """Spots with the value of the BED row of exactly their domain, null without one."""
    return spots.join(bed.select("chrom", "start_bp", "end_bp", F.col("value").alias("bed_value")), ["chrom", "start_bp", "end_bp"], "left")


def chain_letter(rank: Column) -> Column:
    """1, 2, ... as A, B, ... and -1, -2, ... as Z, Y, ...; beyond the alphabet it starts again."""
    at = F.pmod(F.when(rank > 0, rank - 1).otherwise(rank), F.lit(26))
    return F.char(at + 65)


def pdb_lines(spots: DataFrame, value: str = "lum") -> DataFrame:
    """(cell_id, line_no, line): an ATOM record per spot, by trace rank and start.

    The chain is the trace's rank, the residue the chromosome, the occupancy the start in the unit that keeps
    the cell's starts below 1000, the last number the value scaled to 0..999 between the 5th and
    95th percent of the cell, all 0 if they are the same. An unknown value is the cell's least; its element is Na, else O.
    """
    least = spots.groupBy("cell_id").agg(F.min(value).alias("_least"), F.max("start_bp").alias("_end"))
    s = spots.join(trace_ranks(spots).select(*TRACE_KEY, "trace_rank"), TRACE_KEY).join(least, "cell_id").withColumn("_v", F.coalesce(value, "_least", F.lit(0.0)).cast("double"))
    s = s.join(percentiles(s, ["cell_id"], "_v", [0.05, 0.95]), "cell_id")
    share = F.try_divide(F.greatest(F.col("edges")[0], F.least(F.col("edges")[1], F.col("_v"))) - F.col("edges")[0], F.col("edges")[1] - F.col("edges")[0])
    scale = F.pow(F.lit(10.0), F.greatest(F.length(F.col("_end").cast("string")) - 3, F.lit(0)))
    placed = ranked(s.withColumn("beta", F.coalesce(999 * share, F.lit(0.0))).withColumn("occ", F.col("start_bp") / scale), [F.col(c).asc() for c in ("cell_id", "chrom", "trace_rank", "start_bp", "row_id")])
    first = placed.groupBy("cell_id").agg(F.min("place").alias("first"))
    s = placed.join(first, "cell_id").select("cell_id", (F.col("place") - F.col("first") + 1).alias("line_no"), "trace_rank", F.regexp_replace("chrom", "^chr", "").alias("res"), "x", "y", "z", "occ", "beta", F.when(F.col(value).isNull(), "Na").otherwise("O").alias("el"))
    line = F.format_string("ATOM  %5d %-4s%4s %s%4d    %8.3f%8.3f%8.3f%6.1f%6.1f          %2s", F.pmod("line_no", F.lit(100_000)), F.lit("CA"), F.col("res"), chain_letter(F.col("trace_rank")), F.abs("trace_rank"), F.col("x"), F.col("y"), F.col("z"), F.col("occ"), F.col("beta"), F.col("el"))
    return s.select("cell_id", "line_no", line.alias("line"))


def cmm_lines(spots: DataFrame, radius: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """A marker per spot and a link from each to the next of its group: the columns of ``by`` (a trace, if not given), line_no, line.

    With a cell and a feature's quantile, or a BED label, as group there is a file for each of them.
    """
    by = by or TRACE_KEY
    w = Window.partitionBy(*by).orderBy("start_bp", "row_id")
    s = spots.select(*by, "x", "y", "z", F.row_number().over(w).alias("k"), F.lead("row_id").over(w).alias("next"))
    marker = F.format_string('<marker id="%d" x="%.3f" y="%.3f" z="%.3f" radius="%.2f"/>', "k", "x", "y", "z", F.lit(radius))
    link = F.when(F.col("next").isNotNull(), F.format_string('<link id1="%d" id2="%d" radius="%.2f"/>', "k", F.col("k") + 1, F.lit(radius / 2)))
    each = F.array(F.struct((2 * F.col("k") - 1).alias("line_no"), marker.alias("line")), F.struct((2 * F.col("k")).alias("line_no"), link.alias("line")))
    return s.select(*by, F.inline(each)).where("line IS NOT NULL")


def write_lines(lines: DataFrame, path: str, by: list[str]) -> None:
    """One folder of text per cell (and further keys). Each file keeps the order of lines."""
    keep = [c for c in by]
    lines.repartition(*keep).sortWithinPartitions(*keep, "line_no").select(*keep, F.col("line").alias("value")).write.mode("errorifexists").partitionBy(*keep).text(path)
