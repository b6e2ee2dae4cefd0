"""Spots from FOF-CT files: typed rows with the defaults of the format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.sources.fofct_lines import coordinate, data_lines, plain_values


def _named(name: str) -> Column:
    at = F.array_position("names", F.lit(name))
    return F.when(at > 0, F.get("fields", (at - 1).cast("int")))


def _in_role(field: str) -> Column:
    at = F.array_position("roles", F.lit(field))
    return F.when(at > 0, F.get("fields", (at - 1).cast("int")))


def fofct_spots(lines: DataFrame, scaling: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Spots of all valid data lines: line_id, file_id and the columns of ``model.SPOTS``.

    Coordinates are multiplied by ``scaling``. A file without Cell_ID has the trace as cell; a spot
    without Spot_ID is numbered from 1 by its order in the cell, whether others of the cell have an id or not. Light that is missing or no finite number is
    null, as are Y, Z and ends that aren't numbers, and the gene of a file without genes. Lines are numbered
    per block of lines first, so that a cell that fills a file isn't ordered in one task.
    """
    good = data_lines(lines).where("kind = 'data' AND size(errors) = 0")
    texts = {"_spot": _in_role("Spot_ID"), "_light": _in_role("Intensity"), "_cell": _in_role("Cell_ID"), "_gene": _named("Gene_ID"), "_end": _named("Chrom_End")}
    out = plain_values(good, texts)
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    light = F.col("_light").try_cast("double")
    place = {a: F.col("x.value") if a == "x" else coordinate(F.col(f"{a}_text"))["value"] for a in "xyz"}
    typed = out.select(
        "line_id", "file_id", "block", "line_no", F.coalesce(blank("_cell"), "trace_text").alias("cell_id"), F.col("chrom_text").alias("chrom"), F.col("trace_text").alias("trace_id"), blank("_spot").alias("spot_id"),
        *[(place[a] * F.lit(float(f))).alias(a) for a, f in zip("xyz", scaling)], F.col("start_text").cast("bigint").alias("start_bp"), F.col("_end").try_cast("bigint").alias("end_bp"), F.when(F.abs(light) < float("inf"), light).alias("lum"), blank("_gene").alias("gene_id"),
    )
    cell = ["file_id", "cell_id"]
    sizes = typed.groupBy(*cell, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*cell).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*cell, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(*cell, "block").orderBy("line_no", "line_id")) + F.col("before")
    return typed.join(offsets, [*cell, "block"]).withColumn("spot_id", F.coalesce("spot_id", number.cast("string"))).drop("block", "line_no", "before")


def repeated_spots(spots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Spot ids that occur more than once in a trace, which a container can't hold, with how often."""
    key = [*(by or []), "cell_id", "chrom", "trace_id", "spot_id"]
    return spots.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
