"""Rows that fail to parse, apart from those that load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoframe.sources.fofct_lines import coordinate, data_lines


def rejects(lines: DataFrame) -> DataFrame:
    """Broken data lines with the first reason that holds and all that hold.

    Every column is loaded as nullable text; the rules fill an array of errors, and a line is
    broken where the array isn't empty. With unsound quoting or a wrong number of columns no
    later rule is judged.
    """
    bad = data_lines(lines).where(F.size("errors") > 0)
    return bad.select("line_id", "file_id", "line_no", "raw_line", F.get("errors", F.lit(0)).alias("reason"), "errors")


def valid_rows(lines: DataFrame) -> DataFrame:
    """Data lines without errors, typed. Y and Z that are no coordinates are null."""
    good = data_lines(lines).where("kind = 'data' AND size(errors) = 0")
    return good.select(
        "line_id", "file_id", "line_no", F.col("trace_text").alias("trace_id"), F.col("chrom_text").alias("chrom"), F.col("start_text").cast("bigint").alias("start_bp"), F.col("x.value").alias("x"), *[coordinate(F.col(f"{a}_text"))["value"].alias(a) for a in "yz"]
    )
