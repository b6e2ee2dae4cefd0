"""Schemas that drift between the files of a series, as a catalogue of column lifespans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.sources.fofct_lines import ALIASES, NUMBER, data_lines, layouts, plain_values

FIELDS = list(ALIASES)



def _in_role(values: str, field: str) -> Column:
    """The element of an array of a file's columns that has the field's role; null without one."""
    at = F.array_position("roles", field)
    return F.when(at > 0, F.get(F.col(values), (at - 1).cast("int")))


def _field_texts(good: DataFrame) -> DataFrame:
    """Add the text of each field, null where it is blank or the file lacks it."""
    out = plain_values(good, {f"{f}_text": _in_role("fields", f) for f in FIELDS})
    return out.withColumns({f"{f}_text": F.nullif(F.col(f"{f}_text"), F.lit("")) for f in FIELDS})


def footers(lines: DataFrame) -> DataFrame:
    """What a file's footer would say: per file and field its name and type.

    The type looks at the non-blank values of the valid data lines: integer if all are digits,
    else decimal if all are decimal numbers, else text. Flags are folded before the shuffle.
    """
    heads = layouts(lines).select("file_id", *[_in_role("names", f).alias(f"{f}_name") for f in FIELDS])
    good = data_lines(lines).where("kind = 'data' AND size(errors) = 0")
    good = _field_texts(good)
    rank = lambda t: F.when(t.isNull() | t.rlike("^[0-9]+$"), 0).when(t.rlike(f"^{NUMBER}$"), 1).otherwise(2)
    good = good.select("file_id", *[rank(F.col(f"{f}_text")).alias(f"{f}_kind") for f in FIELDS])
    flags = []
    for f in FIELDS:
        flags.append(F.max(F.col(f"{f}_kind")).alias(f"{f}_kind"))
    seen = good.groupBy("file_id").agg(*flags)
    return heads.join(seen, "file_id", "left")


def catalogue(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file and field of its series: name, type, and the same of the file before it.

    A series is in order of released_at, then file_id. Files without a columns line have no
    field. Columns: series, file_id, rank, field_name, column_name, column_type, and last_ of both.
    """
    foot = footers(lines)
    wide = files.select("file_id", "series", "released_at").join(foot, "file_id", "left")
    kind = lambda f: F.when(F.col(f"{f}_name").isNotNull(), F.element_at(F.array(*[F.lit(k) for k in ("integer", "decimal", "text")]), F.coalesce(f"{f}_kind", F.lit(0)) + 1))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_name").alias("column_name"), kind(f).alias("column_type")) for f in FIELDS]))
    long = wide.select("series", "file_id", "released_at", fields.alias("f")).select("series", "file_id", "released_at", "f.*")
    order = Window.partitionBy("series", "field_name").orderBy("released_at", "file_id")
    return long.select("*", F.row_number().over(order).alias("rank"), F.lag("column_name").over(order).alias("last_name"), F.lag("column_type").over(order).alias("last_type"))


def changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every change of a field against the file before it in its series.

    added, removed, renamed, retyped; the last two only if both files have the field, and both
    may hold. The first file of a series has no change.
    """
    c = catalogue(files, lines).where("rank > 1")
    now, before = F.col("column_name"), F.col("last_name")
    kinds = F.array_compact(
        F.array(
            F.when(before.isNull() & now.isNotNull(), F.lit("added")),
            F.when(before.isNotNull() & now.isNull(), F.lit("removed")),
            F.when(before != now, F.lit("renamed")),
            F.when(F.col("last_type") != F.col("column_type"), F.lit("retyped")),
        )
    )
    return c.select("file_id", "field_name", F.explode(kinds).alias("change_kind"))


def lifespans(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Islands of files in which a field keeps its name and type: first and last file, and how many.

    Columns: series, field_name, column_name, column_type, first_file, last_file, n_files, started, ended.
    """
    c = catalogue(files, lines)
    order = Window.partitionBy("series", "field_name").orderBy("released_at", "file_id")
    broke = (~F.col("column_name").eqNullSafe(F.col("last_name")) | ~F.col("column_type").eqNullSafe(F.col("last_type"))).cast("int")
    marked = c.withColumn("island", F.sum(broke).over(order)).where("column_name IS NOT NULL")
    return marked.groupBy("series", "field_name", "island", "column_name", "column_type").agg(
        F.min_by("file_id", "rank").alias("first_file"), F.max_by("file_id", "rank").alias("last_file"), F.count(F.lit(1)).alias("n_files"), F.min("released_at").alias("started"), F.max("released_at").alias("ended")
    ).drop("island")


def consistent_rows(lines: DataFrame) -> DataFrame:
    """Valid data lines of all files with Spot_ID and Cell_ID as text and Intensity as double.

    The casts come from the alias table: whatever a file calls the field, its value lands in
    the one column; values that are no finite number leave Intensity null.
    """
    good = data_lines(lines).where("kind = 'data' AND size(errors) = 0")
    good = _field_texts(good)
    value = {f: F.col(f"{f}_text") for f in FIELDS}
    number = value["Intensity"].try_cast("double")
    return good.select("line_id", "file_id", "line_no", value["Spot_ID"].alias("spot_id"), F.when(F.abs(number) < float("inf"), number).alias("intensity"), value["Cell_ID"].alias("cell_id"))
