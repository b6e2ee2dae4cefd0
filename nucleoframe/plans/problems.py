"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nucleoframe.model import clean_spots, known_coord
from nucleoframe.operators.badrows import rejects, valid_rows
from nucleoframe.operators.donors import apply_fills, fill_missing
from nucleoframe.operators.drift import changes, consistent_rows, lifespans
from nucleoframe.operators.spatial import near_or_inside
from nucleoframe.operators.units import decode_units
from nucleoframe.session import table
from nucleoframe.sources.fofct_lines import ALIASES

NEAR_RADIUS = 0.0505


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots next to other spots or in a body."""
    spots = table(spark, sf_dir, "spots").where(known_coord(F.col("x")) & known_coord(F.col("y")) & known_coord(F.col("z")))
    found = near_or_inside(spots, NEAR_RADIUS, table(spark, sf_dir, "bodies"), differ=F.xxhash64("cell_id", "trace_id", "spot_id"))
    return found.select("near_kind", "row_id", "near_id")


P1_SQL = """
WITH s AS (
  SELECT row_id, cell_id, trace_id, spot_id, x, y, z,
         CAST(floor(x / 0.0505) AS BIGINT) gx, CAST(floor(y / 0.0505) AS BIGINT) gy
  FROM spots WHERE x > 0 AND x < 200000 AND y > 0 AND y < 200000 AND z > 0 AND z < 200000
), o AS (SELECT * FROM (VALUES (-1), (0), (1)) t(d)),
g AS (SELECT s.*, gx + a.d AS hx, gy + b.d AS hy FROM s, o a, o b)
SELECT 'spot' AS near_kind, s.row_id, g.row_id AS near_id
FROM s JOIN g ON s.gx = g.hx AND s.gy = g.hy AND s.row_id < g.row_id
WHERE (s.cell_id IS DISTINCT FROM g.cell_id OR s.trace_id IS DISTINCT FROM g.trace_id OR s.spot_id IS DISTINCT FROM g.spot_id)
  AND (s.x - g.x) * (s.x - g.x) + (s.y - g.y) * (s.y - g.y) + (s.z - g.z) * (s.z - g.z) <= 0.0505 * 0.0505
UNION ALL
SELECT 'body', s.row_id, b.body_id FROM s JOIN bodies b
ON s.x BETWEEN b.x_lo AND b.x_hi AND s.y BETWEEN b.y_lo AND b.y_hi AND s.z BETWEEN b.z_lo AND b.z_hi
"""


FILL_TARGETS = {"x": ["y", "z", "start_bp"], "start_bp": ["x", "y", "z"], "chrom": ["y", "z"]}


FILL_CODES = {"chrom": "chrom_code"}


def _fillable(spots: DataFrame, genome: DataFrame) -> DataFrame:
    """Spots with placeholders nulled; a chromosome's place in the genome stands for it in the model."""
    ranks = genome.select(F.col("chrom"), F.row_number().over(Window.orderBy(F.desc("length_bp"), "chrom")).alias("chrom_code"))
    return clean_spots(spots, genome).join(ranks, "chrom", "left").select("row_id", "cell_id", "trace_id", "chrom", "x", "y", "z", "start_bp", "chrom_code")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing x, start_bp and chrom of spots that other spots of the trace fill."""
    rows = _fillable(table(spark, sf_dir, "spots"), table(spark, sf_dir, "genome"))
    fills = fill_missing(rows, ["cell_id", "trace_id"], "row_id", FILL_TARGETS, FILL_CODES)
    return fills.select(F.col("id").alias("row_id"), "field_name")


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spots with x, start_bp and chrom filled where possible, marked, with their donors."""
    rows = _fillable(table(spark, sf_dir, "spots"), table(spark, sf_dir, "genome"))
    fills = fill_missing(rows, ["cell_id", "trace_id"], "row_id", FILL_TARGETS, FILL_CODES)
    return apply_fills(rows, fills, "row_id", {"x": "double", "start_bp": "bigint", "chrom": "string"})


P2_SQL = """
WITH s AS (
  SELECT row_id, cell_id, trace_id,
    CASE WHEN x > 0 AND x < 200000 THEN x END AS x,
    CASE WHEN start_bp BETWEEN 0 AND 400000000 THEN start_bp END AS start_bp,
    (SELECT max(g.chrom) FROM genome g WHERE g.chrom = spots.chrom) AS chrom
  FROM spots
), n AS (
  SELECT *, count(x) OVER w AS nx, count(start_bp) OVER w AS ns, count(chrom) OVER w AS nc
  FROM s WINDOW w AS (PARTITION BY cell_id, trace_id)
)
SELECT row_id, 'x' AS field_name FROM n WHERE x IS NULL AND nx > 0
UNION ALL SELECT row_id, 'start_bp' FROM n WHERE start_bp IS NULL AND ns > 0
UNION ALL SELECT row_id, 'chrom' FROM n WHERE chrom IS NULL AND nc > 0
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken data lines of FOF-CT files with the first reason that holds."""
    return rejects(table(spark, sf_dir, "fofct_lines")).select("line_id", "reason")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of Spot_ID, Intensity and Cell_ID from file to file of a series."""
    return changes(table(spark, sf_dir, "fofct_files"), table(spark, sf_dir, "fofct_lines"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of valid data lines whose unit isn't micrometre."""
    units = decode_units(table(spark, sf_dir, "fofct_lines"), table(spark, sf_dir, "fofct_files"))
    return units.where("unit_code <> 'um'").select("line_id", "axis", "unit_code")


def p7_micrometres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coordinate of the valid data lines in micrometres, with the unit it was recorded in."""
    units = decode_units(table(spark, sf_dir, "fofct_lines"), table(spark, sf_dir, "fofct_files"))
    return units.select("line_id", "axis", "unit_code", F.round("micrometres", 6).alias("micrometres"))


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid data lines as typed rows."""
    return valid_rows(table(spark, sf_dir, "fofct_lines")).select("line_id", "trace_id", "chrom", "start_bp", "x", "y", "z")


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid data lines of all files with Spot_ID, Intensity and Cell_ID in one form."""
    return consistent_rows(table(spark, sf_dir, "fofct_lines")).select("line_id", "spot_id", "intensity", "cell_id")


def p6_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each field of a series kept its name and type."""
    out = lifespans(table(spark, sf_dir, "fofct_files"), table(spark, sf_dir, "fofct_lines"))
    return out.select("series", "field_name", "column_name", "column_type", "first_file", "last_file", "n_files")


# Files and lines as TESTDATA describes them, in SQL: layouts, fields, reasons, types.
_FIELD = '[ \\t]*"(?:[^"]|"")*"[ \\t]*|[^",]*'
_NUM = "[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
_UNIT = "nm|nanomet(?:er|re)s?|um|µm|μm|microns?|micromet(?:er|re)s?|mm|millimet(?:er|re)s?|å|å|angstroms?|ångströms?|px|pixels?|planes?"
_AT = lambda n: f"trim(fs[list_position(names, '{n}')], ' ' || chr(9) || chr(13) || chr(10))"
_PLAIN = lambda t: f"CASE WHEN starts_with({t}, '\"') THEN trim(replace(substr({t}, 2, length({t}) - 2), '\"\"', '\"'), ' ' || chr(9) || chr(13) || chr(10)) ELSE {t} END"
_ROLE = lambda f: "(names[list_position(list_transform(names, lambda n: n IN (" + ", ".join(f"'{a}'" for a in ALIASES[f]) + ")), true)])"
_COORD = lambda t: f"CASE WHEN regexp_full_match(lower({t}), '({_NUM.replace('eE', 'e')})\\s*({_UNIT})?') AND abs(TRY_CAST(regexp_extract({t}, '^{_NUM}') AS DOUBLE)) < CAST('inf' AS DOUBLE) THEN TRY_CAST(regexp_extract({t}, '^{_NUM}') AS DOUBLE) END"
LINES_SQL = f"""
heads AS (
  SELECT file_id, min(line_no) AS columns_line, arg_min(raw_line, line_no) AS head FROM fofct_lines
  WHERE contains(raw_line, 'Trace_ID') AND contains(raw_line, 'X') AND contains(raw_line, 'Y') AND contains(raw_line, 'Z') AND contains(raw_line, 'Chrom') AND contains(raw_line, 'Chrom_Start') AND contains(raw_line, 'Chrom_End') GROUP BY 1
), named AS (
  SELECT file_id, columns_line, list_transform(string_split(CASE WHEN contains(head, '=') THEN substr(head, strpos(head, '=') + 1) ELSE head END, ','), lambda n: trim(n, '#" ,()[]{{}}' || chr(9) || chr(13) || chr(10))) AS names FROM heads
), dl AS (
  SELECT line_id, l.file_id, raw_line, names, contains(raw_line, '"') AS q, regexp_full_match(raw_line, '(?:{_FIELD})(?:,(?:{_FIELD}))*') AS sound
  FROM fofct_lines l JOIN named USING (file_id) WHERE line_no > columns_line AND trim(raw_line, ' ' || chr(9) || chr(13) || chr(10)) <> '' AND substr(raw_line, 1, 1) <> '#' AND substr(raw_line, 2, 1) <> '#'
), fl AS (
  SELECT *, CASE WHEN NOT q THEN string_split(raw_line, ',') WHEN sound THEN regexp_extract_all(',' || raw_line, ',({_FIELD})', 1) END AS fs FROM dl
), tx AS (
  SELECT *, {", ".join(f"{_PLAIN(_AT(n))} AS {a}" for n, a in (("Trace_ID", "tr"), ("Chrom", "ch"), ("Chrom_Start", "st"), ("X", "xt"), ("Y", "yt"), ("Z", "zt")))} FROM fl
), ln AS (
  SELECT *, {_COORD("xt")} AS xv, CASE WHEN fs IS NULL THEN 'quoting' WHEN len(fs) <> len(names) THEN 'column_count' WHEN coalesce(tr, '') = '' THEN 'trace_id' WHEN NOT starts_with(coalesce(ch, ''), 'chr') THEN 'chrom'
    WHEN NOT regexp_full_match(coalesce(st, ''), '[0-9]+') OR TRY_CAST(st AS BIGINT) IS NULL THEN 'chrom_start' WHEN {_COORD("xt")} IS NULL THEN 'x' END AS reason FROM tx
)"""
P4_SQL = f"WITH {LINES_SQL} SELECT line_id, reason FROM ln WHERE reason IS NOT NULL"
P4_ROWS_SQL = f"WITH {LINES_SQL} SELECT line_id, tr AS trace_id, ch AS chrom, CAST(st AS BIGINT) AS start_bp, xv AS x, {_COORD('yt')} AS y, {_COORD('zt')} AS z FROM ln WHERE reason IS NULL"
_VALUE = lambda f: f"nullif({_PLAIN('trim(fs[list_position(names, ' + _ROLE(f) + chr(41) + chr(93) + ', chr(32) || chr(9) || chr(13) || chr(10))')}, '')"
_FLOAT = f"CASE WHEN abs(TRY_CAST({{0}} AS DOUBLE)) < CAST('inf' AS DOUBLE) THEN TRY_CAST({{0}} AS DOUBLE) END"
P6_ROWS_SQL = f"WITH {LINES_SQL}, v AS (SELECT line_id, {_VALUE('Spot_ID')} AS spot_id, {_VALUE('Intensity')} AS light, {_VALUE('Cell_ID')} AS cell_id FROM ln WHERE reason IS NULL) SELECT line_id, spot_id, {_FLOAT.format('light')} AS intensity, cell_id FROM v"
_KINDS = " UNION ALL ".join(
    f"SELECT n.file_id, '{f}' AS field_name, {_ROLE(f)} AS column_name, k.{f} AS kind FROM named n LEFT JOIN (SELECT file_id, max(CASE WHEN t IS NULL OR regexp_full_match(t, '[0-9]+') THEN 0 WHEN regexp_full_match(t, '{_NUM}') THEN 1 ELSE 2 END) AS {f} FROM (SELECT file_id, {_VALUE(f)} AS t FROM ln WHERE reason IS NULL) GROUP BY 1) k USING (file_id)" for f in ALIASES
)
_CATALOGUE = f"""WITH {LINES_SQL}, kinds AS ({_KINDS}), grid AS (SELECT file_id, series, released_at, unnest(['Spot_ID', 'Intensity', 'Cell_ID']) AS field_name FROM fofct_files),
cat AS (SELECT series, file_id, released_at, field_name, column_name, CASE WHEN column_name IS NOT NULL THEN coalesce(kind, 0) END AS kind FROM grid LEFT JOIN kinds USING (file_id, field_name)),
seq AS (SELECT *, row_number() OVER w AS r, lag(column_name) OVER w AS last_name, lag(kind) OVER w AS last_kind FROM cat WINDOW w AS (PARTITION BY series, field_name ORDER BY released_at, file_id))"""
P6_SQL = f"""{_CATALOGUE} SELECT file_id, field_name, 'added' AS change_kind FROM seq WHERE r > 1 AND last_name IS NULL AND column_name IS NOT NULL
UNION ALL SELECT file_id, field_name, 'removed' FROM seq WHERE r > 1 AND last_name IS NOT NULL AND column_name IS NULL
UNION ALL SELECT file_id, field_name, 'renamed' FROM seq WHERE r > 1 AND last_name <> column_name
UNION ALL SELECT file_id, field_name, 'retyped' FROM seq WHERE r > 1 AND last_kind <> kind"""
P6_LIFESPANS_SQL = f"""{_CATALOGUE}, isl AS (SELECT *, sum(CASE WHEN column_name IS DISTINCT FROM last_name OR kind IS DISTINCT FROM last_kind THEN 1 ELSE 0 END) OVER (PARTITION BY series, field_name ORDER BY released_at, file_id) AS i FROM seq)
SELECT series, field_name, column_name, ['integer', 'decimal', 'text'][kind + 1] AS column_type, arg_min(file_id, r) AS first_file, arg_max(file_id, r) AS last_file, count(*) AS n_files FROM isl WHERE column_name IS NOT NULL GROUP BY series, field_name, i, column_name, kind"""


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_filled": p2_filled, "p4_found": p4_found, "p4_rows": p4_rows, "p6_found": p6_found, "p6_rows": p6_rows, "p6_lifespans": p6_lifespans, "p7_found": p7_found, "p7_micrometres": p7_micrometres}
ORACLES = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p4_rows": P4_ROWS_SQL, "p6_found": P6_SQL, "p6_rows": P6_ROWS_SQL, "p6_lifespans": P6_LIFESPANS_SQL}
