"""FOF-CT files kept as raw lines: layouts, typed checks and the split into rows and rejects.

A table of lines has file_id, line_no and raw_line. Its files are laid out in blocks of
``BLOCK`` lines; every join and window goes by (file_id, block), so that no single file,
however large, ends in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoframe.session import with_once

BLOCK = 4096

# --- fixed values of the format -------------------------------------------------------------
REQUIRED = ["Trace_ID", "X", "Y", "Z", "Chrom", "Chrom_Start", "Chrom_End"]
PLAIN_EXTRAS = ["Extra_Cell_ROI_ID", "Additional_Feature", "Gene_ID", "Readout_Round", "Fit_Sigma"]
ALIASES = {
    "Spot_ID": ["Spot_ID", "spot_id", "SpotID", "Spot_Number", "Localization_ID"],
    "Intensity": ["Intensity", "Signal_Intensity", "Brightness", "intensity_au", "Lum"],
    "Cell_ID": ["Cell_ID", "cell_id", "CellID", "Cell_Label", "Nucleus_ID"],
}
#: For a name that no alias lists: what it must hold to be the field.
HINTS = {"Cell_ID": "cell|nucle", "Intensity": "intens|bright|lum|signal|photon|light", "Spot_ID": "spot|locali[sz]ation|punct"}
UNIT_WORDS = {
    "nm": ["nm", "nanometer", "nanometers", "nanometre", "nanometres"],
    "um": ["um", "µm", "μm", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres"],
    "mm": ["mm", "millimeter", "millimeters", "millimetre", "millimetres"],
    "angstrom": ["å", "Å", "å", "angstrom", "angstroms", "ångström", "ångströms"],
    "px": ["px", "pixel", "pixels", "plane", "planes"],
}
#: Micrometres in one unit; a pixel is 108 nm in x and y, a z plane 200 nm.
UNIT_SCALE = {"nm": 1e-3, "um": 1.0, "mm": 1e3, "angstrom": 1e-4}
PIXEL = {"x": 0.108, "y": 0.108, "z": 0.2}
# --------------------------------------------------------------------------------------------

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
UNITS = "|".join(sorted((w for ws in UNIT_WORDS.values() for w in ws), key=lambda w: (-len(w), w)))
_FIELD = r'[ \t]*+"(?:[^"]++|"")*+"[ \t]*+|[^",]*+'
_SOUND = f"^(?:{_FIELD})(?:,(?:{_FIELD}))*+$"
_TEXTS = {"Trace_ID": "trace_text", "Chrom": "chrom_text", "Chrom_Start": "start_text", "X": "x_text", "Y": "y_text", "Z": "z_text"}
_EDGES = '#" ,()[]{}\t\r\n'


def block_of(line_no: Column) -> Column:
    return F.floor(line_no / BLOCK).cast("int")


def is_layout_line(line: Column) -> Column:
    """True for a line that holds all the required names."""
    out = line.contains("Trace_ID")
    for name in REQUIRED[1:]:
        out = out & line.contains(name)
    return out


def layout_names(line: Column) -> Column:
    """Column names of a layout line: what follows ``=``, without blanks and bracketing."""
    text = F.when(line.contains("="), F.regexp_replace(line, "^[^=]*=", "")).otherwise(line)
    return F.transform(F.split(text, ","), lambda n: F.btrim(n, F.lit(_EDGES)))


def field_of(name: Column) -> Column:
    """The one field that a column's name stands for, or null for required and plain columns."""
    out = F.when(name.isin(REQUIRED + PLAIN_EXTRAS), F.lit(None).cast("string"))
    for field, names in ALIASES.items():
        out = out.when(name.isin(names), F.lit(field))
    for field, hint in HINTS.items():
        out = out.when(F.lower(name).rlike(hint), F.lit(field))
    return out


def layouts(lines: DataFrame) -> DataFrame:
    """One row per file: the line of its columns, their names and roles, and how many lines it has.

    Files without a columns line have null names; all their lines are header.
    """
    heads = (
        lines.where(is_layout_line(F.col("raw_line")))
        .groupBy("file_id")
        .agg(F.min(F.struct("line_no", "raw_line")).alias("head"))
        .select("file_id", F.col("head.line_no").alias("columns_line"), layout_names(F.col("head.raw_line")).alias("names"))
    )
    heads = heads.withColumn("roles", F.transform("names", lambda n: F.coalesce(field_of(n), F.lit(""))))
    heads = heads.select("*", *[(F.array_position("names", n) - 1).cast("int").alias(f"at_{n}") for n in _TEXTS])
    sizes = lines.groupBy("file_id").agg(F.max("line_no").alias("last_line"))
    return sizes.join(heads, "file_id", "left")


def with_layout(lines: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Lines joined with the layout of their file, spread over (file_id, block)."""
    per_file = layouts(lines)
    if extra is not None:
        per_file = per_file.join(extra, "file_id", "left")
    per_block = per_file.withColumn("block", F.explode(F.sequence(F.lit(0), block_of(F.col("last_line"))))).withColumn("block_count", block_of(F.col("last_line")) + 1).drop("last_line")
    return lines.withColumn("block", block_of(F.col("line_no"))).join(per_block, ["file_id", "block"])


def _trimmed(text: Column) -> Column:
    """Without blanks around it; the common case has no blanks but spaces."""
    return F.when(text.rlike("[\\t\\r\\n]"), F.btrim(text, F.lit(" \t\r\n"))).otherwise(F.trim(text))


def plain_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add field values without blanks around them, and without the quotes of sound quoted fields."""
    out = with_once(df, **values)
    out = with_once(out, **{f"{n}__t": _trimmed(F.col(n)) for n in values}).drop(*values)
    inner = lambda t: _trimmed(F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"')))
    return with_once(out, **{n: F.when(F.col(f"{n}__t").startswith('"'), inner(F.col(f"{n}__t"))).otherwise(F.col(f"{n}__t")) for n in values}).drop(*[f"{n}__t" for n in values])


def data_lines(lines: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Data lines as nullable text columns with an array of errors.

    Adds kind (``header``, ``blank``, ``comment``, ``data``), the text of each required column, ``x``
    as value and unit, ``fields`` and ``names``, and ``errors``: reasons in the order of their precedence, null for
    lines that aren't data. Null lines count as blank. Lines delivered twice count one by one.
    """
    joined = with_layout(lines, extra)
    raw = F.col("raw_line")
    blank = raw.isNull() | (F.btrim(raw, F.lit(" \t\r\n")) == "")
    kind = (
        F.when(F.col("columns_line").isNull() | (F.col("line_no") <= F.col("columns_line")), "header")
        .when(blank, "blank")
        .when((F.substring(raw, 1, 1) == "#") | (F.substring(raw, 2, 1) == "#"), "comment")
        .otherwise("data")
    )
    quotes = raw.contains('"')
    sound = ~quotes | raw.rlike(_SOUND)
    fields = F.when(~quotes, F.split(raw, ",", -1)).when(sound, F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(f",({_FIELD})"), 1))
    out = with_once(joined, kind=kind)
    out = with_once(out, fields=F.when(F.col("kind") == "data", fields))
    out = plain_values(out, {alias: F.get("fields", F.col(f"at_{name}")) for name, alias in _TEXTS.items()}).drop(*[f"at_{n}" for n in _TEXTS])
    out = with_once(out, x=coordinate(F.col("x_text")))
    whole = F.size("fields") == F.size("names")
    start = F.col("start_text")
    rules = [
        ("quoting", F.col("fields").isNull()),
        ("column_count", ~whole),
        ("trace_id", whole & (F.coalesce("trace_text", F.lit("")) == "")),
        ("chrom", whole & ~F.coalesce(F.col("chrom_text").startswith("chr"), F.lit(False))),
        ("chrom_start", whole & ~F.coalesce(start.rlike("^[0-9]+$") & start.try_cast("bigint").isNotNull(), F.lit(False))),
        ("x", whole & F.col("x.value").isNull()),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for reason, bad in rules]))
    return with_once(out, errors=F.when(F.col("kind") == "data", errors))


def coordinate(text: Column) -> Column:
    """(value, word) of a finite decimal number with or without a unit behind it; null values for
    anything else. The word is the unit as written, in lower case, or empty."""
    number = F.regexp_extract(text, f"^{NUMBER}", 0)
    word = F.lower(F.ltrim(F.substr(text, F.length(number) + 1)))
    value = F.when((word == "") | unit_code(word).isNotNull(), number.try_cast("double"))
    return F.struct(F.when(F.abs(value) < float("inf"), value).alias("value"), word.alias("word"))


def unit_code(word: Column, codes: list[str] | None = None) -> Column:
    """nm, um, mm, angstrom or px for a unit's symbol or word in lower case (its place in ``codes``, if given);
    null for anything else."""
    pairs = [F.lit(v) for code, words in UNIT_WORDS.items() for w in dict.fromkeys(w.lower() for w in words) for v in (w, code if codes is None else codes.index(code))]
    return F.try_element_at(F.create_map(*pairs), word)
