"""Line-by-line reading of FOF-CT files in plain Python, to hold the Spark operators against."""

from __future__ import annotations

import math
import re
from collections import defaultdict

REQUIRED = ("Trace_ID", "X", "Y", "Z", "Chrom", "Chrom_Start", "Chrom_End")
EDGES = '#" ,()[]{}\n\t'
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
WORDS = {}
for code, words in {
    "nm": "nm nanometer nanometers nanometre nanometres",
    "um": "um µm μm micron microns micrometer micrometers micrometre micrometres",
    "mm": "mm millimeter millimeters millimetre millimetres",
    "px": "px pixel pixels",
    "angstrom": "å angstrom angstroms",
}.items():
    WORDS |= {w: code for w in words.split()}
UNIT = "(" + "|".join(sorted(map(re.escape, WORDS), key=len, reverse=True)) + ")"
STATEMENTS = [
    (re.compile(rf"^\W*xyz_unit\s*=\s*{UNIT}\W*$", re.I), "xyz"),
    (re.compile(rf"^\W*xy_unit\s*=\s*{UNIT}\W*$", re.I), "xy"),
    (re.compile(rf"^\W*z_unit\s*=\s*{UNIT}\W*$", re.I), "z"),
    (re.compile(rf"(?:positions:|coordinates from here on in|positions below are written in|each spot are given in|coordinate_unit =|coordinates in|positions in|xyz:) ?{UNIT}\b", re.I), "xyz"),
]
PAIR = re.compile(rf"(?:lateral positions \(x, y\) in|x and y in|xy:|lateral) {UNIT}(?:; axial position \(z\) in|, z in|; z:| and axial) {UNIT}", re.I)
ROLES = {}
for role, names in {"Spot_ID": "Spot_ID spot_id SpotID Spot_Number Localization_ID", "Intensity": "Intensity Signal_Intensity Brightness intensity_au Lum", "Cell_ID": "Cell_ID cell_id CellID Cell_Label Nucleus_ID"}.items():
    ROLES |= {n: role for n in names.split()}


def stated(text):
    if m := PAIR.search(text):
        return {"x": WORDS[m[1].lower()], "y": WORDS[m[1].lower()], "z": WORDS[m[2].lower()]}
    for p, axes in STATEMENTS:
        if m := p.search(text):
            return {a: WORDS[m[1].lower()] for a in axes}
    return {}


def fields_of(line):
    """None if a quote isn't sound."""
    out, at = [], 0
    while True:
        while at < len(line) and line[at] in " \t":
            at += 1
        if line[at : at + 1] == '"':
            at += 1
            text = ""
            while True:
                if at >= len(line):
                    return None
                if line[at] == '"':
                    if line[at + 1 : at + 2] == '"':
                        text, at = text + '"', at + 2
                        continue
                    at += 1
                    break
                text, at = text + line[at], at + 1
            while at < len(line) and line[at] in " \t":
                at += 1
            if at < len(line) and line[at] != ",":
                return None
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            text = line[at:end]
            if '"' in text:
                return None
            at = end
        out.append(text.strip())
        if at >= len(line):
            return out
        at += 1


def coordinate(text):
    m = re.fullmatch(rf"({NUMBER.pattern})\s*{UNIT}?", text, re.I)
    if not m or not math.isfinite(float(m[1])):
        return None
    return float(m[1]), WORDS[m[4].lower()] if m[4] else None


def read(lines, remarks):
    """lines: (line_id, file_id, line_no, raw_line). Returns broken {line_id: reason}, units {(line_id, axis): code},
    and fields {file_id: {role: (name, type)}}."""
    files = defaultdict(list)
    for i, f, n, raw in lines:
        files[f].append((n, i, raw or ""))
    broken, units, kinds = {}, {}, {}
    for f, rows in files.items():
        names, now = None, {}
        rem = stated(remarks.get(f) or "")
        values = defaultdict(list)
        for _, i, raw in sorted(rows):
            if names is None:
                if all(k in raw for k in REQUIRED):
                    names = [n.strip(EDGES) for n in raw.partition("=")[2 if "=" in raw else 0].split(",")]
                else:
                    now.update(stated(raw))
                continue
            if not raw.strip():
                continue
            if "#" in raw[:2]:
                now.update(stated(raw))
                continue
            got = fields_of(raw)
            at = names.index
            if got is None:
                broken[i] = "quoting"
            elif len(got) != len(names):
                broken[i] = "column_count"
            elif not got[at("Trace_ID")]:
                broken[i] = "trace_id"
            elif not got[at("Chrom")].startswith("chr"):
                broken[i] = "chrom"
            elif not re.fullmatch("[0-9]+", got[at("Chrom_Start")]) or int(got[at("Chrom_Start")]) >= 2**63:
                broken[i] = "chrom_start"
            elif coordinate(got[at("X")]) is None:
                broken[i] = "x"
            else:
                for a in "xyz":
                    if c := coordinate(got[at(a.upper())]):
                        units[i, a] = c[1] or now.get(a) or rem.get(a) or "um"
                for n, v in zip(names, got):
                    if n in ROLES and v:
                        values[n].append(v)
        kinds[f] = {}
        for n in names or []:
            if n in ROLES:
                v = values[n]
                kinds[f][ROLES[n]] = (n, "integer" if all(re.fullmatch("[0-9]+", x) for x in v) else "decimal" if all(NUMBER.fullmatch(x) for x in v) else "text")
    return broken, units, kinds


def changes(kinds, files):
    """files: (file_id, series, released_at)."""
    out, last = set(), {}
    for f, series, _ in sorted(files, key=lambda r: (r[1], r[2], r[0])):
        now = kinds.get(f, {})
        if series in last:
            for role in ("Spot_ID", "Intensity", "Cell_ID"):
                a, b = last[series].get(role), now.get(role)
                if a and not b:
                    out.add((f, role, "removed"))
                elif b and not a:
                    out.add((f, role, "added"))
                elif a and b:
                    if a[0] != b[0]:
                        out.add((f, role, "renamed"))
                    if a[1] != b[1]:
                        out.add((f, role, "retyped"))
        last[series] = now
    return out
