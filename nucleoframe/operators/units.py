"""Quantities in different units: a hidden Markov model per file and axis, decoded block by block.

The hidden state is the unit in which the recording device writes. Evidence comes from what is
said (statements in header, comments and remark) and from the values themselves: in one unit
their logarithm follows a smooth level, the mean of the last values, so a switch of units shows as
a jump off it of the size of the ratio of both units. Where a file states the unit of an axis, as the
format demands, statements decide; where it states none, jumps do. A file of one block of lines is
decoded in one pass. In longer files, Viterbi's recursion is a product of max-plus matrices: blocks
are multiplied out on their own from the level they begin with, a short scan joins the blocks of a
file, and each block is then decoded from its known ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.session import cut_lineage, with_once
from nucleoframe.sources.fofct_lines import BLOCK, PIXEL, UNIT_SCALE, UNITS, coordinate, data_lines, unit_code

CODES = ["um", "nm", "mm", "px", "angstrom"]
AXES = ["x", "y", "z"]
_NEVER = -1e9


@dataclass(frozen=True)
class Evidence:
    """Weights in nats, distances in decades.

    ``switch`` is the price of a switch of units that nobody announced, ``stated`` the same in a file that
    states the unit of the axis. A value that lies off the level by ``sigma`` costs half a nat; up to
    ``reach``, as far as places in one unit may lie apart, it costs ``tail`` at most, so that
    no such jump pays for a switch; beyond that ``steep`` more per decade, and ``jump_most`` in all. The level is
    the mean of up to ``span`` values, not further back than a step of more than ``reach``.
    """

    switch: float = 12.0
    stated: float = 1e6
    sigma: float = 0.15
    tail: float = 4.0
    reach: float = 2.0
    steep: float = 40.0
    jump_most: float = 30.0
    span: int = 8

    def weight(self, off: np.ndarray) -> np.ndarray:
        far = np.abs(off)
        near = np.minimum(0.5 * (far / self.sigma) ** 2, self.tail)
        return -np.minimum(near + np.maximum(far - self.reach, 0) * self.steep, self.jump_most)


def with_statements(df: DataFrame, text: Column, names: dict[str, str]) -> DataFrame:
    """Add, for each axis, the place in CODES of the unit that a line or remark states for positions.

    A statement names positions (coordinate, position, x, y, z) and gives a unit behind the name.
    Pixel sizes, steps, shifts, residuals, diameters and thicknesses aren't statements; they and
    null texts give null. ``names`` has the columns to add.
    """
    unit = f"({UNITS})(?![a-zåµμ])"
    both = rf"(?:lateral(?: positions)?(?: \(x, ?y\))?|x and y|xy)(?:_unit)?(?: in| ?[:=])? ?{unit}[;,]?(?: and)? (?:axial(?: positions?)?(?: \(z\))?|z)(?:_unit)?(?: in| ?[:=])? ?{unit}"
    lateral_first = rf"lateral {unit} and axial {unit}"
    patterns = {
        "one": rf"(?:xyz[ _]?units?|coordinate[ _]?units?|position[ _]?units?|xyz|positions|coordinates)\s*[:=]\s*{unit}",
        "said": rf"(?:coordinates|positions|x, y and z)\b[^:=]*? (?:in|as) {unit}",
        **{a: rf"(?<![a-z]){a}[ _]?unit\s*[:=]\s*{unit}" for a in ("xy", "x", "y", "z")},
    }
    out = with_once(df, __low=F.lower(text))
    hit = lambda p, g=1: unit_code(F.regexp_extract("__low", p, g), CODES)
    out = with_once(out, **{f"__{n}": hit(p) for n, p in patterns.items()})
    out = with_once(out, __lateral=F.coalesce(hit(lateral_first, 1), hit(both, 1)), __axial=F.coalesce(hit(lateral_first, 2), hit(both, 2)))
    every = [F.col("__one"), F.col("__said")]
    single = {"x": ["__lateral", "__xy", "__x"], "y": ["__lateral", "__xy", "__y"], "z": ["__axial", "__z"]}
    out = out.withColumns({names[a]: F.coalesce(*[F.col(c) for c in single[a]], *every) for a in AXES})
    return out.drop("__low", "__lateral", "__axial", *[f"__{n}" for n in patterns])


def _log_scale(axis: int) -> np.ndarray:
    return np.array([math.log10(PIXEL[AXES[axis]] if c == "px" else UNIT_SCALE[c]) for c in CODES])


def observations(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row per line that states a unit or holds a coordinate, spread over (file_id, block):
    for each axis the unit stated (s), the value (v), the unit written on it (w) and the remark's (r), as places in CODES or -1."""
    remarks = with_statements(files.groupBy("file_id").agg(F.max("remark").alias("remark")), F.col("remark"), {a: f"r{a}" for a in AXES})
    extra = remarks.select("file_id", *[F.coalesce(f"r{a}", F.lit(-1)).cast("tinyint").alias(f"r{a}") for a in AXES])
    typed = data_lines(lines, extra)
    good = (F.col("kind") == "data") & (F.size("errors") == 0)
    none = F.lit(-1)
    kept = typed.select("file_id", "block", "block_count", "line_no", "line_id", "raw_line", "kind", "errors", "x", "y_text", "z_text", *[F.coalesce(f"r{a}", none).cast("tinyint").alias(f"r{a}") for a in AXES])
    kept = with_once(kept, y=F.when(good, coordinate(F.col("y_text"))), z=F.when(good, coordinate(F.col("z_text"))))
    kept = with_statements(kept, F.when(F.col("kind") != "data", F.col("raw_line")), {a: f"said_{a}" for a in AXES})
    said = {f"s{a}": F.coalesce(f"said_{a}", none).cast("tinyint") for a in AXES}
    values = {f"v{a}": F.when(good, F.col(f"{a}.value")) for a in AXES}
    written = {f"w{a}": F.coalesce(F.when(F.col(f"{a}.word") != "", F.when(good, unit_code(F.col(f"{a}.word"), CODES))), none).cast("tinyint") for a in AXES}
    out = with_once(kept, **said, **values, **written).drop("raw_line", "kind", "errors", "y_text", "z_text", *AXES, *[f"said_{a}" for a in AXES])
    seen = F.lit(False)
    for a in AXES:
        seen = seen | (F.col(f"s{a}") >= 0) | F.col(f"v{a}").isNotNull()
    return out.where(seen)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of a partition sorted by file, block and line, in runs of whole blocks."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= 100_000:
            keys = [(b.column(c).to_numpy(zero_copy_only=False), held[-1].column(c)[held[-1].num_rows - 1].as_py()) for c in ("file_id", "block")]
            new = np.nonzero((keys[0][0] != keys[0][1]) | (keys[1][0] != keys[1][1]))[0]
            if len(new):
                cut = int(new[0])
                if cut:
                    held.append(b.slice(0, cut))
                yield _arrays(held)
                held, rows, b = [], 0, b.slice(cut)
        held.append(b)
        rows += b.num_rows
    if held:
        yield _arrays(held)


def _arrays(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    out = {c: table.column(c).to_numpy() for c in table.column_names}
    new = np.ones(table.num_rows, bool)
    new[1:] = (out["file_id"][1:] != out["file_id"][:-1]) | (out["block"][1:] != out["block"][:-1])
    out["at"] = np.nonzero(new)[0]
    out["n"] = np.diff(np.append(out["at"], len(new)))
    return out


def _jumps(log: np.ndarray, first: np.ndarray, lead: list[np.ndarray] | None, e: Evidence) -> np.ndarray:
    """How far each known value lies off the level of the values before it in its sequence; NaN for the first.

    ``first`` has the number of each row's sequence, ``lead`` the last values before each sequence.
    """
    at = np.nonzero(~np.isnan(log))[0]
    who, value = first[at], log[at]
    ahead = 0
    if lead is not None:
        before = np.concatenate([*lead, np.zeros(0)])
        ahead = len(before)
        who, value = np.concatenate([np.repeat(np.arange(len(lead)), [len(v) for v in lead]), who]), np.concatenate([before, value])
    order = np.argsort(who, kind="stable")
    who, value = who[order], value[order]
    n = len(value)
    new = np.ones(n, bool)
    new[1:] = who[1:] != who[:-1]
    broken = new.copy()
    broken[1:] |= np.abs(np.diff(value)) > e.reach
    begin = np.maximum.accumulate(np.where(broken, np.arange(n), 0))
    lo = np.maximum(np.concatenate([[0], begin[:-1]]), np.arange(n) - e.span)
    total = np.concatenate([[0.0], np.cumsum(value)])
    known = np.nonzero(~new)[0]
    off = np.full(n, np.nan)
    off[known] = value[known] - (total[known] - total[lo[known]]) / (known - lo[known])
    out = np.full(len(log), np.nan)
    mine = order >= ahead
    out[at[order[mine] - ahead]] = off[mine]
    return out


def _logs(t: dict[str, np.ndarray], axis: int) -> np.ndarray:
    """Logarithms of an axis' values that are positive and without a unit of their own; else NaN."""
    value, written = t[f"v{AXES[axis]}"].astype(float), t[f"w{AXES[axis]}"]
    with np.errstate(all="ignore"):
        return np.where((value > 0) & (written < 0), np.log10(value), np.nan)


class _Chain:
    """The sequences of one axis, longest first, stepped through side by side."""

    def __init__(self, t: dict[str, np.ndarray], axis: int, e: Evidence):
        a = AXES[axis]
        at = t["at"]
        self.order = np.argsort(-t["n"], kind="stable")
        self.starts, self.length = at[self.order], t["n"][self.order]
        self.stated, self.written, self.value = t[f"s{a}"].astype(np.int64), t[f"w{a}"].astype(np.int64), t[f"v{a}"].astype(float)
        self.ratio = _log_scale(axis)[None, :] - _log_scale(axis)[:, None]
        self.e = e
        first = np.repeat(np.arange(len(at)), t["n"])
        lead = [np.asarray(t[f"lead{a}"][k], float) for k in at] if f"lead{a}" in t else None
        self.jump = _jumps(_logs(t, axis), first, lead, e)
        told = np.maximum(t[f"told{a}"][at], t[f"r{a}"][at]) if f"told{a}" in t else np.maximum(np.maximum.reduceat(self.stated, at), t[f"r{a}"][at])
        self.price = np.where(told >= 0, e.stated, e.switch)[first]

    def rounds(self) -> Iterator[np.ndarray]:
        for k in range(int(self.length[0]) if len(self.length) else 0):
            yield self.starts[: np.searchsorted(-self.length, -k, side="left")] + k

    def step(self, rows: np.ndarray) -> np.ndarray:
        """Log weight of going from unit i to unit j into each row. A statement leads all to its unit."""
        size = len(CODES)
        jump = self.jump[rows]
        out = self.e.weight(np.nan_to_num(jump)[:, None, None] + self.ratio)
        out[np.isnan(jump)] = 0
        out[:, ~np.eye(size, dtype=bool)] -= self.price[rows][:, None]
        said = np.nonzero(self.stated[rows] >= 0)[0]
        out[said] = _NEVER
        out[said, :, self.stated[rows[said]]] = 0
        return out

    def gains(self) -> np.ndarray:
        """Best log weight from each unit before a sequence to each unit at its end."""
        gain = np.repeat(np.where(np.eye(len(CODES)) > 0, 0.0, _NEVER)[None], len(self.starts), 0)
        for rows in self.rounds():
            m = len(rows)
            gain[:m] = np.max(gain[:m, :, :, None] + self.step(rows)[:, None], axis=2)
        back = np.empty_like(gain)
        back[self.order] = gain
        return back

    def decode(self, enter: np.ndarray, leave: np.ndarray | None = None) -> np.ndarray:
        """The best sequence of units from ``enter`` (to ``leave``, if given)."""
        score = np.full((len(self.starts), len(CODES)), _NEVER * 1e3)
        score[np.arange(len(score)), enter[self.order].astype(np.int64)] = 0
        came = np.zeros((len(self.stated), len(CODES)), np.int8)
        steps = []
        for rows in self.rounds():
            m = len(rows)
            both = score[:m, :, None] + self.step(rows)
            came[rows] = both.argmax(axis=1)
            score[:m] = both.max(axis=1)
            steps.append(rows)
        now = score.argmax(axis=1) if leave is None else leave[self.order].astype(np.int64)
        unit = np.zeros(len(self.stated), np.int64)
        for rows in reversed(steps):
            m = len(rows)
            unit[rows] = now[:m]
            now[:m] = came[rows, now[:m]]
        return unit


def _emit(t: dict[str, np.ndarray], axis: int, chain: _Chain, unit: np.ndarray) -> pa.RecordBatch:
    keep = np.nonzero(~np.isnan(chain.value))[0]
    final = np.where(chain.written >= 0, chain.written, unit)[keep]
    names = pa.DictionaryArray.from_arrays(pa.array(final.astype(np.int32)), pa.array(CODES)).dictionary_decode()
    axes = pa.DictionaryArray.from_arrays(pa.array(np.full(len(keep), axis, np.int32)), pa.array(AXES)).dictionary_decode()
    return pa.RecordBatch.from_arrays([pa.array(t["line_id"][keep]), axes, names, pa.array(chain.value[keep])], names=["line_id", "axis", "unit_code", "value"])


_DECODED = "line_id bigint, axis string, unit_code string, value double"


def _decode(e: Evidence, ends: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _windows(batches):
            for k, a in enumerate(AXES):
                chain = _Chain(t, k, e)
                unit = chain.decode(t[f"enter{a}"][t["at"]], t[f"leave{a}"][t["at"]]) if ends else chain.decode(np.maximum(t[f"r{a}"][t["at"]], 0))
                yield _emit(t, k, chain, unit)

    return decode


def _tails(e: Evidence):
    """The last logarithms of each block and axis."""

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _windows(batches):
            at, stop = t["at"], t["at"] + t["n"]
            out = [pa.array(t["file_id"][at]), pa.array(t["block"][at])]
            for k in range(len(AXES)):
                log = _logs(t, k)
                out.append(pa.array([log[a:b][~np.isnan(log[a:b])][-e.span :] for a, b in zip(at, stop)], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names=["file_id", "block", *[f"tail{a}" for a in AXES]])

    return tails


def _leads(e: Evidence):
    """For each block of one file the last logarithms before it: one row per block."""

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("block")
        out = [t.column("file_id").combine_chunks(), t.column("block").combine_chunks()]
        for a in AXES:
            held, rows = [], []
            for tail in t.column(f"tail{a}").to_pylist():
                rows.append(held)
                held = (held + tail)[-e.span :]
            out.append(pa.array(rows, pa.list_(pa.float64())))
        yield pa.RecordBatch.from_arrays(out, names=["file_id", "block", *[f"lead{a}" for a in AXES]])

    return leads


def _block_gains(e: Evidence):
    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _windows(batches):
            at = t["at"]
            cells = len(CODES) ** 2
            out = [pa.array(t["file_id"][at]), pa.array(t["block"][at])]
            for k, a in enumerate(AXES):
                gain = _Chain(t, k, e).gains().reshape(-1)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * cells), pa.array(gain)))
                out.append(pa.array(t[f"r{a}"][at]))
            yield pa.RecordBatch.from_arrays(out, names=["file_id", "block", "gx", "rx", "gy", "ry", "gz", "rz"])

    return gains


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one file: forward, then back, to the units before and at the end of each."""
    t = pa.Table.from_batches(list(batches)).sort_by("block")
    size, n = len(CODES), t.num_rows
    out = {"file_id": t.column("file_id").combine_chunks(), "block": t.column("block").combine_chunks()}
    for a in AXES:
        gain = np.array(t.column(f"g{a}").to_pylist()).reshape(n, size, size)
        score = np.full(size, _NEVER * 1e3)
        score[max(t.column(f"r{a}")[0].as_py(), 0)] = 0
        came = np.zeros((n, size), np.int64)
        for b in range(n):
            both = score[:, None] + gain[b]
            came[b], score = both.argmax(axis=0), both.max(axis=0)
            score = score - score.max()
        enter, leave = np.zeros(n, np.int8), np.zeros(n, np.int8)
        now = int(score.argmax())
        for b in range(n - 1, -1, -1):
            leave[b], now = now, int(came[b, now])
            enter[b] = now
        out[f"enter{a}"], out[f"leave{a}"] = pa.array(enter), pa.array(leave)
    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


_TAILS = "file_id bigint, block int, " + ", ".join(f"tail{a} array<double>" for a in AXES)
_LEADS = "file_id bigint, block int, " + ", ".join(f"lead{a} array<double>" for a in AXES)
_ENDS = "file_id bigint, block int, " + ", ".join(f"enter{a} tinyint, leave{a} tinyint" for a in AXES)
_GAINS = "file_id bigint, block int, " + ", ".join(f"g{a} array<double>, r{a} tinyint" for a in AXES)


def _whole_blocks(rows: DataFrame) -> DataFrame:
    """Rows sorted by file, block and line, each block in one partition.

    The window demands this of the planner. A repartition doesn't: it is dropped on top of a join
    by the same keys, and adaptive execution may then broadcast the other side and read the rows' shuffle
    locally, where blocks lie in parts.
    """
    by_line = Window.partitionBy("file_id", "block").orderBy("line_no")
    return rows.withColumn("place", F.row_number().over(by_line)).sortWithinPartitions("file_id", "block", "line_no")


def decode_units(lines: DataFrame, files: DataFrame, evidence: Evidence | None = None) -> DataFrame:
    """The unit of each X, Y and Z of the valid data lines, and its value in micrometres.

    Columns: line_id, axis, unit_code (um, nm, mm, px, angstrom), value, micrometres. A unit
    written on a value is the value's; the others have the decoded unit of their file and axis: the one stated
    last, or, in a file that states none for the axis, micrometre until the values jump to another.
    Null values, values that are no coordinates, and broken lines have no row; zero and negative
    values have a unit but give no evidence. Files without any statement start in micrometres, as
    do lines whose file isn't listed. Lines delivered twice count one by one; empty tables give
    an empty result.
    """
    e = evidence or Evidence()
    seen = observations(lines, files)
    out = _whole_blocks(seen.where("block_count = 1")).mapInArrow(_decode(e, False), _DECODED)
    if lines.where(F.col("line_no") >= BLOCK).limit(1).count():
        long = seen.where("block_count > 1")
        told = long.groupBy("file_id").agg(*[F.max(f"s{a}").alias(f"told{a}") for a in AXES])
        tails = _whole_blocks(long).mapInArrow(_tails(e), _TAILS)
        leads = tails.groupBy("file_id").applyInArrow(_leads(e), _LEADS).join(told, "file_id")
        long = cut_lineage(long.join(leads, ["file_id", "block"]))
        gains = _whole_blocks(long).mapInArrow(_block_gains(e), _GAINS)
        ends = gains.groupBy("file_id").applyInArrow(_scan, _ENDS)
        out = out.unionByName(_whole_blocks(long.join(ends, ["file_id", "block"])).mapInArrow(_decode(e, True), _DECODED))
    factor = F.when(F.col("unit_code") == "px", F.when(F.col("axis") == "z", F.lit(PIXEL["z"])).otherwise(F.lit(PIXEL["x"])))
    for code, scale in UNIT_SCALE.items():
        factor = factor.when(F.col("unit_code") == code, F.lit(scale))
    return out.withColumn("micrometres", F.col("value") * factor)
