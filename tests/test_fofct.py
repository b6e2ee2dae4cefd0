import datetime
import random

from nucleoframe.operators.badrows import rejects, valid_rows
from nucleoframe.operators.drift import changes, consistent_rows, lifespans
from nucleoframe.operators.units import decode_units
from nucleoframe.session import table
from tests.brute_fofct import changes as brute_changes
from tests.brute_fofct import read

LINES = "line_id bigint, file_id bigint, line_no int, raw_line string"
FILES = "file_id bigint, series string, released_at timestamp, remark string"
DATA = "/root/testdata/sf0.01"
HEAD = "##columns=(Spot_ID, Trace_ID, X,Y,Z, Chrom,Chrom_Start,Chrom_End)"


def lines(spark, *raw, file_id=1):
    return spark.createDataFrame([(file_id * 100_000 + k, file_id, k, r) for k, r in enumerate(raw, 1)], LINES)


def files(spark, *remarks):
    return spark.createDataFrame([(k, "s", datetime.datetime(2024, 1, k), r) for k, r in enumerate(remarks, 1)], FILES)


def test_whole_tables_against_plain_reading(spark):
    ln, fl = table(spark, DATA, "fofct_lines"), table(spark, DATA, "fofct_files")
    rows = fl.select("file_id", "series", "released_at", "remark").collect()
    broken, units, kinds = read([tuple(r) for r in ln.select("line_id", "file_id", "line_no", "raw_line").collect()], {r[0]: r[3] for r in rows})
    assert {(r["line_id"], r["reason"]) for r in rejects(ln).collect()} == set(broken.items())
    assert {(r["line_id"], r["axis"]): r["unit_code"] for r in decode_units(ln, fl).collect()} == units
    assert {tuple(r) for r in changes(fl, ln).collect()} == brute_changes(kinds, [r[:3] for r in rows])


def test_reasons(spark):
    raw = ["#x", HEAD, '1,7,1 nm,2,3,chr1,5,6', '1,"7,8",1e1,,z,"chr""1",05,', '1,7,1,2,3,chr1,5', '1,"7,1,2,3,chr1,5,6', "1, ,1,2,3,chr1,5,6", "1,7,1,2,3,Chr1,5,6", "1,7,1,2,3,chr1,99999999999999999999,6", "1,7,inf,2,3,chr1,5,6", "1,7,1 parsec,2,3,chr1,5,6", "", "  ", ' #,7', None, '1,7,1e999,2,3,chr1,5,6']
    got = {r["line_no"]: r["reason"] for r in rejects(lines(spark, *raw)).collect()}
    assert got == {5: "column_count", 6: "quoting", 7: "trace_id", 8: "chrom", 9: "chrom_start", 10: "x", 11: "x", 16: "x"}
    good = {r["line_no"]: r for r in valid_rows(lines(spark, *raw)).collect()}
    assert set(good) == {3, 4} and good[4]["trace_id"] == "7,8" and good[4]["chrom"] == 'chr"1' and good[4]["start_bp"] == 5 and good[4]["z"] is None


def test_empty_and_headless(spark):
    none = spark.createDataFrame([], LINES)
    assert rejects(none).count() == 0 and changes(files(spark), none).count() == 0 and decode_units(none, files(spark)).count() == 0
    assert rejects(lines(spark, "just", "text")).count() == 0


def test_very_long_quoted_field(spark):
    long = '"' + "a,\"\"" * 50_000 + '"'
    got = rejects(lines(spark, HEAD, f"{long},7,1,2,3,chr1,5,6", f"{long}x,7,1,2,3,chr1,5,6")).collect()
    assert [(r["line_no"], r["reason"]) for r in got] == [(3, "quoting")]


def test_blocks_of_a_long_file_agree_with_one_block(spark, monkeypatch):
    raw = [HEAD]
    for k in range(300):
        if k % 70 == 10:
            raw.append(f"#positions: {('nm', 'px', 'mm')[k // 70 % 3]}, stage frame")
        raw.append(f"{k},7,{100 + k % 5}.5,{5 if k % 9 else '6 nm'},{k % 4 - 1},chr1,5,6")
    ln, fl = lines(spark, *raw), files(spark, "Exported with coordinates in Angstroms.")
    one = {(r["line_id"], r["axis"]): r["unit_code"] for r in decode_units(ln, fl).collect()}
    assert one == read([tuple(r) for r in ln.collect()], {1: "Exported with coordinates in Angstroms."})[1]
    for m in ("nucleoframe.sources.fofct_lines.BLOCK", "nucleoframe.operators.units.BLOCK"):
        monkeypatch.setattr(m, 16)
    many = {(r["line_id"], r["axis"]): r["unit_code"] for r in decode_units(ln, fl).collect()}
    assert many == one


def test_jumps_alone_reveal_a_switch(spark, monkeypatch):
    # Nothing is stated: the values are a thousandfold for a while. Places wander, and leap by half a decade.
    rnd = random.Random(8)
    raw, want = [HEAD], {}
    for k in range(120):
        nm = 40 <= k < 80
        place = (90 if k % 30 < 15 else 400) + rnd.gauss(0, 5)
        raw.append(f"{k},7,{place * (1000 if nm else 1)},{place / 30},1,chr1,5,6")
        want |= {(k, "x"): "nm" if nm else "um", (k, "y"): "um", (k, "z"): "um"}
    ln, fl = lines(spark, *raw), files(spark, None)
    decode = lambda: {(r["line_id"] % 100_000 - 2, r["axis"]): r["unit_code"] for r in decode_units(ln, fl).collect()}
    assert decode() == want
    for block in (16, 7):
        for m in ("nucleoframe.sources.fofct_lines.BLOCK", "nucleoframe.operators.units.BLOCK"):
            monkeypatch.setattr(m, block)
        assert decode() == want


def test_statements_outweigh_values(spark):
    raw = [HEAD, "#positions: nm, stage frame"] + [f"{k},7,{300 * (1000 if 40 <= k < 80 else 1)},1,1,chr1,5,6" for k in range(120)]
    assert {r["unit_code"] for r in decode_units(lines(spark, *raw), files(spark, None)).collect()} == {"nm"}
    raw = [HEAD] + [f"{k},7,{300 * (1000 if 40 <= k < 80 else 1)},1,1,chr1,5,6" for k in range(120)]
    assert {r["unit_code"] for r in decode_units(lines(spark, *raw), files(spark, "XYZ: mm")).collect()} == {"mm"}
    assert {r["unit_code"] for r in decode_units(lines(spark, *raw), files(spark, "XYZ: um")).collect()} == {"um"}


def test_drift_table_and_lifespans(spark):
    a = lines(spark, HEAD, "1,7,1,2,3,chr1,5,6", file_id=1)
    b = lines(spark, HEAD.replace("Spot_ID", "SpotID").replace("Chrom_End", "Chrom_End,Lum"), "x1,7,1,2,3,chr1,5,6,2.5", file_id=2)
    fl, ln = files(spark, None, None), a.unionByName(b)
    assert {tuple(r) for r in changes(fl, ln).collect()} == {(2, "Spot_ID", "renamed"), (2, "Spot_ID", "retyped"), (2, "Intensity", "added")}
    assert {(r["spot_id"], r["intensity"]) for r in consistent_rows(ln).collect()} == {("1", None), ("x1", 2.5)}
    assert {(r["field_name"], r["column_name"], r["n_files"]) for r in lifespans(fl, ln).collect()} == {("Spot_ID", "Spot_ID", 1), ("Spot_ID", "SpotID", 1), ("Intensity", "Lum", 1)}


def test_units_of_files_spread_over_parts(spark, tmp_path):
    # One statement in the middle of each file; a part of a file by itself would start from the remark.
    rows, want = [], {}
    for f in range(1, 201):
        data = [f"{k},{'7' * 200},1.5,2.5,3.5,chr1,5,6" for k in range(20)]
        raw = [HEAD, *data, f"#positions: {('nm', 'mm')[f % 2]}", *data]
        rows += [(f * 1000 + n, f, n, r) for n, r in enumerate(raw, 1)]
        want |= {(f * 1000 + n, a): ("px" if n < 22 else ("nm", "mm")[f % 2]) for n in range(2, 43) if n != 22 for a in "xyz"}
    random.Random(5).shuffle(rows)
    spark.createDataFrame(rows, LINES).repartition(8).write.parquet(f"{tmp_path}/lines")
    fl = spark.createDataFrame([(f, "s", datetime.datetime(2024, 1, 1), "Exported with coordinates in pixels.") for f in range(1, 201)], FILES)
    # Lines are too large to broadcast and layouts are not: known only at run time, the join reads the lines' shuffle locally.
    named = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.localShuffleReader.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "512k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        got = {(r["line_id"], r["axis"]): r["unit_code"] for r in decode_units(spark.read.parquet(f"{tmp_path}/lines"), fl).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want
