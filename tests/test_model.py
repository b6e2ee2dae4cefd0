from nucleoframe.model import clean_spots, known_bp
from pyspark.sql import functions as F


def test_first_and_last_positions_are_known(spark):
    rows = [(0, True), (400_000_000, True), (-1, False), (400_000_001, False), (-999, False), (None, False)]
    df = spark.createDataFrame(rows, "p bigint, want boolean").withColumn("got", known_bp(F.col("p")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_placeholders_become_null_and_starts_of_0_stay(spark):
    genome = spark.createDataFrame([("chr1",)], "chrom string")
    rows = [(1, "chr1", 1.0, 1.0, 1.0, 0), (2, "chr9", float("nan"), 0.0, 200_000.0, -1), (3, None, float("inf"), None, 5.0, None)]
    got = {r["row_id"]: r for r in clean_spots(spark.createDataFrame(rows, "row_id bigint, chrom string, x double, y double, z double, start_bp bigint"), genome).collect()}
    assert got[1]["start_bp"] == 0 and got[1]["chrom"] == "chr1"
    assert all(got[2][c] is None for c in ("chrom", "x", "y", "z", "start_bp")) and got[3]["z"] == 5.0 and got[3]["x"] is None
