import random

from pyspark.sql import functions as F

from nucleoframe.llm.splits import assign_splits, cell_key, components, related_pairs

WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def roots(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {a: find(a) for a in parent}


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(2)
    edges = [(f"p{k:03}", f"p{k + 1:03}") for k in range(60)] + [("s0", f"s{k}") for k in range(1, 40)] + [("l", "l")]
    edges += [(f"r{rnd.randrange(60):02}", f"r{rnd.randrange(60):02}") for _ in range(40)]
    got = components(spark.createDataFrame([*edges, ("x", None)], "a string, b string"))
    assert {r["node"]: r["root"] for r in got.collect()} == roots(edges)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_keys(spark):
    same = ["7_12_rep1", "000007_0012_REP01", " Cell 7-12-r1", "c.7..12.replicate1:tagB", "7:12:Rep1 TAG2"]
    rows = spark.createDataFrame([(s,) for s in [*same, "7_12_rep2", "unsegmented", " ", None, "odd Label"]], "l string").select(cell_key(F.col("l")).alias("k")).collect()
    assert [r["k"] for r in rows] == ["7_12_1"] * 5 + ["7_12_2", None, None, None, "odd label"]


def test_pairs_and_splits(spark):
    links = spark.createDataFrame([("1_1_rep1", "2_2_rep1"), ("2_2_r1", "3_3_rep1"), ("4_4_rep1", None), ("4_4_rep1", "unsegmented")], "a string, b string")
    records = spark.createDataFrame([(1, "1_1_rep1", "G1", "x"), (2, "3-3-REP1", "S", "x"), (3, "4_4_rep1", None, "x"), (4, None, "G2", "x"), (5, "unsegmented", "S", "x"), (6, "1_1_rep1", "g-1", "x")], "id bigint, label string, st string, root string")
    assert [tuple(r) for r in related_pairs(records.select("label"), links).collect()] == [("1_1_rep1", "3-3-REP1")]
    got = {r["id"]: r["split"] for r in assign_splits(records.drop("root"), "id", "label", "st", links, WEIGHTS).collect()}
    assert len(got) == 6 and got[1] == got[2] == got[6]


def test_proportions(spark):
    records = spark.range(20_000).select("id", F.concat(F.floor(F.col("id") / 5).cast("string"), F.lit("_1_rep1")).alias("label"), F.when(F.col("id") % 3 == 0, "S").otherwise("G1").alias("st"))
    links = spark.createDataFrame([], "a string, b string")
    shares = {r["split"]: r["count"] / 20_000 for r in assign_splits(records, "id", "label", "st", links, WEIGHTS).groupBy("split").count().collect()}
    assert all(abs(shares[s] - w) < 0.02 for s, w in WEIGHTS.items())
