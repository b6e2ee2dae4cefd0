import random

import pytest

from nucleoframe.operators.donors import apply_fills, fill_missing

SCHEMA = "row_id bigint, g string, x double, y double, s bigint, c string, code int"


@pytest.mark.parametrize("hot", [50_000, 20])
def test_every_missing_value_with_a_donor_is_filled_from_its_group(spark, hot):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        g = None if i % 50 == 0 else "big" if i % 3 else f"g{i % 40}"
        y = None if rnd.random() < 0.1 else rnd.uniform(0, 10)
        x = None if rnd.random() < 0.2 or y is None else 2 * y
        c = None if rnd.random() < 0.2 else f"k{i % 2}"
        rows.append((i, g, x, y, None if rnd.random() < 0.3 else i, c, None if c is None else i % 2))
    rows += [(900 + k, "tie", None if k % 2 else 5.0, 1.0, 7, "k0", 0) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = {"x": ["y"], "s": ["y"], "c": ["y"]}
    fills = {(r["id"], r["field_name"]): r for r in fill_missing(df, ["g"], "row_id", targets, {"c": "code"}, hot).collect()}
    by = {r[0]: r for r in rows}
    at = {"x": 2, "s": 4, "c": 5}
    want = {(r[0], f) for r in rows for f, k in at.items() if r[1] is not None and r[k] is None and any(o[1] == r[1] and o[k] is not None for o in rows)}
    assert set(fills) == want
    for (i, f), r in fills.items():
        donor = by[r["donor_id"]]
        assert donor[1] == by[i][1] and str(donor[at[f]]) == r["value"]


def test_nearest_prediction_wins_and_marks(spark):
    df = spark.createDataFrame([(k, "a", float(k), float(k), k, "q", 1) for k in range(30)] + [(99, "a", None, 12.2, None, None, None)], SCHEMA)
    fills = fill_missing(df, ["g"], "row_id", {"x": ["y"]})
    row = fills.collect()[0]
    assert (row["id"], row["donor_id"], float(row["value"])) == (99, 12, 12.0)
    out = apply_fills(df, fills, "row_id", {"x": "double"}).where("row_id = 99").collect()[0]
    assert out["x"] == 12.0 and out["x_filled"] and out["x_donor"] == 12


def plain(rows, fields):
    """Donor of each missing value by trying all donors: fields map a name to its place and its predictor's."""
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for members in groups.values():
        for f, (at, by) in fields.items():
            known = [r[at] for r in members if r[at] is not None]
            mean = sum(known) / len(known) if known else 0.0
            both = [(r[at], r[by]) for r in members if r[at] is not None and r[by] is not None]
            middle = [r[by] for r in members if r[by] is not None]
            slope = 0.0
            if both:
                ma, mb = sum(a for a, _ in both) / len(both), sum(b for _, b in both) / len(both)
                var = sum((b - mb) ** 2 for _, b in both)
                slope = sum((a - ma) * (b - mb) for a, b in both) / var * len(both) / (len(both) + 20.0) if var else 0.0
            pred = {r[0]: round((mean + slope * (0 if r[by] is None else r[by] - sum(middle) / len(middle))) * 1e6) for r in members}
            for r in members:
                donors = [d for d in members if d[at] is not None]
                if r[at] is None and donors:
                    d = min(donors, key=lambda d: (abs(pred[d[0]] - pred[r[0]]), pred[d[0]], d[0]))
                    out[r[0], f] = (d[0], str(d[at]))
    return out


@pytest.mark.parametrize("width", ["1", "7"])
def test_groups_of_any_size_have_the_same_donors(spark, width):
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        g = "third" if i % 3 == 0 else f"g{i % 7}"
        y = None if rnd.random() < 0.1 else float(rnd.randrange(12)) if i % 2 else 1e6 * rnd.random()
        rows.append((i, g, None if rnd.random() < 0.4 else float(rnd.randrange(9)), y, None if rnd.random() < 0.4 else rnd.randrange(5), None, None))
    rows += [(2000 + k, "flat", None if k == 7 else float(k), 4.0, 1, None, None) for k in range(30)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        runs = [{(r["id"], r["field_name"]): (r["donor_id"], r["value"]) for r in fill_missing(df, ["g"], "row_id", {"x": ["y"], "s": ["y"]}, None, hot).collect()} for hot in (20, 50_000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1] == plain(rows, {"x": (2, 3), "s": (4, 3)})
    assert runs[0][2007, "x"] == (2000, "0.0")


def test_clashing_names_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0, 0, 5, 5), (2, "a", 3.0, 1.0, 0, 5, 5)], "row_id bigint, g string, x double, y double, id int, pred int, value int")
    assert [tuple(r) for r in fill_missing(df, ["g"], "row_id", {"x": ["y"]}).collect()] == [(1, "x", 2, "3.0")]


def test_empty(spark):
    assert fill_missing(spark.createDataFrame([], SCHEMA), ["g"], "row_id", {"x": ["y"]}).count() == 0
