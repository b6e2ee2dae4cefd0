"""Missing values filled from similar records by predictive mean matching.

Within a group (a cell's trace, say) each record gets a prediction of the field from its other
numbers; a missing value is copied from the group's donor whose prediction is nearest, and the
donor's id comes along. Predictors are fitted per group, their slopes shrunk towards none where
the group is small.

Groups of usual size are shuffled once; moments and nearest donors are windows over the group.
Groups of more than ``HOT_ROWS`` records take another way to the same result: their moments are
folded before the shuffle, and their records are spread in ranges of the prediction, which are
equally full however the predictions lie and tie; the nearest donors before and behind a range come
from one row per range. So a group of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.session import cut_lineage

HOT_ROWS = 50_000
#: Ways in which the records of a large group are spread when they meet its moments.
SALTS = 64
#: Records at which a group's own slopes have half their weight.
SHRINK = 20.0
#: Predictions are compared in steps of this, so that the order of summation doesn't decide between donors.
STEP = 1e-6


def _pair(code: str, predictor: str) -> tuple[Column, Column]:
    both = F.col(code).isNotNull() & F.col(predictor).isNotNull()
    return F.when(both, F.col(code).cast("double")), F.when(both, F.col(predictor).cast("double"))


def _moments(targets: dict[str, list[str]], codes: dict[str, str]) -> dict[str, Column]:
    """Aggregates of a group: means, and per target and predictor its count, covariance and variance."""
    out = {}
    for t, ps in targets.items():
        code = codes.get(t, t)
        out[f"{t}__mean"] = F.avg(code)
        for p in ps:
            a, b = _pair(code, p)
            out[f"{p}__avg"] = F.avg(p)
            out[f"{t}__{p}__n"], out[f"{t}__{p}__cov"], out[f"{t}__{p}__var"] = F.count(a), F.covar_pop(a, b), F.var_pop(b)
    return out


def _prediction(target: str, predictors: list[str]) -> Column:
    """The group's mean plus the shrunken marginal slopes, each divided by the number of predictors, in steps.

    A null predictor counts as its group's mean; a target that no record of the group has predicts 0.
    """
    out = F.coalesce(f"{target}__mean", F.lit(0.0)).cast("double")
    for p in predictors:
        k = f"{target}__{p}"
        slope = F.coalesce(F.try_divide(F.col(f"{k}__cov"), F.col(f"{k}__var")), F.lit(0.0)) * F.col(f"{k}__n") / (F.col(f"{k}__n") + SHRINK)
        out = out + slope * F.coalesce(F.col(p).cast("double") - F.col(f"{p}__avg"), F.lit(0.0)) / len(predictors)
    return F.rint(out / STEP) + F.lit(0.0)


def _ordered(within: list[str], pred: str, lacking: Column) -> tuple[Window, Window]:
    """Up and down the predictions. Behind a record in either order come the donors nearest to it,
    the one with the smallest id last among equals; donors of the same prediction lie below."""
    up = Window.partitionBy(*within).orderBy(F.col(pred).asc(), lacking.asc(), F.col("_id").desc())
    down = Window.partitionBy(*within).orderBy(F.col(pred).desc(), lacking.desc(), F.col("_id").desc())
    return up.rowsBetween(Window.unboundedPreceding, Window.currentRow), down.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _usual(rows: DataFrame, group: list[str], targets: dict[str, list[str]], codes: dict[str, str]) -> DataFrame:
    whole = Window.partitionBy(*group)
    m = rows.select("*", *[c.over(whole).alias(n) for n, c in _moments(targets, codes).items()])
    seen = m.select(*group, "_id", *targets, *[_prediction(t, ps).alias(f"{t}__pred") for t, ps in targets.items()])
    for t in targets:
        lacking = F.col(t).isNull()
        donor = F.when(~lacking, F.struct(F.col(f"{t}__pred").alias("pred"), F.col("_id").alias("id"), F.col(t).cast("string").alias("value")))
        for side, order in zip(("below", "above"), _ordered(group, f"{t}__pred", lacking)):
            seen = seen.withColumn(f"{t}__{side}", F.when(lacking, F.last(donor, ignorenulls=True).over(order)))
    asked = [F.when(F.col(t).isNull(), F.struct(F.lit(t).alias("field_name"), F.col(f"{t}__pred").alias("pred"), F.col(f"{t}__below").alias("below"), F.col(f"{t}__above").alias("above"))) for t in targets]
    missing = seen.where(" OR ".join(f"`{t}` IS NULL" for t in targets))
    return _choose(missing.select("_id", F.explode(F.array_compact(F.array(*asked))).alias("f")).select("_id", "f.*"))


def _hot(rows: DataFrame, group: list[str], targets: dict[str, list[str]], codes: dict[str, str]) -> DataFrame:
    per_group = rows.groupBy(*group).agg(*[c.alias(n) for n, c in _moments(targets, codes).items()])
    spread = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(spread, [*group, "_salt"])
    asked = F.array(*[F.struct(F.lit(t).alias("field_name"), _prediction(t, ps).alias("pred"), F.col(t).cast("string").alias("value")) for t, ps in targets.items()])
    key = [*group, "field_name"]
    lacking = F.col("value").isNull()
    # Ranges of (group, field, prediction): balanced by sampling, and an id ends every tie.
    ranges = m.select(*group, "_id", F.inline(asked)).repartitionByRange(*key, "pred", lacking, "_id")
    placed = cut_lineage(ranges.withColumn("part", F.spark_partition_id()))
    donor = F.when(~lacking, F.struct("pred", F.col("_id").alias("id"), "value"))
    up, down = _ordered([*key, "part"], "pred", lacking)
    seen = placed.select(*key, "part", "_id", "pred", lacking.alias("lacking"), F.last(donor, ignorenulls=True).over(up).alias("below"), F.last(donor, ignorenulls=True).over(down).alias("above")).where("lacking")
    # The best donors of each range: one row per range, and per group and field in it.
    falling = F.when(~lacking, F.struct((-F.col("pred")).alias("fall"), F.col("_id").alias("id"), "value"))
    ends = placed.groupBy(*key, "part").agg(F.min(falling).alias("top"), F.min(donor).alias("low"))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*key).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, "part", F.min("top").over(earlier).alias("before"), F.min("low").over(later).alias("behind"))
    before = F.when(F.col("before").isNotNull(), F.struct((-F.col("before.fall")).alias("pred"), F.col("before.id").alias("id"), F.col("before.value").alias("value")))
    joined = seen.join(carried, [*key, "part"]).select("_id", "field_name", "pred", "below", "above", before.alias("before"), "behind")
    # Among equal predictions an earlier range has the smaller ids.
    below = F.when(F.col("below").isNull() | (F.col("before.pred") >= F.col("below.pred")), F.col("before")).otherwise(F.col("below"))
    return _choose(joined.select("_id", "field_name", "pred", below.alias("below"), F.coalesce("above", "behind").alias("above")))


def _choose(seen: DataFrame) -> DataFrame:
    lower = F.col("above").isNull() | (F.col("pred") - F.col("below.pred") <= F.col("above.pred") - F.col("pred"))
    nearer = F.when(F.col("below").isNotNull() & lower, F.col("below")).otherwise(F.col("above"))
    return seen.select("_id", "field_name", nearer.alias("d")).where("d IS NOT NULL").select(F.col("_id").alias("id"), "field_name", F.col("d.id").alias("donor_id"), F.col("d.value").alias("value"))


def fill_missing(rows: DataFrame, group: list[str], id_col: str, targets: dict[str, list[str]], codes: dict[str, str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fills for missing values: id, field_name, donor_id, value (as text).

    ``targets`` names for each field the numeric columns that predict it, ``codes`` the numeric
    column that stands for a categorical field in the model; missing values are null. A missing value whose group has no record with the field stays unfilled and has no
    row. Null group keys form no group. Of donors equally near the one with the smaller
    prediction is taken, of those with the same prediction the one with the smallest id, in groups of any size. Repeated rows are
    donors like others. Other columns of the table don't matter. An empty table gives an empty result.
    """
    codes = codes or {}
    used = dict.fromkeys([*targets, *(p for ps in targets.values() for p in ps), *codes.values()])
    keys = [f"_g{k}" for k in range(len(group))]
    whole = rows.dropna(subset=group).select(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(id_col).alias("_id"), *used)
    hot = cut_lineage(whole.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys))
    if hot.isEmpty():
        return _usual(whole, keys, targets, codes)
    return _usual(whole.join(hot, keys, "left_anti"), keys, targets, codes).unionByName(_hot(whole.join(hot, keys, "left_semi"), keys, targets, codes))


def apply_fills(rows: DataFrame, fills: DataFrame, id_col: str, targets: dict[str, str]) -> DataFrame:
    """Rows with filled fields, and ``<field>_filled`` and ``<field>_donor`` beside them.

    ``targets`` gives each field's type.
    """
    wide = fills.groupBy("id").agg(*[e for t in targets for e in (F.max(F.when(F.col("field_name") == t, F.col("value"))).alias(f"{t}__v"), F.max(F.when(F.col("field_name") == t, F.col("donor_id"))).alias(f"{t}_donor"))])
    out = rows.join(wide, rows[id_col] == wide["id"], "left").drop("id") if id_col != "id" else rows.join(wide, "id", "left")
    for t, kind in targets.items():
        out = out.withColumn(f"{t}_filled", F.col(f"{t}__v").isNotNull()).withColumn(t, F.coalesce(t, F.col(f"{t}__v").cast(kind))).drop(f"{t}__v")
    return out
