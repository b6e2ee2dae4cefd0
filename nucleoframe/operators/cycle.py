"""Cell-cycle and replication analyses over tables of (cell_id, state, chrom, locus, copy_no, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoframe.operators.matrices import percentiles
from nucleoframe.operators.replication import by_group, by_volume, moments, population, solve_known_eps, solve_known_p
from nucleoframe.session import ranked, with_once


def _clipped(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def without_sex_chromosomes(cube: DataFrame) -> DataFrame:
    return cube.where(~F.col("chrom").isin("chrX", "chrY"))


def pooled_by_volume(counts: DataFrame, cells: DataFrame, window: int) -> DataFrame:
    """Per cell the moments pooled over the cells within window // 2 places of it by volume.

    Counts, sums and zeros are summed per cell first. Cells are placed without a global sort in
    one task, and each is sent to the blocks of places that its neighbours are in, so that a block
    is windowed by itself.
    """
    half = window // 2
    block = max(1024, window)
    per = counts.groupBy("cell_id").agg(F.count("value").alias("ns"), F.sum("value").alias("s"), F.count_if(F.col("value") == 0).alias("z"))
    placed = by_volume(cells.join(per, "cell_id").select("cell_id", "state", "volume", "ns", "s", "z")).drop("n")
    spread = placed.select("*", F.explode(F.sequence(F.floor((F.col("r") - half) / block), F.floor((F.col("r") + half) / block))).alias("block"))
    w = Window.partitionBy("block").orderBy("r").rangeBetween(-half, half)
    pooled = spread.select("cell_id", "state", "volume", "r", "block", *[F.sum(c).over(w).alias(c) for c in ("ns", "s", "z")]).where(F.floor(F.col("r") / block) == F.col("block"))
    return pooled.select("cell_id", "state", "volume", "r", F.col("ns").alias("nsamples"), F.try_divide("s", "ns").alias("n"), F.try_divide("z", "ns").alias("f"))


def per_cell(counts: DataFrame, cells: DataFrame, least_volume: float, window: int, by_size: bool = True) -> DataFrame:
    """Replication of each cell: efficiency of its state or, in S, from the mean efficiencies of G1
    and G2 cells larger than ``least_volume``: between them by volume, or their mean.

    p comes from the known efficiency and is clipped to 0..1; null without an anchor.
    """
    m = pooled_by_volume(counts, cells, window)
    own = F.when(F.col("state") == "G1", 1 - F.col("f")).when(F.col("state") == "G2", 1 - F.sqrt("f"))
    big = m.where(F.col("volume") > least_volume)
    a = big.agg(*[F.avg(F.when(F.col("state") == s, e)).alias(f"{k}{s}") for s in ("G1", "G2") for k, e in (("e", own), ("v", F.col("volume")))])
    share = _clipped(F.try_divide(F.col("volume") - F.col("vG1"), F.col("vG2") - F.col("vG1")))
    middle = F.col("eG1") + (F.col("eG2") - F.col("eG1")) * share if by_size else (F.col("eG1") + F.col("eG2")) / 2
    eps = F.when(F.col("state").isin("G1", "G2"), own).otherwise(middle)
    known = m.crossJoin(F.broadcast(a)).select("cell_id", "state", "volume", "nsamples", "n", "f", eps.alias("eps"))
    s = solve_known_eps(F.col("n"), F.col("f"), F.col("eps"))
    return known.select("*", _clipped(s["p"]).alias("p"), s["beta"].alias("beta"))


def by_quantile(counts: DataFrame, quantile: str) -> DataFrame:
    """Replication in S per quantile of a feature, shifted so that its mean is that of the population."""
    each = by_group(counts.where(F.col(quantile).isNotNull()), [quantile])
    whole = population(counts.where("state IS NOT NULL")).where("state = 'S'").select(_clipped(F.col("p")).alias("p_s"))
    mean = each.agg(F.avg("p").alias("p_mean"))
    return each.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(whole)).select(quantile, "n", "f", "eps", (F.col("p") + F.col("p_s") - F.col("p_mean")).alias("p"))


def by_cell_and_quantile(counts: DataFrame, quantile: str, cells: DataFrame) -> DataFrame:
    """Replication per cell and quantile of a feature: the cell's p times the quantile's over the quantiles' mean, clipped; efficiency and spots
    per copy follow from it. ``cells`` has cell_id and p."""
    q = by_quantile(counts, quantile).select(quantile, F.col("p").alias("p_q"))
    mean = q.agg(F.avg("p_q").alias("p_mean"))
    m = moments(counts.where(F.col(quantile).isNotNull()), ["cell_id", quantile]).select("cell_id", quantile, "nsamples", "n", "f")
    known = m.join(q, quantile).crossJoin(F.broadcast(mean)).join(cells.select("cell_id", F.col("p").alias("p_c")), "cell_id")
    known = known.withColumn("p", _clipped(F.try_divide(F.col("p_c") * F.col("p_q"), F.col("p_mean"))))
    s = solve_known_p(F.col("n"), F.col("f"), F.col("p"))
    return known.select("cell_id", quantile, "nsamples", "n", "f", "p", s["eps"].alias("eps"), s["beta"].alias("beta"))


def masked(counts: DataFrame, mask: Column) -> DataFrame:
    """Moments by state of the samples of a mask."""
    return moments(counts.where(mask), ["state"])


def biased_timing(counts: DataFrame) -> DataFrame:
    """Per locus the sum of S over the mean of all states."""
    return counts.groupBy("chrom", "locus").agg(F.try_divide(F.sum(F.when(F.col("state") == "S", F.col("value"))), F.avg("value")).alias("rt"))


def correlations(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlation per group over rows where both are finite; ties share the mean rank."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in (x, y)]
    kept = pairs.where(ok[0] & ok[1])
    for c in (x, y):
        same = Window.partitionBy(*by, c)
        kept = kept.withColumn(f"_{c}", F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(same) - 1) / 2)
    r = lambda a, b: F.nullif(F.corr(a, b), F.lit(float("nan")))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r(x, y).alias("pearson"), r(f"_{x}", f"_{y}").alias("spearman"))


def volume_splits(counts: DataFrame, cells: DataFrame, timing: DataFrame, steps: int) -> DataFrame:
    """How well each choice of shares of G1 (smallest) and G2 (largest cells) explains the timing.

    Cells fall into ``steps`` equal parts by volume; running sums over the parts of each locus give the sums of every
    choice of g1 and g2 parts from 0 to 2/5 each. Gives the correlation of means of S over means of G1 and G2 with
    the timing (chrom, locus, rt), over the loci where both are known.
    """
    part = F.floor((F.col("r") - 1) * steps / F.col("n")).cast("int")
    parts = by_volume(cells).select("cell_id", part.alias("part"))
    sums = counts.join(parts, "cell_id").groupBy("chrom", "locus", "part").agg(F.sum("value").alias("s"), F.count("value").alias("k"))
    each = sums.groupBy("chrom", "locus").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct(F.coalesce("s", F.lit(0.0)).alias("s"), "k")))).alias("m"))
    # One array of running sums per locus: entry i has the first i parts.
    def at(m: Column, p: Column, field: str, none: Column) -> Column:
        return F.coalesce(F.try_element_at(m, p)[field], none)

    grown = F.aggregate(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("k"))),
        lambda acc, p: F.array_append(acc, F.struct((F.element_at(acc, -1)["s"] + at(F.col("m"), p, "s", F.lit(0.0))).alias("s"), (F.element_at(acc, -1)["k"] + at(F.col("m"), p, "k", F.lit(0).cast("bigint"))).alias("k"))),
    )
    most = steps * 2 // 5
    run = with_once(each.select("chrom", "locus", "m"), run=grown).drop("m")
    pairs = run.withColumn("g1", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("g2", F.explode(F.sequence(F.lit(0), F.lit(most))))
    low, high, all_ = F.get("run", F.col("g1")), F.get("run", steps - F.col("g2")), F.get("run", F.lit(steps))
    s, k = ({f: (high[f] - low[f]) for f in ("s", "k")}[f] for f in ("s", "k"))
    sim = pairs.select("g1", "g2", "chrom", "locus", F.try_divide(F.try_divide(s, k), F.try_divide(all_["s"] - s, all_["k"] - k)).alias("sim"))
    both = sim.join(timing.where("rt IS NOT NULL"), ["chrom", "locus"]).where("sim IS NOT NULL")
    return both.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.nullif(F.corr("sim", "rt"), F.lit(float("nan"))).alias("r"))


def best_split(splits: DataFrame) -> DataFrame:
    """The choice with the greatest correlation, ties by the least g1 and g2 (one row, or none)."""
    return splits.where("r IS NOT NULL").orderBy(F.desc(F.round("r", 9)), "g1", "g2").limit(1)


def states_of_split(cells: DataFrame, split: DataFrame, steps: int) -> DataFrame:
    """The states that a split (g1, g2, one row) gives the cells."""
    part = F.floor((F.col("r") - 1) * steps / F.col("n"))
    state = F.when(part < F.col("g1"), "G1").when(part >= steps - F.col("g2"), "G2").otherwise("S")
    return by_volume(cells).crossJoin(F.broadcast(split.select("g1", "g2"))).select("cell_id", state.alias("state"))


def position_sensitivity(samples: DataFrame, least: int = 10, least_locales: int = 3) -> DataFrame:
    """Per locus how much of the replication left unexplained by time the locale explains.

    ``samples`` has chrom, locus, locale, t and y. Two nested linear models, y by t and y by t and
    locale, are compared through sums per locale: sensitivity = sqrt((rss_r - rss_f) / rss_r), with
    the F statistic. Loci with too few samples, locales or degrees of freedom have no row.
    """
    known = samples.where("locale IS NOT NULL AND t IS NOT NULL AND y IS NOT NULL AND NOT isnan(t) AND NOT isnan(y)")
    n = F.count(F.lit(1))
    inside = known.groupBy("chrom", "locus", "locale").agg(n.alias("k"), F.avg("t").alias("mt"), F.avg("y").alias("my"), (F.var_pop("t") * n).alias("tt"), (F.var_pop("y") * n).alias("yy"), (F.covar_pop("t", "y") * n).alias("ty"))
    whole = known.groupBy("chrom", "locus").agg(n.alias("n"), (F.var_pop("t") * n).alias("Tt"), (F.var_pop("y") * n).alias("Yy"), (F.covar_pop("t", "y") * n).alias("Ty"))
    within = inside.groupBy("chrom", "locus").agg(F.count(F.lit(1)).alias("n_locales"), *[F.sum(c).alias(f"w_{c}") for c in ("tt", "yy", "ty")])
    both = whole.select("chrom", "locus", "n", F.col("Tt").alias("s_tt"), F.col("Yy").alias("s_yy"), F.col("Ty").alias("s_ty")).join(within, ["chrom", "locus"])
    rss = lambda k: F.greatest(F.col(f"{k}_yy") - F.coalesce(F.try_divide(F.col(f"{k}_ty") * F.col(f"{k}_ty"), F.col(f"{k}_tt")), F.lit(0.0)), F.lit(0.0))
    gated = both.where((F.col("n") >= least) & (F.col("n_locales") >= least_locales) & (F.col("n") - F.col("n_locales") - 1 > 0))
    r = gated.select("chrom", "locus", "n", "n_locales", rss("s").alias("rss_r"), rss("w").alias("rss_f"))
    gain = F.greatest(F.col("rss_r") - F.col("rss_f"), F.lit(0.0))
    return r.select("chrom", "locus", "n", "n_locales", F.sqrt(F.try_divide(gain, F.col("rss_r"))).alias("sensitivity"), F.try_divide(gain / (F.col("n_locales") - 1), F.col("rss_f") / (F.col("n") - F.col("n_locales") - 1)).alias("f_stat"))


def threshold_sweep(judged: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Confusion counts and rates (percent) of ``score > threshold`` against a boolean truth, one row per threshold.

    Rows without truth or score don't count; a rate without cases is null.
    """
    known = judged.where(F.col(truth).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    count = lambda t, up, real: F.count_if(((F.col(score) > t) == F.lit(up)) & (F.col(truth) == F.lit(real)))
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), *[count(t, u, r).alias(n) for n, u, r in (("tp", True, True), ("fp", True, False), ("tn", False, False), ("fn", False, True))]) for t in thresholds])
    rate = lambda a, *b: F.try_divide(100.0 * F.col(a), sum((F.col(c) for c in b), F.col(a)))
    out = known.agg(rows.alias("rows")).select(F.inline("rows"))
    return out.select("*", F.try_divide(100.0 * (F.col("tp") + F.col("tn")), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), rate("tp", "fp").alias("ppv"), rate("tn", "fn").alias("npv"), rate("tp", "fn").alias("tpr"), rate("tn", "fp").alias("tnr"))


def replication_states(p: Column, low: float, high: float) -> Column:
    """1 below ``low``, 2 above ``high``, else 0."""
    return F.when(p < low, 1).when(p > high, 2).otherwise(0)


def yields(states: DataFrame, by: list[str]) -> DataFrame:
    """Shares of samples that are replicated (2), not replicated (1) and determined (either), per group."""
    n = F.count("rep_state")
    of = lambda s: F.try_divide(F.count_if(F.col("rep_state").isin(*s)), n)
    return states.groupBy(*by).agg(n.alias("n"), of([2]).alias("rep"), of([1]).alias("nonrep"), of([1, 2]).alias("determined"))


def states_by_mixture(profiles: DataFrame, seed: int = 0) -> DataFrame:
    """Cell states from two mixtures of two normal curves: low on the early loci is G1, high on the late is G2.

    ``profiles`` has cell_id, early and late (a cell's means over early and late loci); cells that
    miss one have no row. Both at once is ``NA``, neither is S.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    known = profiles.where("early IS NOT NULL AND late IS NOT NULL AND NOT isnan(early) AND NOT isnan(late)").select("cell_id", "early", "late")
    out = known
    for c in ("early", "late"):
        put = VectorAssembler(inputCols=[c], outputCol="v").transform(out)
        model = GaussianMixture(k=2, featuresCol="v", predictionCol=f"{c}_part", probabilityCol=f"{c}_p", seed=seed).fit(put)
        means = [g.mean[0] for g in model.gaussians]
        out = model.transform(put).withColumn(f"{c}_high", F.col(f"{c}_part") == int(means[1] >= means[0])).drop("v", f"{c}_part", f"{c}_p")
    g1, g2 = ~F.col("early_high"), F.col("late_high")
    return out.select("cell_id", F.when(g1 & g2, "NA").when(g1, "G1").when(g2, "G2").otherwise("S").alias("state"))


#: Most labelled rows the classifier is fitted on.
FIT_ROWS = 200_000


def replication_classifier(samples: DataFrame, features: list[str], categories: str, seed: int = 1, fit_rows: int = FIT_ROWS, rounds: int = 40, group: str | None = None) -> tuple[DataFrame, object]:
    """Boosted trees that tell replicated (G2) from unreplicated (G1) samples, and all samples with their probability.

    ``samples`` has cell_id, state and the features; ``categories`` is a small integer, ``group`` (a chromosome, say) a text
    that comes in as a category too. Cells, not samples, are split four to one by hash; the fit takes at most about ``fit_rows`` labelled rows of
    the larger part, a tenth of whose cells say when further rounds don't help. All rows whose features are known get ``probability``; ``held_out`` marks
    labelled rows of the cells not fitted on. Needs both labels; otherwise it raises ValueError.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = samples
    for c in features:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    known = known.where(F.col(categories) >= 0).withColumn("label", F.when(F.col("state") == "G1", 0.0).when(F.col("state") == "G2", 1.0))
    draw = F.pmod(F.xxhash64(F.coalesce("cell_id", F.lit("")), F.lit(seed)), F.lit(50))
    known = known.withColumn("held_out", (draw < 10) & F.col("label").isNotNull()).withColumn("_check", draw >= 46)
    train = known.where("label IS NOT NULL AND NOT held_out")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(sizes) < 2:
        raise ValueError("both G1 and G2 samples are needed")
    least = min(min(sizes.values()), fit_rows // 2)
    balanced = train.sampleBy("label", {k: min(1.0, least / v) for k, v in sizes.items()}, seed)
    both = balanced.groupBy("_check").agg(F.count_distinct("label").alias("n")).where("n = 2").count() == 2
    index = [StringIndexer(inputCol=group, outputCol="_group", handleInvalid="keep")] if group else []
    codes = [categories, *(["_group"] if group else [])]
    trees = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=rounds, maxDepth=4, seed=seed)
    if both:
        trees = trees.setValidationIndicatorCol("_check")
    model = Pipeline(stages=[*index, OneHotEncoder(inputCols=codes, outputCols=[f"_hot{k}" for k in range(len(codes))], handleInvalid="keep"), VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), VectorAssembler(inputCols=["_scaled", *[f"_hot{k}" for k in range(len(codes))]], outputCol="_v"), trees]).fit(balanced)
    scored = model.transform(known).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(*samples.columns, "label", "held_out", "probability"), model


def area_under_curve(scored: DataFrame, by: list[str]) -> DataFrame:
    """The area under the ROC curve per group: the share of pairs put in order, ties half.

    Counts per score come first; only they are ranked.
    """
    per = scored.where("label IS NOT NULL").groupBy(*by, "probability").agg(F.count_if(F.col("label") == 1).alias("up"), F.count_if(F.col("label") == 0).alias("down"))
    below = F.coalesce(F.sum("down").over(Window.partitionBy(*by).orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.select(*by, "up", "down", (F.col("up") * (below + F.col("down") / 2)).alias("won"))
    return won.groupBy(*by).agg(F.sum("up").alias("n_up"), F.sum("down").alias("n_down"), F.try_divide(F.sum("won"), F.sum("up") * F.sum("down").cast("double")).alias("auc"))


def phase_intervals(cells: DataFrame, groups: int) -> DataFrame:
    """Intervals of p that divide the S cells (state, p) into groups of the same size: part, lo, hi."""
    s = cells.where("state = 'S'").select(F.lit(1).alias("_all"), "p")
    edges = percentiles(s, ["_all"], "p", [k / groups for k in range(groups + 1)])
    return edges.select(F.inline(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda k: F.struct(k.alias("part"), F.get("edges", k).alias("lo"), F.get("edges", k + 1).alias("hi")))))


def by_phase(cells: DataFrame) -> DataFrame:
    """Cells (cell_id, state, volume, p) in the order of the cycle: G1 by volume, S by p, G2 by volume; ties by id, others have no place."""
    phase = F.when(F.col("state") == "G1", 0).when(F.col("state") == "S", 1).when(F.col("state") == "G2", 2)
    return ranked(cells.where(phase.isNotNull()), [phase.asc(), F.when(phase == 1, F.col("p")).otherwise(F.col("volume")).asc_nulls_last(), F.col("cell_id").asc()])


def stage(counts: DataFrame, cells: DataFrame, low: float, high: float) -> DataFrame:
    """Counts of the S cells whose p lies strictly between the limits."""
    return counts.join(cells.where((F.col("state") == "S") & (F.col("p") > low) & (F.col("p") < high)).select("cell_id"), "cell_id", "left_semi")


def resampled(wanted: DataFrame, pool: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(repeat, cell_id, picked): each wanted cell with one of the pool, anew in each repeat.

    In a repeat every cell of the pool is picked as often as any other, give or take one. Orders are
    hashes of the ids with the seed, so that the result doesn't depend on partitions.
    """

    def shuffled(ids: DataFrame, salt: int) -> DataFrame:
        each = ids.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
        placed = ranked(each, [F.col("repeat").asc(), F.xxhash64(F.lit(seed + salt), "repeat", "cell_id").asc(), F.col("cell_id").asc()])
        size = ids.agg(F.count(F.lit(1)).alias("n"))
        return placed.crossJoin(F.broadcast(size)).select("repeat", "cell_id", (F.col("place") - 1 - F.col("repeat") * F.col("n")).alias("k"), "n")

    a = shuffled(wanted, 0).select("repeat", "cell_id", "k")
    b = shuffled(pool, 1).select("repeat", F.col("cell_id").alias("picked"), F.col("k").alias("at"), "n")
    size = pool.agg(F.count(F.lit(1)).alias("m"))
    return a.crossJoin(F.broadcast(size)).withColumn("at", F.expr("CASE WHEN m > 0 THEN k % m END")).join(b, ["repeat", "at"]).select("repeat", "cell_id", "picked")


def bootstrap(counts: DataFrame, cells: DataFrame, mask: Column, repeats: int, least_volume: float = 0.0, seed: int = 0) -> DataFrame:
    """Replication of the masked samples of S cells, with efficiencies from random G1 and G2 cells at the same loci.

    ``cells`` has cell_id, state, volume and eps. In each repeat every S cell lends its mask to one G1 and
    one G2 cell larger than ``least_volume``; their efficiencies are moved by the difference of the cells' mean
    efficiencies, and their mean solves p. One row per repeat: eps and p, not clipped.
    """
    kept = counts.where(mask)
    s_cells = cells.where("state = 'S'").select("cell_id")
    masked = kept.join(s_cells, "cell_id", "left_semi").select("cell_id", "locus", "copy", "value")
    who = masked.select("cell_id").distinct()
    own = masked.agg(F.avg("value").alias("n"), F.avg((F.col("value") == 0).cast("double")).alias("f"))
    mean_eps = who.join(cells.select("cell_id", "eps"), "cell_id").agg(F.avg("eps").alias("eps_s"))
    sides = []
    for state in ("G1", "G2"):
        pool = cells.where((F.col("state") == state) & (F.col("volume") > least_volume))
        mapped = resampled(who, pool.select("cell_id"), repeats, seed + 2 * len(sides))
        there = counts.select(F.col("cell_id").alias("picked"), "locus", "copy", F.col("value").alias("v"))
        f = mapped.join(masked.select("cell_id", "locus", "copy"), "cell_id").join(there, ["picked", "locus", "copy"]).groupBy("repeat").agg(F.avg((F.col("v") == 0).cast("double")).alias("f"))
        shift = mapped.join(pool.select(F.col("cell_id").alias("picked"), "eps"), "picked").groupBy("repeat").agg(F.avg("eps").alias("pool_eps"))
        eps = _clipped(1 - F.col("f") if state == "G1" else 1 - F.sqrt("f"))
        sides.append(f.join(shift, "repeat").crossJoin(F.broadcast(mean_eps)).select("repeat", (eps + F.col("eps_s") - F.col("pool_eps")).alias(f"eps_{state}")))
    both = sides[0].join(sides[1], "repeat").select("repeat", ((F.col("eps_G1") + F.col("eps_G2")) / 2).alias("eps")).crossJoin(F.broadcast(own))
    return both.select("repeat", "eps", solve_known_eps(F.col("n"), F.col("f"), F.col("eps"))["p"].alias("p"))


def good_loci(loci: DataFrame, window: int, most_zeros: float, least_eps: float) -> DataFrame:
    """Loci (chrom, locus, f, eps) with sliding means, and whether few samples are 0 and the efficiency is high in the window."""
    w = Window.partitionBy("chrom").orderBy("locus").rangeBetween(-(window // 2), window // 2)
    slid = loci.select("chrom", "locus", F.avg("f").over(w).alias("f"), F.avg("eps").over(w).alias("eps"))
    return slid.withColumn("good", F.coalesce((F.col("f") < most_zeros) & (F.col("eps") > least_eps), F.lit(False)))


def sliding_probability(loci: DataFrame, window: int) -> DataFrame:
    """p = n / (eps beta) - 1 per locus from sliding means of n, eps and beta (chrom, locus, n, eps, beta)."""
    w = Window.partitionBy("chrom").orderBy("locus").rangeBetween(-(window // 2), window // 2)
    n, eps, beta = (F.avg(c).over(w) for c in ("n", "eps", "beta"))
    return loci.select("chrom", "locus", (F.try_divide(n, eps * beta) - 1).alias("p"))
