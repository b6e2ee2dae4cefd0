"""Contact maps: frequencies per bin pair and state, controls by distance, significance."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nucleoframe.model import TRACE_KEY
from nucleoframe.operators.spatial import pair_counts


def sample_contacts(spots: DataFrame, resolution: int, threshold: float, binarize: bool = False) -> DataFrame:
    """Per trace and bin pair (bin1 < bin2): all spot pairs n and those within the threshold c, or 1 for any.

    Pairs that are only present together are products of the bins' counts in a trace; only those within
    the threshold are looked for. Bin pairs without a spot pair have no row, and pairs in one bin don't count.
    """
    s = spots.select("row_id", *TRACE_KEY, "x", "y", "z", F.floor(F.col("start_bp") / resolution).cast("int").alias("bin"))
    bins = s.groupBy(*TRACE_KEY, "bin").agg(F.count(F.lit(1)).alias("k"))
    a, b = bins.alias("a"), bins.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in TRACE_KEY]
    none = F.lit(0).cast("bigint")
    both = a.join(b, [*same, F.col("a.bin") < F.col("b.bin")]).select(*[F.col(f"a.{c}").alias(c) for c in TRACE_KEY], F.col("a.bin").alias("bin1"), F.col("b.bin").alias("bin2"), (F.col("a.k") * F.col("b.k")).alias("n"), none.alias("c"))
    near = pair_counts(s, threshold, TRACE_KEY, ["bin"]).select(*TRACE_KEY, F.least("bin1", "bin2").alias("bin1"), F.greatest("bin1", "bin2").alias("bin2"), none.alias("n"), F.col("n").alias("c"))
    out = both.unionByName(near).groupBy(*TRACE_KEY, "bin1", "bin2").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return out.withColumns({k: F.least(F.col(k), F.lit(1)).cast("bigint") for k in ("n", "c")}) if binarize else out


def intra_contacts(spots: DataFrame, states: DataFrame, resolution: int, threshold: float, binarize: bool = False) -> DataFrame:
    """Per state (and ``all``), chromosome and bin pair: traces sampled, contact frequency and its variance.

    A sample is a trace (see ``sample_contacts``). Absent pairs count 0, so means are sums over the number of samples with any pair at all.
    """
    sample = sample_contacts(spots, resolution, threshold, binarize).join(states, "cell_id")
    both = sample.select("*", F.explode(F.array("state", F.lit("all"))).alias("group")).where("group IS NOT NULL")
    total = both.select("group", *TRACE_KEY).distinct().groupBy("group", "chrom").agg(F.count(F.lit(1)).alias("nsamples"))
    sums = both.groupBy("group", "chrom", "bin1", "bin2").agg(*[F.sum(e).cast("double").alias(k) for k, e in (("n", F.col("n")), ("c", F.col("c")), ("nn", F.col("n") * F.col("n")), ("cc", F.col("c") * F.col("c")))])
    t = F.col("nsamples")
    var = lambda x: F.try_divide(F.col(x * 2) - F.col(x) * F.col(x) / t, t - 1)
    f = F.col("c") / F.col("n")
    f_var = F.try_divide(var("c") - f * f * var("n"), F.col("n") * F.col("n") / t)
    return sums.join(total, ["group", "chrom"]).select(F.col("group").alias("state"), "chrom", "bin1", "bin2", "nsamples", f.alias("f"), f_var.alias("f_var"))


def control(contacts: DataFrame, bins: DataFrame, least: int = 100) -> DataFrame:
    """The mean frequency at a map's genomic distance; null where the maps have fewer than ``least`` entries at it.

    ``bins`` (chrom, n_bins) gives the size of each chromosome's map. Entries count in both triangles, whether a
    frequency is known or not.
    """
    gap = F.col("bin2") - F.col("bin1")
    sizes = bins.select("n_bins", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n_bins") - 1, F.lit(1)))).alias("gap"))
    entries = sizes.where("gap < n_bins").groupBy("gap").agg((2 * F.sum(F.col("n_bins") - F.col("gap"))).alias("entries"))
    means = contacts.groupBy("state", gap.alias("gap")).agg(F.avg("f").alias("mean")).join(entries, "gap")
    due = means.select("state", "gap", F.when(F.col("entries") >= least, F.col("mean")).alias("control"))
    return contacts.withColumn("gap", gap).join(due, ["state", "gap"], "left").drop("gap")


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function: a series near 0, a continued fraction beyond, to twelve digits."""
    z = np.abs(x)
    near = np.minimum(z, 1.5)
    term = total = near.copy()
    for k in range(1, 60):
        term = term * 2 * near * near / (2 * k + 1)
        total = total + term
    series = 1 - 2 / np.sqrt(np.pi) * np.exp(-near * near) * total
    far = np.maximum(z, 1.5)
    tail = far.copy()
    for k in range(80, 0, -1):
        tail = far + k / 2 / tail
    with np.errstate(under="ignore"):
        fraction = np.exp(-far * far) / np.sqrt(np.pi) / tail
    out = np.where(z < 1.5, series, fraction)
    return np.where(x < 0, 2 - out, out)


@F.pandas_udf(T.DoubleType())
def upper_tail(z):
    """Upper tail of the normal distribution; null for null and NaN."""
    import pandas as pd

    v = z.to_numpy(float)
    known = ~np.isnan(v)
    out = np.full(len(v), np.nan)
    out[known] = 0.5 * erfc(v[known] / np.sqrt(2))
    return pd.Series(out).where(known, None)


def rejected(tested: DataFrame, p: str, by: list[str], alpha: float) -> DataFrame:
    """Two-stage Benjamini-Hochberg within groups: adds ``significant``.

    The second stage runs at alpha / (1 + alpha) times m over the true nulls left by the first. The
    greatest rank that passes is an aggregate; ranks come from counts per p-value.
    """
    known = tested.where(F.col(p).isNotNull())
    counts = known.groupBy(*by, p).agg(F.count(F.lit(1)).alias("k"))
    ranks = counts.select(*by, p, F.sum("k").over(Window.partitionBy(*by).orderBy(p)).alias("rank"), F.sum("k").over(Window.partitionBy(*by)).alias("m"))
    level = alpha / (1 + alpha)
    first = ranks.groupBy(*by).agg(F.max(F.when(F.col(p) <= F.col("rank") / F.col("m") * level, F.col("rank"))).alias("r1"), F.first("m").alias("m0"))
    left = first.select(*by, (F.col("m0") - F.coalesce("r1", F.lit(0))).alias("nulls"))
    limit = ranks.join(left, by).groupBy(*by).agg(F.max(F.when((F.col("nulls") == 0) | (F.col(p) <= F.col("rank") / F.col("nulls") * level), F.col(p))).alias("limit"))
    return tested.join(limit, by, "left").withColumn("significant", F.coalesce(F.col(p) <= F.col("limit"), F.lit(False))).drop("limit")


def significance(contacts: DataFrame, bins: DataFrame, alpha: float = 0.05, effect: float = 0.5849625007211562, least: int = 100) -> DataFrame:
    """Contacts above their control: one-sided test, false discovery rate, and least log2 ratio.

    A map's two triangles are the same, so that ranks and numbers of tests both double and one triangle decides alike.
    """
    c = control(contacts, bins, least)
    z = F.try_divide(F.col("f") - F.col("control"), F.sqrt(F.when(F.col("f_var") > 0, F.col("f_var"))))
    tested = c.withColumn("p", upper_tail(z.cast("double")))
    out = rejected(tested, "p", ["state"], alpha)
    strong: Column = F.coalesce(F.log2(F.try_divide(F.col("f"), F.col("control"))) > effect, F.lit(False))
    return out.withColumn("significant", F.col("significant") & strong)


def inter_contacts(spots: DataFrame, states: DataFrame, resolution: int, threshold: float) -> DataFrame:
    """Per state (and ``all``) and bins of two chromosomes: spot pairs n, contacts c and frequency.

    Pairs that are only present together are products of the bins' counts in a cell; only pairs
    within the threshold are looked for.
    """
    s = spots.select("row_id", "cell_id", "chrom", "x", "y", "z", F.floor(F.col("start_bp") / resolution).cast("int").alias("bin"))
    bins = s.groupBy("cell_id", "chrom", "bin").agg(F.count(F.lit(1)).alias("k"))
    a, b = bins.alias("a"), bins.alias("b")
    both = a.join(b, [F.col("a.cell_id") == F.col("b.cell_id"), F.col("a.chrom") < F.col("b.chrom")]).select(F.col("a.cell_id").alias("cell_id"), *_ends(), (F.col("a.k") * F.col("b.k")).alias("n"), F.lit(0).cast("bigint").alias("c"))
    pairs = pair_counts(s, threshold, ["cell_id"], ["chrom", "bin"]).where("chrom1 <> chrom2")
    ordered = F.col("chrom1") < F.col("chrom2")
    ends = [F.when(ordered == first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}{i}") for i, first in ((1, True), (2, False)) for c in ("chrom", "bin")]
    near = pairs.select("cell_id", *ends, F.lit(0).cast("bigint").alias("n"), F.col("n").alias("c"))
    known = both.unionByName(near).groupBy("cell_id", "chrom1", "bin1", "chrom2", "bin2").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).join(states, "cell_id")
    each = known.select("*", F.explode(F.array("state", F.lit("all"))).alias("group")).where("group IS NOT NULL")
    out = each.groupBy("group", "chrom1", "bin1", "chrom2", "bin2").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return out.select(F.col("group").alias("state"), "chrom1", "bin1", "chrom2", "bin2", "n", "c", (F.col("c") / F.col("n")).alias("f"))


def _ends() -> list[Column]:
    return [F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in ("chrom", "bin")]


def rescaled(contacts: DataFrame) -> DataFrame:
    """Maps of all states brought to the mean frequency of ``all``: f by the ratio, f_var by its square."""
    mean = contacts.groupBy("state").agg(F.avg("f").alias("mean"))
    ratio = mean.join(mean.where("state = 'all'").select(F.col("mean").alias("goal"))).select("state", F.try_divide("goal", "mean").alias("ratio"))
    return contacts.join(ratio, "state").select(*[c for c in contacts.columns if c not in ("f", "f_var")], (F.col("f") * F.col("ratio")).alias("f"), (F.col("f_var") * F.col("ratio") * F.col("ratio")).alias("f_var"))


def adjusted_correlation(contacts: DataFrame, one: str, other: str, least: int) -> DataFrame:
    """The mean, over genomic distances with at least ``least`` bins, of the correlation of two states' maps (one row)."""
    a, b = (contacts.where(F.col("state") == s).select("chrom", "bin1", "bin2", F.col("f").alias(n)) for s, n in ((one, "fa"), (other, "fb")))
    far = a.join(b, ["chrom", "bin1", "bin2"]).where("fa IS NOT NULL AND fb IS NOT NULL").groupBy((F.col("bin2") - F.col("bin1")).alias("far")).agg(F.count(F.lit(1)).alias("n"), F.corr("fa", "fb").alias("r"))
    return far.where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r")).agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n_distances"))


def compartments(contacts: DataFrame, density: DataFrame, vectors: int = 5, least_share: float = 0.05) -> DataFrame:
    """Per state and chromosome the eigenvector of the correlated map over its control that follows
    the density (chrom, bin, density) best, turned its way and of length 1.

    ``contacts`` has f and control for bins bin1 < bin2. Of the first ``vectors`` eigenvectors only
    those that explain at least ``least_share`` of the variance are tried; a map without one has no rows. A group holds one
    chromosome's aggregated map, so its size is bounded by the genome.
    """
    import pandas as pd

    def one(maps: pd.DataFrame) -> pd.DataFrame:
        bins = np.unique(np.concatenate([maps["bin1"], maps["bin2"]]))
        at1, at2, n = np.searchsorted(bins, maps["bin1"]), np.searchsorted(bins, maps["bin2"]), len(bins)
        ratio = np.full((n, n), np.nan)
        ratio[at1, at2] = ratio[at2, at1] = (maps["f"] + 1e-10) / (maps["control"] + 1e-10)
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore")
            score = (ratio - np.nanmean(ratio, axis=1, keepdims=True)) / np.nanstd(ratio, axis=1, keepdims=True)
            score[~np.isfinite(score)] = 0
            c = np.nan_to_num(np.corrcoef(score)) if n > 1 else np.ones((1, 1))
        genes = np.full(n, np.nan)
        genes[at1], genes[at2] = maps["d1"], maps["d2"]
        known = ~np.isnan(genes)
        values, columns = np.linalg.eigh((c + c.T) / 2)
        best, fit = None, -1.0
        for k in range(1, min(vectors, n) + 1):
            v = columns[:, -k]
            if values[-k] / n < least_share or known.sum() < 2:
                continue
            with np.errstate(all="ignore"):
                r = np.corrcoef(v[known], genes[known])[0, 1]
            if np.abs(r) > fit:
                best, fit = v * (-1.0 if r < 0 else 1.0), np.abs(r)
        return pd.DataFrame({"state": maps["state"].iloc[0], "chrom": maps["chrom"].iloc[0], "bin": bins, "compartment": np.full(n, np.nan) if best is None else best})

    side = lambda k: density.select("chrom", F.col("bin").alias(f"bin{k}"), F.col("density").cast("double").alias(f"d{k}"))
    maps = contacts.select("state", "chrom", "bin1", "bin2", "f", "control").join(side(1), ["chrom", "bin1"], "left").join(side(2), ["chrom", "bin2"], "left")
    return maps.groupBy("state", "chrom").applyInPandas(one, "state string, chrom string, bin int, compartment double").where("compartment IS NOT NULL AND NOT isnan(compartment)")
