"""The replication model: moments of spot counts per group and their closed-form solution."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nucleoframe.session import ranked


def moments(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per group of (…, value = spots at a locus and copy): samples, mean n, its variance, share f of zeros, its variance, and their covariance."""
    ns, n, f = F.count("value"), F.avg("value"), F.avg((F.col("value") == 0).cast("double"))
    out = counts.groupBy(*by).agg(ns.alias("nsamples"), n.alias("n"), F.try_divide(F.var_samp("value"), ns).alias("n_var"), f.alias("f"))
    return out.withColumn("f_var", F.try_divide(F.col("f") * (1 - F.col("f")), F.col("nsamples"))).withColumn("nf_cov", F.try_divide(-F.col("n") * F.col("f"), F.col("nsamples")))


def solve_g1(n: Column, f: Column) -> dict[str, Column]:
    eps = 1 - f
    return {"p": F.lit(0.0), "eps": eps, "beta": F.try_divide(n, eps)}


def solve_g2(n: Column, f: Column) -> dict[str, Column]:
    eps = 1 - F.sqrt(f)
    return {"p": F.lit(1.0), "eps": eps, "beta": F.try_divide(n, 2 * eps)}


def solve_known_eps(n: Column, f: Column, eps: Column) -> dict[str, Column]:
    p = F.try_divide(1 - eps - f, eps * (1 - eps))
    return {"p": p, "eps": eps, "beta": F.try_divide(n, (1 + p) * eps)}


def solve_known_p(n: Column, f: Column, p: Column) -> dict[str, Column]:
    root = F.pow(1 + p, F.lit(2.0)) - 4 * p * (1 - f)
    eps = F.when(p == 0, 1 - f).otherwise(F.try_divide(1 + p - F.sqrt(F.when(root >= 0, root)), 2 * p))
    return {"p": p, "eps": eps, "beta": F.try_divide(n, (1 + p) * eps)}


def solve_known_beta(n: Column, f: Column, beta: Column) -> dict[str, Column]:
    """From D = n / beta; where the root is not real the sample counts as fully replicated."""
    d = F.try_divide(n, beta)
    x = 1 - F.try_divide(4 * (f + d - 1), d * d)
    eps = F.when(x < 0, 1 - F.sqrt(f)).otherwise(d / 2 * (1 + F.sqrt(F.when(x >= 0, x))))
    return {"p": F.when(x < 0, F.lit(1.0)).otherwise(F.try_divide(d, eps) - 1), "eps": eps, "beta": beta}


def population(counts: DataFrame) -> DataFrame:
    """Moments and solution by state; S is solved with the mean efficiency of G1 and G2 (three rows)."""
    m = moments(counts, ["state"])
    n, f = F.col("n"), F.col("f")
    g1, g2 = solve_g1(n, f), solve_g2(n, f)
    eps = m.agg(F.avg(F.when(F.col("state") == "G1", g1["eps"]).when(F.col("state") == "G2", g2["eps"])).alias("eps_s"))
    s = solve_known_eps(n, f, F.col("eps_s"))
    pick = lambda k: F.when(F.col("state") == "G1", g1[k]).when(F.col("state") == "G2", g2[k]).otherwise(s[k])
    return m.join(eps).select("state", "nsamples", "n", "f", *[pick(k).alias(k) for k in ("p", "eps", "beta")])


def by_group(counts: DataFrame, group: list[str]) -> DataFrame:
    """S-phase replication probability per group (locus, quantile, ...), clipped to 0..1; null where nothing can be concluded."""
    m = moments(counts, [*group, "state"])
    eps = F.when(F.col("state") == "G1", 1 - F.col("f")).when(F.col("state") == "G2", 1 - F.sqrt("f"))
    anchors = m.groupBy(*group).agg(F.avg(eps).alias("eps"))
    s = m.where("state = 'S'").join(anchors, group)
    p = solve_known_eps(F.col("n"), F.col("f"), F.col("eps"))["p"]
    return s.select(*group, "n", "f", "eps", F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias("p"))


def simulated_timing(counts: DataFrame) -> DataFrame:
    """Per locus the mean of S over the mean of G1 and G2."""
    s, g = F.avg(F.when(F.col("state") == "S", F.col("value"))), F.avg(F.when(F.col("state").isin("G1", "G2"), F.col("value")))
    return counts.groupBy("chrom", "locus").agg(F.try_divide(s, g).alias("rt"))


def by_volume(cells: DataFrame) -> DataFrame:
    """Cells with a known volume, their place r by volume (ties by id), and how many n there are."""
    known = cells.where(F.col("volume").isNotNull() & ~F.isnan("volume"))
    return ranked(known, [F.col("volume").asc(), F.col("cell_id").asc()], "r").crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("n"))))


def states_by_volume(cells: DataFrame, g1_share: float, g2_share: float) -> DataFrame:
    """The smallest cells are G1, the largest G2, the rest S."""
    state = F.when(F.col("r") <= F.floor(F.col("n") * g1_share), "G1").when(F.col("r") > F.col("n") - F.floor(F.col("n") * g2_share), "G2").otherwise("S")
    return by_volume(cells).select("cell_id", state.alias("state"))


def welch(cube: DataFrame, group_col: str, a: str, b: str, by: list[str]) -> DataFrame:
    """Welch's t and its degrees of freedom between two groups."""
    def side(g: str, k: str) -> list[Column]:
        v = F.when(F.col(group_col) == g, F.col("value"))
        return [F.avg(v).alias(f"m{k}"), F.var_samp(v).alias(f"v{k}"), F.count(v).alias(f"n{k}")]

    s = cube.groupBy(*by).agg(*side(a, "a"), *side(b, "b"))
    ea, eb = F.try_divide(F.col("va"), F.col("na")), F.try_divide(F.col("vb"), F.col("nb"))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb))
    df = F.try_divide((ea + eb) * (ea + eb), F.try_divide(ea * ea, F.col("na") - 1) + F.try_divide(eb * eb, F.col("nb") - 1))
    return s.select(*by, t.alias("t"), df.alias("dof"))


def _beta_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, 1/2), by Simpson's rule in the angle.

    With x = cos(t)^2 the integrand is 2 cos(t)^(2a - 1), which is smooth; large a sharpen it, so the
    rule runs over the part where it isn't 0.
    """
    edge = np.arccos(np.sqrt(np.clip(x, 0, 1)))
    reach = np.minimum(np.pi / 2, edge + 12 / np.sqrt(np.maximum(2 * a - 1, 1)) + np.where(a < 40, np.pi, 0))
    steps = np.linspace(0, 1, 2001)
    t = edge[:, None] + (reach - edge)[:, None] * steps
    with np.errstate(divide="ignore", invalid="ignore"):
        height = np.exp((2 * a - 1)[:, None] * np.log(np.maximum(np.cos(t), 1e-300)))
    weight = np.where(np.arange(2001) % 2, 4.0, 2.0)
    weight[[0, -1]] = 1.0
    area = 2 * (reach - edge) * (height @ weight) / 6000
    log_beta = np.array([math.lgamma(v) + math.lgamma(0.5) - math.lgamma(v + 0.5) for v in a.tolist()])
    return area / np.exp(log_beta)


@F.pandas_udf(T.DoubleType())
def t_tails(t, dof):
    """Both tails of Student's distribution beyond t; null where either is null."""
    import pandas as pd

    known = (t.notna() & dof.notna() & (dof > 0)).to_numpy()
    out = np.full(len(t), np.nan)
    if known.any():
        d = dof.to_numpy(float)[known]
        out[known] = _beta_tail(d / 2, d / (d + t.to_numpy(float)[known] ** 2))
    return pd.Series(out).where(known, None)


def differential(cube: DataFrame, group_col: str, a: str, b: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Welch's test between two groups with both tails, Benjamini-Hochberg's q, and the sign of a significant difference (else 0).

    Tests are as many as loci; ranks come from counts per p.
    """
    w = welch(cube, group_col, a, b, by).withColumn("p", t_tails(F.col("t"), F.col("dof")))
    counts = w.where("p IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("k"))
    m = counts.agg(F.sum("k").alias("m"))
    ranks = counts.select("p", F.sum("k").over(Window.orderBy("p")).alias("rank")).crossJoin(F.broadcast(m))
    q = F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("rank")).over(Window.orderBy(F.desc("p"))))
    return w.join(ranks.select("p", q.alias("q")), "p", "left").select(*by, "t", "dof", "p", "q", F.when(F.col("q") < alpha, F.signum("t")).otherwise(F.lit(0.0)).cast("int").alias("sign"))


def shifted_regions(cube: DataFrame, group_col: str, a: str, b: str, share: float) -> DataFrame:
    """Loci whose log2 ratio of the two groups' means is among the highest (1) or lowest (-1) ``share`` of loci, else 0."""
    mean = lambda g: F.avg(F.when(F.col(group_col) == g, F.col("value")))
    r = cube.groupBy("chrom", "locus").agg(mean(a).alias("ma"), mean(b).alias("mb"))
    ratio = F.when((F.col("ma") > 0) & (F.col("mb") > 0), F.log2(F.col("ma") / F.col("mb")))
    r = r.select("chrom", "locus", ratio.alias("ratio"))
    edges = r.agg(F.percentile("ratio", [share, 1 - share]).alias("e"))
    sign = F.when(F.col("ratio") >= F.col("e")[1], 1).when(F.col("ratio") <= F.col("e")[0], -1).otherwise(0)
    return r.crossJoin(F.broadcast(edges)).select("chrom", "locus", "ratio", sign.alias("sign"))
