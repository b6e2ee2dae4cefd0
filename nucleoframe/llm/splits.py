"""Splits that keep related records together.

Labels are reduced to the entity they name, links between entities are closed to components by
hash-to-min, and weighted rendezvous hashing assigns whole components to splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoframe.model import clean_state
from nucleoframe.session import cut_lineage

NO_CELL = "unsegmented"
_SEP = r"[\s_.:\-]"
#: Optional prefix, field of view, cell number, replicate, optional tags.
_LABEL = rf"(?is)^{_SEP}*(?:cell|c)?{_SEP}*0*([0-9]+){_SEP}+0*([0-9]+){_SEP}+(?:replicate|rep|r){_SEP}*0*([0-9]+)(?:{_SEP}+.*)?$"


def cell_key(label: Column) -> Column:
    """Field of view, cell number and replicate of a label, however it is written; null for blank
    labels and ``unsegmented``. A label of another form stands for itself, in lower case."""
    text = F.lower(F.btrim(label, F.lit(" \t\r\n")))
    key = F.regexp_replace(F.when(text.rlike(_LABEL), text), _LABEL, "$1_$2_$3")
    return F.when((text == "") | (text == NO_CELL), F.lit(None).cast("string")).otherwise(F.coalesce(key, text))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components by hash-to-min: (node, root), root the smallest node of the component.

    ``edges`` has columns a and b. Each node holds a cluster of nodes, as rows. In a round it
    sends its cluster to the cluster's smallest member and that member to all others, until
    nothing changes; then the smallest member holds its whole component. Rounds grow with the
    logarithm of the longest path; if ``max_rounds`` don't do, it raises RuntimeError. Clusters are
    rows of a table, never one value or one task.
    Null ends are dropped; an edge from a node to itself is a component of one.
    """
    ends = edges.dropna(subset=["a", "b"]).select("a", "b")
    held = cut_lineage(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(ends.select("a", F.col("a").alias("b"))).unionByName(ends.select(F.col("b").alias("a"), "b")).distinct())
    size = held.count()
    total = None
    for _ in range(max_rounds):
        least = held.groupBy("a").agg(F.min("b").alias("m"))
        sent = held.join(least, "a").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b").distinct()
        after = cut_lineage(sent)
        n, check = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, check) == (size, total):
            return after.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        held, size, total = after, n, check
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def label_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(label, root) for each distinct label that names a cell.

    ``labels`` has a column label, ``links`` the labels a and b of relabelled cells. Only keys
    that a link names take part in the closure.
    """
    keyed = labels.select("label").where("label IS NOT NULL").distinct().withColumn("key", cell_key(F.col("label"))).where("key IS NOT NULL")
    edges = links.select(cell_key(F.col("a")).alias("a"), cell_key(F.col("b")).alias("b")).where("a <> b").distinct()
    roots = components(edges)
    return keyed.join(roots, keyed["key"] == roots["node"], "left").select("label", F.coalesce("root", "key").alias("root"))


def related_pairs(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Each pair of different labels of one component, label_a before label_b by bytes."""
    a = label_components(labels, links).select(F.col("label").alias("label_a"), "root")
    b = a.select(F.col("label_a").alias("label_b"), "root")
    return a.join(b, "root").where("label_a < label_b").select("label_a", "label_b")


def _uniform(*parts: Column) -> Column:
    """A hash of the parts, strictly between 0 and 1."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def rendezvous(key: Column, seed: Column, weights: dict[str, float]) -> Column:
    """The split with the largest score -w / ln(u): each key's choice is independent of all other
    keys, and a change of weights moves only the keys it must."""
    scores = [F.struct((-F.lit(w) / F.ln(_uniform(seed, key, F.lit(s)))).alias("score"), F.lit(s).alias("split")) for s, w in weights.items() if w > 0]
    return F.array_max(F.array(*scores))["split"]


def assign_splits(records: DataFrame, id_col: str, label_col: str, state_col: str, links: DataFrame, weights: dict[str, float], seeds: int = 16) -> DataFrame:
    """(id, root, split): all records of one component in one split.

    Records whose label names no cell (null, blank, unsegmented) are components of their own.
    Of ``seeds`` ways to hash, the one is taken whose splits come nearest to the proportions,
    overall and in each state; that compares one row per seed, split and state. Ids that occur
    twice get the same split. An empty table gives an empty result.
    """
    label, total = F.col(label_col), sum(weights.values())
    known = label_components(records.select(label.alias("label")), links)
    rooted = records.select(F.col(id_col).alias("id"), label.alias("label"), F.coalesce(clean_state(F.col(state_col)), F.lit("none")).alias("state")).join(known, "label", "left")
    unit = F.coalesce(F.concat(F.lit("c"), "root"), F.concat(F.lit("r"), F.col("id").cast("string")))
    rooted = rooted.select("id", "root", "state", unit.alias("unit"))
    sized = cut_lineage(rooted.where("root IS NOT NULL").groupBy("unit", "state").agg(F.count(F.lit(1)).alias("n")))
    tried = sized.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("split", rendezvous(F.col("unit"), F.col("seed"), weights))
    table = tried.groupBy("seed", "split", "state").agg(F.sum("n").alias("n")).collect()
    best, least = 0, math.inf
    for seed in range(seeds):
        mine = [r for r in table if r["seed"] == seed]
        cost = 0.0
        for state in {r["state"] for r in mine}:
            n = sum(r["n"] for r in mine if r["state"] == state)
            cost += sum(abs(sum(r["n"] for r in mine if r["state"] == state and r["split"] == s) - n * w / total) for s, w in weights.items())
        if cost < least:
            best, least = seed, cost
    return rooted.select("id", "root", rendezvous(F.col("unit"), F.lit(best), weights).alias("split"))
