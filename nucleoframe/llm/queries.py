"""Queries of the training-data problems, and SQL for those that SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoframe.llm import density, packing, pieces, splits, tokens
from nucleoframe.model import known_coord
from nucleoframe.session import table

WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cells").select(F.col("cell_id").alias("a"), F.col("relabelled_from").alias("b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of labels that must share a split."""
    labels = table(spark, sf_dir, "sc_repliseq").select(F.col("cellids").alias("label"))
    return splits.related_pairs(labels, _relabelled(spark, sf_dir))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of each sample."""
    out = splits.assign_splits(table(spark, sf_dir, "sc_repliseq"), "sample_id", "cellids", "states", _relabelled(spark, sf_dir), WEIGHTS)
    return out.select(F.col("id").alias("sample_id"), "split")


P3_SQL = """
WITH RECURSIVE raw AS (
  SELECT cellids AS l FROM sc_repliseq UNION SELECT cell_id FROM cells UNION SELECT relabelled_from FROM cells
), k AS (
  SELECT l, regexp_replace(lower(trim(l)), '^[\\s_.:-]*(?:cell|c)?[\\s_.:-]*0*([0-9]+)[\\s_.:-]+0*([0-9]+)[\\s_.:-]+(?:replicate|rep|r)[\\s_.:-]*0*([0-9]+)(?:[\\s_.:-]+.*)?$', '\\1_\\2_\\3') AS key
  FROM raw WHERE l IS NOT NULL AND trim(l) <> '' AND lower(trim(l)) <> 'unsegmented'
), e AS (
  SELECT a.key AS a, b.key AS b FROM cells c JOIN k a ON a.l = c.cell_id JOIN k b ON b.l = c.relabelled_from
  UNION SELECT b.key, a.key FROM cells c JOIN k a ON a.l = c.cell_id JOIN k b ON b.l = c.relabelled_from
), reach(a, b) AS (
  SELECT DISTINCT key, key FROM k UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
), root AS (SELECT a AS key, min(b) AS root FROM reach GROUP BY a),
lab AS (SELECT DISTINCT s.cellids AS l, r.root FROM sc_repliseq s JOIN k ON k.l = s.cellids JOIN root r ON r.key = k.key)
SELECT a.l AS label_a, b.l AS label_b FROM lab a JOIN lab b ON a.root = b.root AND a.l < b.l
"""


CLUSTER_EPS = 0.1505
CLUSTER_LEAST = 8


def _clusterable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots with all coordinates and a chromosome that the genome (a few rows) has."""
    spots = table(spark, sf_dir, "spots").where(known_coord(F.col("x")) & known_coord(F.col("y")) & known_coord(F.col("z")))
    return spots.join(table(spark, sf_dir, "genome").select("chrom").distinct(), "chrom", "left_semi")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at least 8 spots of a cell and chromosome that lie together."""
    return density.linked_groups(_clusterable(spark, sf_dir), "row_id", F.xxhash64("cell_id", "chrom"), CLUSTER_EPS, CLUSTER_LEAST)


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most stable clusters of spots, their sizes and most typical spots."""
    return density.density_clusters(_clusterable(spark, sf_dir), "row_id", F.xxhash64("cell_id", "chrom"), CLUSTER_EPS, 4, CLUSTER_LEAST)


P5_SQL = """
WITH RECURSIVE s AS (
  SELECT row_id, cell_id, chrom, x, y, z FROM spots
  WHERE x > 0 AND x < 200000 AND y > 0 AND y < 200000 AND z > 0 AND z < 200000 AND chrom IN (SELECT chrom FROM genome)
), e AS (
  SELECT a.row_id AS a, b.row_id AS b FROM s a JOIN s b ON a.cell_id = b.cell_id AND a.chrom = b.chrom AND a.row_id <> b.row_id
    AND abs(a.x - b.x) <= 0.1505 AND abs(a.y - b.y) <= 0.1505
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.1505 * 0.1505
), reach(a, b) AS (
  SELECT row_id, row_id FROM s UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a
), c AS (SELECT a AS row_id, min(b) AS cluster_id FROM reach GROUP BY a)
SELECT cluster_id, row_id FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY cluster_id HAVING count(*) >= 8)
"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every speech, the empty and the null ones included."""
    return tokens.encode_column(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids of every speech, and whether their raw bytes are the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = tokens.encode_column(docs, "text", ["doc_id", "text"])
    same = F.coalesce(tokens.decode_bytes(F.col("ids")), F.lit(b"")) == F.encode("text", "utf-8")
    return ids.select("doc_id", F.size("ids").alias("n_ids"), same.alias("same_bytes"))


CAPACITY = 2048
PIECE_LIMIT, PIECE_OVERLAP = 1024, 64


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every speech, or of its pieces if it exceeds the capacity."""
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY).withColumnRenamed("id", "doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the speeches that are longer than the limit."""
    return pieces.cut_texts(table(spark, sf_dir, "documents"), "doc_id", "text", PIECE_LIMIT, PIECE_OVERLAP)


QUERIES = {"p3_found": p3_found, "p3_splits": p3_splits, "p5_found": p5_found, "p5_clusters": p5_clusters, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_packed": p9_packed, "p10_pieces": p10_pieces}
ORACLES = {"p3_found": P3_SQL, "p5_found": P5_SQL}
