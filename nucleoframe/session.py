"""Session helpers: table reading, lineage cuts and parallelism hints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the project's parquet tables (a file or a directory of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    ``spark.checkpoint.dir`` wins. Only a purely local session without that setting gets a
    temporary folder of its own; on a cluster the missing setting is an error, because a
    machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="nucleoframe-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later stages survive lost executors."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, for loops of many joins.

    A checkpoint keeps the estimated size of its plan, and estimates multiply with each join, so
    that after a few rounds the planner works on numbers of millions of digits. A written table
    has its real size.
    """
    path = f"{shared_checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read any more; other DataFrames are left alone.

    A loop calls it on the tables of a round once those of the next are written.
    """
    for t in tables:
        path = getattr(t, "_settled_at", None)
        if path:
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Add the place of each row, from 1, in the order given, without one task for all rows.

    Rows are range-partitioned and numbered within their partition; only the sizes of the
    partitions, one row each, are summed up in order and broadcast.
    """
    parted = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return parted.join(F.broadcast(before), "_part").withColumn(name, place.cast("bigint")).drop("_part", "_before")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however many later expressions and filters use them.

    A plain projection would be merged into its consumers, and costly text expressions would be
    evaluated again at each use; a one-row generator isn't merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
