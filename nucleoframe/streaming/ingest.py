"""Streaming ingest of rows that keep arriving as parquet files (an extension; batches are the main way)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arrivals(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(rows: DataFrame, time: str, by: list[str], width: str, late: str | None = None) -> DataFrame:
    """Rows and mean value per time window and key. With ``late`` rows that come later than that after
    the newest don't count and windows are dropped from the state; without it every row counts."""
    timed = rows.withWatermark(time, late) if late else rows
    return timed.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begins"), *by, "n", "total")


def deduplicated(rows: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first delivery of each row within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def run_available(rows: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Work off what has arrived, then stop. Appends write straight; complete results replace the table."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
