"""Interval files as they arrive, and hits of a fixed query set in each batch of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import overlap_count_by_set


def stream(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """(set_id, chrom, start, end) of the files that come into a folder."""
    rows = spark.readStream.schema("value string").option("maxFilesPerTrigger", per_batch).text(folder)
    f = F.split("value", "\t")
    rows = rows.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(\.bed)?(\.gz)?$", "")
    return rows.select(name.alias("set_id"), F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"))


def append_hits(intervals: DataFrame, query: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Overlap counts by query row and set of each batch, one folder a batch: a batch that is tried again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        overlap_count_by_set(query, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return intervals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
