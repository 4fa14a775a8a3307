"""Text files as numbered lines, and what is carried from line to line, without a file or a set in one task.

Counts and last values of pieces of a file are worked out first, a row a piece; running totals over those rows then say where each
piece starts, and come back to its lines by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of a piece of a set, as a power of two.
PIECE = 16
#: The most splits of files whose starts are broadcast: some 100 bytes each.
SPLITS = 1_000_000


def _set_id(file: Column) -> Column:
    return F.regexp_replace(F.substring_index(file, "/", -1), r"(\.bed)?(\.gz)?(\.tsv)?$", "")


def split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, segment, value): lines as the scan finds them. A segment is the offset of a split; its lines are together and in order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("segment"), "value")


def segmented(rows: DataFrame) -> DataFrame:
    """(file, segment, value, line_no) of lines (set_id, line_no, value) of a table: a segment is 65,536 line numbers."""
    return rows.select(F.col("set_id").alias("file"), F.shiftright(F.col("line_no").cast("long"), PIECE).alias("segment"), "value", "line_no")


def with_starts(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines with the columns of their segment's row in `starts`, still together and in order by segment."""
    if "line_no" in lines.columns:
        return lines.join(starts, ["file", "segment"]).repartition("file", "segment").sortWithinPartitions("file", "segment", "line_no")
    conf, size = lines.sparkSession.conf, lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    as_bytes = lines.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    least = min(as_bytes(conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))
    if int(str(size)) / max(1, least) + len(lines.inputFiles()) > SPLITS:
        raise ValueError("too many splits: raise spark.sql.files.maxPartitionBytes and openCostInBytes")
    return lines.join(F.broadcast(starts), ["file", "segment"])


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(set_id, line_no, value): set_id is the file name without .bed, .gz and .tsv; line_no counts from 0 in file order.

    Files may be split over tasks. A line's number is its place in its split, and the lines of the splits before it.
    """
    placed = split_lines(spark, path).withColumn("at", F.monotonically_increasing_id())
    pieces = placed.groupBy("file", "segment").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("segment")) - F.col("n")
    starts = pieces.select("file", "segment", (before - F.col("first")).alias("shift"))
    return with_starts(placed, starts).select(_set_id(F.col("file")).alias("set_id"), (F.col("at") + F.col("shift")).alias("line_no"), "value")


def require(cond: Column, message: Column | str) -> Column:
    """A boolean that is true, or an error."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(cond, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def _pieces(rows: DataFrame, order: str) -> tuple[DataFrame, Window]:
    earlier = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__piece", F.shiftright(F.col(order).cast("long"), PIECE)), earlier


def _back(rows: DataFrame, starts: DataFrame, by: str) -> DataFrame:
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("__piece") == F.col("__of"))
    return rows.join(starts.withColumnsRenamed({by: "__by", "__piece": "__of"}), same)


def numbered(rows: DataFrame, order: str = "line_no", by: str = "set_id", out: str = "row_idx") -> DataFrame:
    """`out` counts the rows of each set from 0 in the order of a whole number, as line numbers are, with or without gaps."""
    cols = rows.columns
    rows, earlier = _pieces(rows, order)
    counts = rows.groupBy(by, "__piece").agg(F.count("*").alias("__n"))
    starts = counts.select(by, "__piece", F.coalesce(F.sum("__n").over(earlier.partitionBy(by)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__piece").orderBy(order)) - 1
    return _back(rows.withColumn("__inside", inside), starts, by).select(*cols, (F.col("__before") + F.col("__inside")).cast("long").alias(out))


def carried(rows: DataFrame, value: Column, out: str, order: str = "line_no", by: str = "set_id") -> DataFrame:
    """`out` is the last `value` that is not null up to each row of a set; null before the first."""
    cols = rows.columns
    rows, earlier = _pieces(rows.withColumn("__value", value), order)
    ends = rows.groupBy(by, "__piece").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last"))
    starts = ends.select(by, "__piece", F.last("__last", True).over(earlier.partitionBy(by)).alias("__before"))
    inside = F.last("__value", True).over(Window.partitionBy(by, "__piece").orderBy(order))
    return _back(rows.withColumn("__inside", inside), starts, by).select(*cols, F.coalesce("__inside", "__before").alias(out))
