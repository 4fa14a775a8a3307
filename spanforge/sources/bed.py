"""Interval files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import digest
from ..functions.names import with_bed_extension
from .text import lines, numbered, require


def _fields(value: Column, pattern: str = "\t") -> Column:
    return F.split(value, pattern)


def parse(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(set_id, row_idx, chrom, start, end) of lines that do not start with #; a line without two integers there is an error.

    limit counts rows of each set; 0 is no limit, as is none.
    """
    f = _fields(F.col("value"))
    out = rows.filter(~F.col("value").startswith("#")).select("set_id", "line_no", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), "value")
    out = out.filter(require(F.col("start").isNotNull() & F.col("end").isNotNull(), F.concat(F.lit("not an interval: "), F.col("value"))))
    out = numbered(out).select("set_id", "row_idx", "chrom", "start", "end")
    return out.filter(F.col("row_idx") < limit) if limit else out


def parse_whitespace(rows: DataFrame) -> DataFrame:
    """As parse, with any white space between fields and no comments."""
    f = _fields(F.trim("value"), r"\s+")
    return numbered(rows).select("set_id", "row_idx", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("end"))


def read(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """A .bed or .bed.gz file, or several. A name may lack its extension, or have or lack .gz, as long as one such file is there."""

    def there(name: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    found = [with_bed_extension(one, there) for one in ([path] if isinstance(path, str) else path)]
    for one in found:
        if not one.rstrip("/").endswith((".bed", ".bed.gz")):
            raise ValueError(f"neither .bed nor .bed.gz: {one}")
    return parse(lines(spark, found), limit)


def shuffled(df: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """`limit` rows of each set in an order drawn by hash: the same whatever the partitions are."""
    w = Window.partitionBy("set_id").orderBy(digest(F.col("set_id"), F.col("row_idx"), seed), "row_idx")
    return df.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < limit)


def parse_lenient(rows: DataFrame) -> DataFrame:
    """(set_id, line_no, chrom, start, end, bad_reason): blank, #, track and browser lines are passed over, bad ones are named."""
    text = F.trim("value")
    f = _fields(text)
    rows = rows.filter((text != "") & ~text.rlike("^(#|track|browser)")).select("set_id", "line_no", F.size(f).alias("n"), f.alias("f"))
    rows = rows.select("set_id", "line_no", "n", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("start"), F.get("f", F.lit(2)).try_cast("long").alias("end"))
    reason = F.when(F.col("n") < 3, "columns").when(F.col("start").isNull() | F.col("end").isNull(), "integer").when((F.col("start") < 0) | (F.col("end") < 0), "negative").when(F.col("end") < F.col("start"), "order")
    return rows.select("set_id", "line_no", "chrom", "start", "end", reason.alias("bad_reason"))


def lengths(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(set_id, row_idx, length) of lines with two integers and length 0 or more; limit counts those."""
    f = _fields(F.trim("value"))
    rows = rows.select("set_id", "line_no", (F.get(f, F.lit(2)).try_cast("long") - F.get(f, F.lit(1)).try_cast("long")).alias("length")).filter("length >= 0")
    rows = numbered(rows).select("set_id", "row_idx", "length")
    return rows.filter(F.col("row_idx") < limit) if limit else rows


def demultiplex(rows: DataFrame, samples: DataFrame, states: DataFrame) -> DataFrame:
    """(set_id, chrom, start, end) of segmentations: the set is sample_state, the sample by the file name before its first _,
    the state by the fourth field. Unknown ones and lines of under 4 fields are errors. samples: (sample_id, sample); states: (label, state)."""
    f = _fields(F.col("value"))
    rows = rows.filter(require(F.size(f) >= 4, F.concat(F.lit("under 4 fields: "), F.col("value"))))
    rows = rows.select(F.substring_index("set_id", "_", 1).alias("sample_id"), F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), F.get(f, F.lit(3)).alias("label"))
    rows = rows.join(samples, "sample_id", "left").join(states, "label", "left")
    known = require(F.col("sample").isNotNull() & F.col("state").isNotNull(), F.concat(F.lit("unknown: "), F.col("sample_id"), F.lit(" "), F.col("label")))
    return rows.filter(known).select(F.concat_ws("_", "sample", "state").alias("set_id"), "chrom", "start", "end")


def write(df: DataFrame, path: str) -> None:
    """One folder a set, rows sorted by position."""
    text = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value")
    df.repartition("set_id").sortWithinPartitions("set_id", "chrom", "start", "end").select("set_id", text).write.partitionBy("set_id").text(path)
