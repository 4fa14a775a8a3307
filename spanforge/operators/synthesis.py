"""Synthetic intervals and sequences, drawn by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import digest, fraction

#: Rounded chromosome sizes in megabases, chr1 … chr22, chrX, chrY.
MEGABASES = (
    248.96, 242.19, 198.30, 190.21, 181.54, 170.81, 159.35, 145.14, 138.39, 133.80, 135.09, 133.28,
    114.36, 107.04, 101.99, 90.34, 83.26, 80.37, 58.62, 64.44, 46.71, 50.82, 156.04, 57.23,
)


def chrom_sizes(spark: SparkSession) -> DataFrame:
    names = [*map(str, range(1, 23)), "X", "Y"]
    return spark.createDataFrame([(f"chr{n}", round(m * 1e6)) for n, m in zip(names, MEGABASES, strict=True)], "chrom string, size long")


def intervals(spark: SparkSession, n: int, least: int, most: int, seed: int = 42) -> DataFrame:
    """(row_idx, chrom, start, end): uniform chromosomes, uniform lengths least … most, inside the chromosome."""
    sizes = chrom_sizes(spark).agg(F.array_sort(F.collect_list(F.struct("chrom", "size"))).alias("all"))
    rows = spark.range(n).select(F.col("id").alias("row_idx")).crossJoin(F.broadcast(sizes))
    rows = rows.select("row_idx", F.element_at("all", (F.floor(fraction(F.col("row_idx"), seed) * F.size("all")) + 1).cast("int")).alias("c"), F.floor(least + fraction(F.col("row_idx"), seed + 1) * (most - least + 1)).alias("n"))
    start = F.floor(fraction(F.col("row_idx"), seed + 2) * (F.col("c.size") - F.col("n") + 1))
    return rows.select("row_idx", F.col("c.chrom").alias("chrom"), start.alias("start"), (start + F.col("n")).alias("end"))


def random_sequence(key: Column, size: Column, seed: int = 42) -> Column:
    """`size` letters, 32 from each hash of (key, number, seed): two bits a hexadecimal digit."""
    size = size.cast("int")
    letters = lambda i: F.translate(digest(key, i, seed), "0123456789abcdef", "ACGT" * 4)
    return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 32).cast("int")), letters), ""), F.lit(1), size)


def blocks(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(chrom, block, seq) of the blocks that intervals touch, last ones included."""
    ids = rows.filter("end > start").select("chrom", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("block")).distinct()
    return ids.withColumn("seq", random_sequence(F.concat_ws("_", "chrom", F.col("block").cast("string")), F.lit(size), seed))


def assemble(found: DataFrame, size: int) -> DataFrame:
    """(chrom, seq): the blocks of each chromosome in order, from its start to the end of its last block; gaps between them are N."""
    at = F.col("block") - F.coalesce(F.lag("block").over(Window.partitionBy("chrom").orderBy("block")), F.lit(-1)) - 1
    parts = found.withColumn("piece", F.concat(F.repeat(F.lit("N"), (at * size).cast("int")), F.col("seq")))
    ordered = F.array_sort(F.collect_list(F.struct("block", "piece")))
    return parts.groupBy("chrom").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("seq"))


def random_fasta(spark: SparkSession, scale: int = 1_000_000, seed: int = 42) -> DataFrame:
    """(chrom, seq) of a whole random genome, sizes divided by scale."""
    return chrom_sizes(spark).select("chrom", random_sequence(F.col("chrom"), F.col("size") / scale, seed).alias("seq"))
