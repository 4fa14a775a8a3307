"""Sequences as blocks of letters, so that no row, key or task holds a whole one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, MARGIN = 1 << 16, 1 << 15


@dataclass(frozen=True)
class SequenceBlocks:
    """letters: (chrom, block, letters), `block` letters each and the first `margin` of the next one; sizes: (chrom, size)."""

    letters: DataFrame
    sizes: DataFrame
    block: int = BLOCK
    margin: int = MARGIN

    def __post_init__(self) -> None:
        if not 0 < self.margin <= self.block:
            raise ValueError("margin must be between 1 and block")

    def store(self, path: str) -> SequenceBlocks:
        """Written in order of chrom and block, and read again."""
        self.letters.repartitionByRange("chrom", "block").sortWithinPartitions("chrom", "block").write.parquet(f"{path}/letters")
        self.sizes.select("chrom", "size", F.lit(self.block).alias("block"), F.lit(self.margin).alias("margin")).write.parquet(f"{path}/sizes")
        return load(self.letters.sparkSession, path)


def load(spark: SparkSession, path: str) -> SequenceBlocks:
    sizes = spark.read.parquet(f"{path}/sizes")
    of = sizes.select("block", "margin").first() or (BLOCK, MARGIN)
    return SequenceBlocks(spark.read.parquet(f"{path}/letters"), sizes.select("chrom", "size"), *of)


def cut(sequences: DataFrame, block: int = BLOCK, margin: int = MARGIN) -> SequenceBlocks:
    """Blocks of sequences (chrom, seq) that are rows of a table. Long ones should be read in blocks in the first place: `fasta.read_blocks`."""
    size = F.length("seq")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    letters = sequences.select("chrom", F.posexplode(F.transform(starts, lambda i: F.substring("seq", i + 1, F.lit(block + margin)))).alias("block", "letters"))
    return SequenceBlocks(letters.withColumn("block", F.col("block").cast("long")), sequences.select("chrom", size.cast("long").alias("size")), block, margin)
