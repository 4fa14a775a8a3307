"""Interval arithmetic on (chrom, start, end) columns; 0-based, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def same_chrom(a: str, b: str) -> Column:
    return _c(a, "chrom") == _c(b, "chrom")


def signed_overlap(a: str, b: str) -> Column:
    """Overlapping positions; below zero, the distance between the two. Chromosomes are not looked at."""
    return F.least(_c(a, "end"), _c(b, "end")) - F.greatest(_c(a, "start"), _c(b, "start"))


def intersects(a: str, b: str) -> Column:
    """Whether the two share a position; touching ends do not."""
    return same_chrom(a, b) & (signed_overlap(a, b) > 0)


def overlap_bp(a: str, b: str) -> Column:
    return F.when(same_chrom(a, b), F.greatest(signed_overlap(a, b), F.lit(0))).otherwise(F.lit(0)).cast("long")


def overlap_fraction(a: str, b: str) -> Column:
    """Shared positions as a share of the shorter interval: 1 is containment. Empty intervals share nothing."""
    bp = overlap_bp(a, b)
    shorter = F.least(_c(a, "end") - _c(a, "start"), _c(b, "end") - _c(b, "start"))
    return F.when(bp > 0, bp / shorter).otherwise(F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    """The shared interval as a struct, or null."""
    found = F.struct(_c(a, "chrom").alias("chrom"), F.greatest(_c(a, "start"), _c(b, "start")).alias("start"), F.least(_c(a, "end"), _c(b, "end")).alias("end"))
    return F.when(intersects(a, b), found)


def genome_distance(a: str, b: str) -> Column:
    """Megabases between the two, 0 if they meet, infinite across chromosomes. A reversed interval is as far from its own end."""
    gap = F.greatest(-signed_overlap(a, b), F.lit(0)) / 1e6
    return F.when(same_chrom(a, b), gap).otherwise(F.lit(float("inf")))


#: Numbers of the named chromosomes.
NAMED_CHROMOSOMES = {"x": 22, "y": 23, "xy": 24, "par": 24, "m": 25, "mt": 25}


def chrom_id(chrom: Column) -> Column:
    """0-based chromosome number; a name without the chr prefix is an error."""
    rest = F.lower(F.substring(chrom, 4, 1000))
    number = F.expr("CAST(NULL AS INT)")
    for name, value in NAMED_CHROMOSOMES.items():
        number = F.when(rest == name, F.lit(value)).otherwise(number)
    number = F.coalesce(number, rest.cast("int") - 1)
    return F.when(chrom.startswith("chr"), number).otherwise(F.raise_error(F.concat(F.lit("no chr prefix: "), chrom)).cast("int"))


def log2_length() -> Column:
    return F.log2(F.col("end") - F.col("start"))
