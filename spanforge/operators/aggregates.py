"""Aggregations over intervals, vectors and hits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import overlap_fraction
from ..functions.vectors import vector_mean
from .joins import BIN
from .overlaps import binned
from .selection import at_places, percentile


def _spread(col: str) -> list[Column]:
    return [F.min(col).alias("least"), F.max(col).alias("most"), F.avg(col).alias("mean"), F.coalesce(F.stddev_samp(col), F.when(F.count(col) == 1, 0.0)).alias("deviation")]


def bed_stats(intervals: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, intervals; min, max, mean and sample deviation of lengths and of intervals a file (files without any count)."""
    lengths = intervals.select((F.col("end") - F.col("start")).alias("x")).agg(F.count("*").alias("intervals"), *_spread("x"))
    per = files.join(intervals.groupBy("set_id").agg(F.count("*").alias("n")), "set_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    sizes = per.agg(F.count("*").alias("files"), *[c.alias(f"file_{k}") for c, k in zip(_spread("n"), ("least", "most", "mean", "deviation"), strict=True)])
    return sizes.join(lengths)  # one row each


def histogram(values: DataFrame, col: str, bins: int, least: float | None = None, cap_percentile: float | None = None, cap: float | None = None) -> DataFrame:
    """(bin, n): equal-width bins from the smallest to the largest value kept, the last one closed; one distinct value falls into the first."""
    values = values.select(F.col(col).cast("double").alias("x"))
    if least is not None:
        values = values.filter(F.col("x") >= least)
    if cap_percentile is not None:
        top = percentile(values, [], "x", cap_percentile).select(F.col("percentile").alias("top"))
        values = values.join(F.broadcast(top)).filter("x <= top").drop("top")  # one row
    if cap is not None:
        values = values.filter(F.col("x") <= cap)
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    return values.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def similarity_summary(scores: DataFrame, small: float = 0.05) -> DataFrame:
    """By label: share below `small`, largest, and the values at rounded places 10 % and 90 % of the sorted list."""
    place = lambda p: (p, lambda n: F.rint(n * F.lit(p)))
    rows = scores.groupBy("label").agg(F.avg((F.col("similarity") < small).cast("double")).alias("small_share"), F.max("similarity").alias("top"))
    return rows.join(at_places(scores, ["label"], "similarity", {"p10": place(0.1), "p90": place(0.9)}), "label", "left").drop("n")


def scatter_mean(df: DataFrame, index: str, vec: str, width: int) -> DataFrame:
    """Mean vector of each index 0 … the largest; zeros where there is none."""
    # the spine unfolds in two steps, so that no task lists all of it
    blocks = df.agg(F.max(index).alias("top")).select("top", F.explode(F.sequence(F.lit(0), F.shiftright("top", 16))).alias("__b")).repartition("__b")
    first = F.shiftleft("__b", 16)
    spine = blocks.select(F.explode(F.sequence(first, F.least(F.col("top"), first + 65_535))).alias(index))
    means = vector_mean(df, [index], vec, "vec")
    return spine.join(means, index, "left").select(index, F.coalesce("vec", F.array_repeat(F.lit(0.0), width)).alias("vec"))


def weighted_mean(df: DataFrame, keys: list[str], vec: str, weight: str) -> DataFrame:
    """Plain mean of the vectors times their weights."""
    return vector_mean(df.select(*keys, F.transform(vec, lambda x: x * F.col(weight)).alias("v")), keys, "v", "vec")


def pooled(df: DataFrame, key: str, phi=None, rho=None) -> DataFrame:
    """Deep-set pooling: phi of each row, mean by set, rho of that, all divided by the norm of the whole result."""
    rows = df.select(key, (phi(F.col("vec")) if phi else F.col("vec")).alias("vec"))
    sets = vector_mean(rows, [key])
    sets = sets.select(key, (rho(F.col("vec")) if rho else F.col("vec")).alias("vec"))
    total = sets.agg(F.sqrt(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).alias("n"))
    return sets.join(F.broadcast(total)).select(key, F.transform("vec", lambda x: x / F.col("n")).alias("vec"))


def recall_by_overlap(truth: DataFrame, found: Column | DataFrame) -> DataFrame:
    """(bin, total, hits, recall) over 11 bins of rounded overlap share. truth: pairs with q_ and s_ columns; found: whether a pair is
    found, or the pairs that are, which are then joined."""
    if isinstance(found, DataFrame):
        keys = ["q_row_idx", "s_row_idx"]
        truth = truth.join(found.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left")
        found = F.coalesce("__hit", F.lit(False))
    got = truth.groupBy(F.rint(overlap_fraction("q_", "s_") * 10).cast("int").alias("bin")).agg(F.count("*").alias("total"), F.count_if(found).alias("hits"))
    return _all_bins(got)


def _all_bins(got: DataFrame) -> DataFrame:
    spine = got.sparkSession.range(11).select(F.col("id").cast("int").alias("bin"))
    return spine.join(got, "bin", "left").select("bin", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("hits", F.lit(0)).alias("hits"), (F.col("hits") / F.nullif(F.col("total"), F.lit(0))).alias("recall"))


def recall_of_overlaps(query: DataFrame, sample: DataFrame, found: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """recall_by_overlap of all pairs of the two that meet: found tells by arrays of their row_idx which are found. Pairs are made and
    counted within tasks; what leaves them are counts."""
    return _all_bins(binned(query, sample, found, BIN, 64))


def recall_at_least(bins: DataFrame) -> DataFrame:
    """Recall of all hits whose bin is this one or a higher one."""
    w = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return bins.select("bin", (F.sum("hits").over(w) / F.nullif(F.sum("total").over(w), F.lit(0))).alias("recall"))


def hit_counts(hits: DataFrame, query: str, n: str | None = None) -> DataFrame:
    """One row: hits, queries with any, the most of one query. hits: a row a hit, or, with n, a row a query with its number of hits."""
    per = hits.select(F.col(n).alias("n")) if n else hits.groupBy(query).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("hits"), F.count("*").alias("queries"), F.max("n").alias("deepest"))


def margins(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Means of a matrix by row, by column and over all; missing cells count nowhere."""
    cells = df.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).alias("x"))
    return cells.groupingSets([["r"], ["c"], []], "r", "c").agg(F.avg("x").alias("mean"))


def heatmap(df: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """A matrix of the largest value less each cell's, one column a name in `columns`; missing cells stay null."""
    flipped = df.join(F.broadcast(df.agg(F.max(value).alias("__top")))).select(row, col, (F.col("__top") - F.col(value)).alias("x"))
    return flipped.groupBy(row).pivot(col, columns).agg(F.first("x"))


def confidence_95(col: str) -> Column:
    return 1.96 * F.stddev_pop(col) / F.sqrt(F.count(col))


def integrity(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """By set: rows stored and expected, rows without dimensions, rows of zeros, and whether all is well."""
    got = stored.groupBy("set_id").agg(F.count("*").alias("rows"), F.count_if(F.size("vec") == 0).alias("no_width"), F.count_if((F.size("vec") > 0) & F.forall("vec", lambda x: x == 0)).alias("zeros"))
    want = expected.groupBy("set_id").agg(F.count("*").alias("expected"))
    both = got.join(want, "set_id", "full_outer").select("set_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "expected", "no_width", "zeros")])
    return both.withColumn("ok", (F.col("rows") == F.col("expected")) & (F.col("no_width") == 0) & (F.col("zeros") == 0))
