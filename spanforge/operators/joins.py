"""Joins of intervals and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import intersects
from ..sources.text import numbered
from . import overlaps as O


#: Positions of a bin. Rows of a cell meet by their order, so that wide bins cost no comparisons and few copies.
BIN = 65_536


def overlap_join(query: DataFrame, sample: DataFrame, width: int = BIN, most: int = 64, columns: list[str] | None = None) -> DataFrame:
    """Pairs of intervals that share a position; columns (or only those named) get the prefixes q_ and s_; empty intervals meet nothing.

    Both sides are dealt once into cells of bins (see overlaps.cells); in a cell, those that start in it are sorted, and each that
    covers it meets a range of them, so that nothing is compared that does not meet. Pairs leave a task in batches.
    """
    return O.joined(query, sample, columns, width, most)


def distinct_overlaps(query: DataFrame, sample: DataFrame) -> DataFrame:
    """(q_chrom, q_start, q_end, s_start, s_end): distinct pairs of intervals that share a position. Pairs of distinct intervals are distinct,
    so only the rows of a cell are made so, where they meet."""
    return O.joined(query, sample, ["q_chrom", "q_start", "q_end", "s_start", "s_end"], BIN, 64, distinct=True)


def overlap_join_plain(query: DataFrame, sample: DataFrame) -> DataFrame:
    """The same pairs by a join on chrom alone, to hold the binned form against."""
    q = query.select(*[F.col(c).alias(f"q_{c}") for c in query.columns])
    s = sample.select(*[F.col(c).alias(f"s_{c}") for c in sample.columns])
    return q.join(s, intersects("q_", "s_"))


def overlap_count_by_set(query: DataFrame, sample: DataFrame) -> DataFrame:
    """(row_idx, set_id, hits), by ranks: no pair is made."""
    return O.counted(query, sample, "set_id", BIN, 64)


def overlap_count(query: DataFrame, sample: DataFrame) -> DataFrame:
    """(row_idx, hits) of the queries that meet any, by ranks: no pair is made."""
    return O.counted(query, sample, None, BIN, 64)


def _hit_ids(query: DataFrame, sample: DataFrame) -> DataFrame:
    return overlap_count(query, sample).select("row_idx")


def overlap_any(query: DataFrame, sample: DataFrame) -> DataFrame:
    """Query rows that meet a sample row."""
    return query.join(_hit_ids(query, sample), "row_idx", "left_semi")


def overlap_none(query: DataFrame, sample: DataFrame) -> DataFrame:
    return query.join(_hit_ids(query, sample), "row_idx", "left_anti")


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the same position on both sides; it ends with the shorter one."""
    return left.join(right, keys)


#: Rows of a key that meet at a time.
MEET = 8192


def upper_pairs(df: DataFrame, order: str, *keys: str, on: Column | None = None, block: int | None = None) -> DataFrame:
    """Pairs i < j of rows within equal keys; columns get the prefixes a_ and b_. Rows of a key are dealt into blocks of about `block` rows
    and meet by pairs of blocks, so that a key of many rows is not one task; a row is copied once a block of its key."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / (block or MEET)).cast("int").alias("__m"))
    dealt = (df.join(sizes, list(keys)) if keys else df.crossJoin(F.broadcast(sizes))).withColumn("__own", F.pmod(F.xxhash64(order), F.col("__m")).cast("int"))
    dealt = dealt.select(*df.columns, "__own", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)).alias("__other"))
    a = dealt.select(*[F.col(c).alias(f"a_{c}") for c in df.columns], F.col("__own").alias("__p"), F.col("__other").alias("__q"))
    b = dealt.select(*[F.col(c).alias(f"b_{c}") for c in df.columns], F.col("__other").alias("__r"), F.col("__own").alias("__s"))
    # a number of partitions keeps these few bytes, and the many pairs they make, from being put together in one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = a.repartition(parts, *[f"a_{k}" for k in keys], "__p", "__q")
    b = b.repartition(parts, *[f"b_{k}" for k in keys], "__r", "__s")
    cond = (F.col(f"a_{order}") < F.col(f"b_{order}")) & (F.col("__p") == F.col("__r")) & (F.col("__q") == F.col("__s"))
    for k in keys:
        cond = (F.col(f"a_{k}") == F.col(f"b_{k}")) & cond
    return a.hint("merge").join(b, cond if on is None else cond & on).drop("__p", "__q", "__r", "__s")


def common_items(left: DataFrame, right: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Items (item, rank) of both rankings with their new ranks, relative order kept: item, left_rank, right_rank."""
    group = group or []
    both = left.withColumnRenamed("rank", "l").join(right.withColumnRenamed("rank", "r"), [*group, "item"])
    both = both.withColumn("__group", F.struct(*group) if group else F.lit(0))
    ranked = numbered(numbered(both, "l", "__group", "left_rank"), "r", "__group", "right_rank")
    return ranked.select(*group, "item", *[(F.col(c) + 1).alias(c) for c in ("left_rank", "right_rank")])


def require_same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of both sides; a key that only one has is an error that names it."""
    both = left.select(F.col(key), F.lit(1).alias("l")).distinct().join(right.select(F.col(key), F.lit(1).alias("r")).distinct(), key, "full_outer")
    bad = F.raise_error(F.concat(F.lit("only on one side: "), F.col(key).cast("string"))).cast("string")
    return both.select(F.when(F.col("l").isNull() | F.col("r").isNull(), bad.cast(dict(left.dtypes)[key])).otherwise(F.col(key)).alias(key))


def missing_keys(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return known.join(found, key, "left_anti").select(key)


def locate(lists: DataFrame, wanted: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(idx, list, offset) of global positions in the concatenation of lists (list, size).

    Lists and positions meet in bins of `width` positions; a list over many bins is a row in each, and a bin's lists are those that
    begin or go on in it. Empty lists hold no position.
    """
    w = Window.orderBy("list").rowsBetween(Window.unboundedPreceding, -1)  # a row a list
    spans = lists.withColumn("lo", F.coalesce(F.sum("size").over(w), F.lit(0))).filter("size > 0").select("list", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    spans = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    met = wanted.withColumn("__bin", F.floor(F.col("idx") / width)).join(spans, "__bin")
    return met.filter((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))).select("idx", "list", (F.col("idx") - F.col("lo")).alias("offset"))
