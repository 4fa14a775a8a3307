"""Splits and shards by position or by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(idx: Column, n: int) -> Column:
    return F.pmod(idx, F.lit(n))


def block_round_robin(idx: Column, block: int, n: int) -> Column:
    return F.pmod(F.floor(idx / block), F.lit(n))


def block_split(idx: Column, total: Column, n: int) -> Column:
    """Contiguous blocks, the last one with the rest; with fewer items than blocks, one each."""
    return F.when(total < n, idx).otherwise(F.least(F.floor(idx / F.floor(total / n)), F.lit(n - 1)))


def even_split(idx: Column, total: Column, n: int) -> Column:
    """Parts of which the first total mod n are one longer."""
    each, rest = F.floor(total / n), total % n
    head = rest * (each + 1)
    return F.when(idx < head, F.floor(idx / (each + 1))).otherwise(rest + F.floor((idx - head) / F.greatest(each, F.lit(1))))


def flatten_padded(sets: DataFrame, multiple: int) -> DataFrame:
    """(set_id, k, row_idx): places of each set (set_id, n), padded to a multiple; row_idx is null in the padding."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("n") / multiple) * multiple - 1).cast("long")))
    return sets.filter("n > 0").select("set_id", "n", k.alias("k")).select("set_id", "k", F.when(F.col("k") < F.col("n"), F.col("k")).alias("row_idx"))


def cv_split(names: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(name, place, split): names in the order of md5(name_seed), cut at whole numbers of train and val shares."""
    order = F.md5(F.concat(F.col("name"), F.lit(f"_{seed}")))
    rows = names.withColumn("place", F.row_number().over(Window.orderBy(order, "name")) - 1).crossJoin(F.broadcast(names.agg(F.count("*").alias("__n"))))
    cut_a, cut_b = F.floor(F.col("__n") * F.lit(train)), F.floor(F.col("__n") * F.lit(val))
    split = F.when(F.col("place") < cut_a, "train").when(F.col("place") < cut_a + cut_b, "val").otherwise("test")
    return rows.select("name", F.col("place").cast("long").alias("place"), split.alias("split"))


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts with the part's number."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out
