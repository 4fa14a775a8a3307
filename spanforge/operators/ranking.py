"""Rankings of sets and their evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import digest
from ..functions.vectors import l2
from ..sources.text import numbered


def rank_all(sets: DataFrame) -> DataFrame:
    """(base, other, dist, rank): every set against every set by L2 of mean vectors, itself included. sets: (set_id, vec), a row a set."""
    a = sets.select(F.col("set_id").alias("base"), F.col("vec").alias("v"))
    b = sets.select(F.col("set_id").alias("other"), F.col("vec").alias("w"))
    rows = a.crossJoin(b).select("base", "other", l2(F.col("v"), F.col("w")).alias("dist"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy(F.round("dist", 9), "other")))


def one_to_many(sets: DataFrame, query: str) -> DataFrame:
    """(other, dist, rank) for one base set."""
    q = sets.filter(F.col("set_id") == query).select(F.col("vec").alias("v"))
    rows = sets.crossJoin(F.broadcast(q)).select(F.col("set_id").alias("other"), l2(F.col("v"), F.col("vec")).alias("dist"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.round("dist", 9), "other")))


#: Fixed value: how a checkpoint's file is named.
CHECKPOINT_TIME = "yyyy-MM-dd_HH-mm-ss"


def loss_curve(checkpoints: DataFrame, every: int = 100) -> DataFrame:
    """(step, train_loss, eval_loss) of checkpoints (name, train_loss, eval_loss) in the order of the times that name them, one each `every` steps.
    A name that is no time is an error."""
    rows = checkpoints.withColumn("__time", F.unix_timestamp("name", CHECKPOINT_TIME)).withColumn("__all", F.lit(0))
    return numbered(rows, "__time", "__all", "place").select((F.col("place") * every).alias("step"), "train_loss", "eval_loss")


def invert(df: DataFrame, col: str) -> DataFrame:
    """The largest value less each."""
    return df.join(F.broadcast(df.agg(F.max(col).alias("__top")))).withColumn(col, F.col("__top") - F.col(col)).drop("__top")


def scores_to_ranks(df: DataFrame, keys: list[str], id_: str, score: str) -> DataFrame:
    """0-based places by score, larger first, ties by larger id."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_).desc())) - 1)


def reciprocal_rank(ranked: DataFrame, keyword_columns: list[str], known: DataFrame) -> DataFrame:
    """(base, keyword, total, place): keywords of known by the sum of 1/rank of the rows that carry them; ties in dictionary order.

    ranked: (base, rank, keyword columns…); known: (keyword, ord).
    """
    rows = ranked.select("base", "rank", F.explode(F.array(*keyword_columns)).alias("keyword"))
    sums = rows.groupBy("base", "keyword").agg(F.sum(1 / F.col("rank")).alias("total"))
    spine = ranked.select("base").distinct().crossJoin(F.broadcast(known))
    out = spine.join(sums, ["base", "keyword"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("base").orderBy(F.round("total", 9).desc(), "ord")))


def ideal_gain(cells: int, states: int) -> float:
    """Gain of the ideal list: one item with both keywords, then one for each other keyword."""
    return 2 + sum(1 / math.log2(i + 3) for i in range(cells + states - 1))


def ndcg(ranked: DataFrame, cells: int, states: int) -> DataFrame:
    """(base, ndcg): gain 1 for the same cell and 1 for the same state, over the whole list. ranked has cell, state, other_cell, other_state, rank."""
    gain = (F.col("cell") == F.col("other_cell")).cast("int") + (F.col("state") == F.col("other_state")).cast("int")
    return ranked.groupBy("base").agg((F.sum(gain / F.log2(F.col("rank") + 1)) / ideal_gain(cells, states)).alias("ndcg"))


def inversions(sequences: np.ndarray) -> np.ndarray:
    """How many pairs of each row of a matrix are out of order; rows are orders of 0 … n - 1. One stable split by each bit, from
    the highest on: of places with equal higher bits, a zero bit is out of order with the ones before it."""
    rows, n = sequences.shape
    x, total = sequences.astype(np.int64), np.zeros(rows, np.int64)
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        one = x >> bit & 1
        before = np.cumsum(one, axis=1)
        high = x >> bit + 1
        new = np.ones(x.shape, bool)
        new[:, 1:] = high[:, 1:] != high[:, :-1]
        at_start = np.maximum.accumulate(np.where(new, before - one, 0), axis=1)
        total += ((before - at_start) * (1 - one)).sum(1)
        order = np.argsort(x >> bit, axis=1, kind="stable")
        x = np.take_along_axis(x, order, 1)
    return total


#: Rankings of a block.
BLOCK = 32


def _taus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rankings of two blocks. A pair is compared on its common items, by one count of inversions."""

    def rankings(cell: pa.Scalar) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for r in cell.as_py():
            out.setdefault(r["name"], {})[r["item"]] = r["place"]
        return out

    for batch in batches:
        found = []
        for i in range(batch.num_rows):
            left, right = (rankings(batch.column(c)[i]) for c in ("left", "right"))
            same = batch.column("a")[i] == batch.column("b")[i]
            for a, x in left.items():
                for b, y in right.items():
                    if same and b < a:
                        continue
                    both = [k for k in sorted(x, key=x.get) if k in y]
                    m = len(both)
                    if m > 1:
                        order = np.argsort(np.argsort([y[k] for k in both], kind="stable"), kind="stable")
                        tau = 1 - 4 * int(inversions(order[None, :])[0]) / (m * (m - 1))
                        found += [(a, b, tau)] if a == b else [(a, b, tau), (b, a, tau)]
        yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "tau"), f, strict=True)) for f in found], schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("tau", pa.float64())]))


def kendall_tau(rankings: DataFrame) -> DataFrame:
    """(a, b, tau) of all pairs of rankings (name, item, place) without ties; symmetric, 1 with itself; pairs with under two common
    items are left out. Rankings go in blocks; each pair of blocks meets once, and each pair of rankings costs n log n."""
    rows = rankings.select(F.col("name").cast("string").alias("name"), "item", F.col("place").cast("double").alias("place"))
    names = rows.select("name").distinct().agg(F.count("*").alias("names"))
    blocks = rows.crossJoin(F.broadcast(names)).withColumn("block", F.pmod(F.xxhash64("name"), F.ceil(F.col("names") / BLOCK)))
    packed = blocks.groupBy("block").agg(F.collect_list(F.struct("name", "item", "place")).alias("rows"))
    left, right = (packed.select(F.col("block").alias(n), F.col("rows").alias(side)) for n, side in (("a", "left"), ("b", "right")))
    return left.join(right, F.col("a") <= F.col("b")).repartition("a", "b").mapInArrow(_taus, "a string, b string, tau double")


def _run_taus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("order")
        n = len(lists[0]) if batch.num_rows else 0
        if n > 1:
            x = np.argsort(np.argsort(lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n), axis=1, kind="stable"), axis=1, kind="stable")
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(1 - 4 * inversions(x) / (n * (n - 1)))], names=["run", "tau"])


def kendall_pvalue(left: DataFrame, right: DataFrame, resamples: int = 9999, seed: int = 42) -> DataFrame:
    """(items, tau, p): one-sided permutation test on the items both rankings have; under 2 of them, both null.

    A resample orders the items of the right ranking by hash of (item, resample, seed): the same rows whatever the partitions. The common
    items are one row; each resample is drawn and counted where it is, n log n each.
    """
    both = left.select("item", F.col("rank").alias("x")).join(right.select("item", F.col("rank").alias("y")), "item")
    items = both.agg(F.collect_list(F.struct("y", F.col("item").cast("string").alias("item"), "x")).alias("items"))
    own = F.array_sort("items")
    drawn = F.array_sort(F.transform("items", lambda i: F.struct(digest(i["item"], F.col("run"), seed).alias("d"), i["item"].alias("item"), i["x"].alias("x"))))
    spark = left.sparkSession
    runs = spark.range(0, resamples + 1, 1, max(1, min(resamples // 64, 2 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "run").crossJoin(F.broadcast(items))
    order = F.when(F.col("run") == 0, F.transform(own, lambda i: i["x"])).otherwise(F.transform(drawn, lambda i: i["x"]))
    taus = runs.select("run", order.alias("order")).mapInArrow(_run_taus, "run long, tau double")
    first = taus.filter("run = 0").select(F.col("tau").alias("own"))
    out = taus.join(F.broadcast(first)).agg(F.max("own").alias("tau"), ((1 + F.count_if((F.col("run") > 0) & (F.col("tau") >= F.col("own")))) / (1 + F.lit(resamples))).alias("p"))
    return items.select(F.size("items").cast("long").alias("items")).join(out).select("items", "tau", F.when(F.col("items") >= 2, F.col("p")).alias("p"))
