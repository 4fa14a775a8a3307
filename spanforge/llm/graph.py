"""Connected components by alternating stars over a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links as stars around the smallest node of each local component; they connect the same nodes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, root[x], root[y])
            np.minimum.at(low, root[y], root[x])
            low = low[low]
            while True:
                nxt = low[low]
                if (nxt == low).all():
                    break
                low = nxt
            low = low[root]
            if (low == root).all():
                break
            root = low
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the smallest node that it reaches.

    Links become local stars first; then large-star and small-star rounds run until nothing changes. Each round is a few
    aggregations and joins over a table that is no longer than the links, checkpointed in the shared folder.
    """
    n = partitions(links.sparkSession)
    stars = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").mapInArrow(_stars, "a long, b long")
    edges = cut(stars.repartition(n, "b").mapInArrow(_stars, "a long, b long").distinct())
    was = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.filter("a > b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == was:
            break
        was = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots)
