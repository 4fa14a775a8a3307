"""Exact nearest neighbours on a grid of queries and sample."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import intersects
from ..functions.vectors import unit

#: Queries that a cell of the grid holds, at most, about.
HELD = 32_768
#: Queries and rows of the sample that meet at a time.
ROWS, COLUMNS = 512, 2048


class _Best:
    """The k best of each query of a cell so far. Larger scores are better; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, metric: str, skip_self: bool):
        self.ids, self.vecs, self.k, self.metric, self.skip_self = ids, vecs, k, metric, skip_self
        self.squares = (vecs * vecs).sum(1)
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        for at in range(0, len(ids), COLUMNS):
            self._add(ids[at : at + COLUMNS], vecs[at : at + COLUMNS])

    def _add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Scores are those of a matrix product; only those that may reach a query's k-th best are rounded and ordered."""
        l2 = self.metric == "l2"
        squares = (vecs * vecs).sum(1)
        other = np.hstack((vecs, np.full((len(ids), 1), -1.0), -squares[:, None])) if l2 else vecs
        for lo in range(0, len(self.ids), ROWS):
            at = slice(lo, lo + ROWS)
            mine = np.hstack((2 * self.vecs[at], self.squares[at, None], np.ones((len(self.ids[at]), 1)))) if l2 else self.vecs[at]
            score = mine @ other.T  # minus the squared distance, if l2
            slack = 1e-9 + 1e-12 * (self.squares[at] + squares.max(initial=0))
            worst = self.score[at][:, -1]
            least = worst - slack
            if l2:
                least = -((1e-9 - worst) ** 2) - slack
            if len(ids) > self.k and len(new := np.flatnonzero(np.isinf(worst))):
                # one more, as the query itself may be among them
                kth = min(self.k + self.skip_self, len(ids)) - 1
                top = -np.partition(-score[new], kth, axis=1)[:, kth]
                least[new] = -((np.sqrt(np.maximum(-top, 0)) + 1e-9) ** 2) - slack[new] if l2 else top - slack[new]
            q, c = np.nonzero(score >= least[:, None])
            if not len(q):
                continue
            x = score[q, c]
            if l2:
                own = self.squares[at][q] - 2 * np.einsum("ij,ij->i", self.vecs[at][q], vecs[c]) + squares[c]
                x = -np.sqrt(np.maximum(own, 0))
            x = np.round(x, 9)
            if self.skip_self:
                keep = self.ids[at][q] != ids[c]
                q, c, x = q[keep], c[keep], x[keep]
            touched = np.unique(q)
            old_q, old_c = np.nonzero(self.score[at][touched] > -np.inf)
            old_q = touched[old_q]
            q, x, found = np.concatenate((old_q, q)), np.concatenate((self.score[at][old_q, old_c], x)), np.concatenate((self.found[at][old_q, old_c], ids[c]))
            order = np.lexsort((found, -x, q))
            q, x, found = q[order], x[order], found[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < self.k
            self.score[at][touched], self.found[at][touched] = -np.inf, 0
            self.score[at][q[keep], place[keep]], self.found[at][q[keep], place[keep]] = x[keep], found[keep]

    def rows(self) -> pa.RecordBatch:
        q, c = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, c]), pa.array(self.score[q, c])], names=["query", "found", "score"])


def _cells(k: int, metric: str, skip_self: bool):
    """The rows of a cell are its queries, then its part of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None
        for batch in batches:
            cells, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            ids = batch.column("id").to_numpy()
            vecs = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            cuts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1) | np.diff(side, prepend=side[:1])) if len(ids) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if cells[lo] != cell:
                    if best is not None:
                        yield best.rows()
                    cell, held, best = cells[lo], [], None
                if side[lo] == 0:
                    held.append((ids[lo:hi], vecs[lo:hi]))
                    continue
                if best is None and held:
                    best = _Best(*(np.concatenate(x) for x in zip(*held, strict=True)), k, metric, skip_self)
                if best is not None:
                    best.add(ids[lo:hi], vecs[lo:hi])
        if best is not None:
            yield best.rows()

    return run


def knn(queries: DataFrame, sample: DataFrame, k: int, metric: str = "ip", skip_self: bool = False) -> DataFrame:
    """(query, found, score, rank) of the k best rows of sample for each query, larger inner product or (metric l2) smaller
    distance first, ties by smaller id. Both sides are (id, vec); rows without either are left out.

    Queries and sample are dealt over a grid of about as many cells as there are shuffle partitions, and over more rows of it where a
    cell would hold too many queries. A cell holds its queries and lets its part of the sample stream past, so a query is copied once a
    column and a sample row once a row of the grid, and k candidates a query and cell are sent on: the grid has as many columns as
    make the least of all that, no more than the square root of the cells. No side is broadcast or gathered.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # numbers of rows and the width of a vector, a row known when it runs; 24 bytes a candidate
    asked, held = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("w")), sample.agg(F.count("*").alias("m"))
    wide = 8 * F.greatest(F.coalesce("w", F.lit(1)), F.lit(1)) + 24
    best = F.round(F.sqrt(F.lit(parts) * F.col("m") * wide / (F.greatest("n", F.lit(1)) * (wide + 24 * k)))).cast("int")
    grid = asked.crossJoin(held).select("n", F.greatest(F.lit(1), F.least(F.lit(math.isqrt(parts)), best)).alias("across"))
    # more rows only where queries are many
    grid = grid.select("across", F.greatest(F.floor(F.lit(parts) / F.col("across")), F.ceil(F.col("n") / HELD)).cast("int").alias("down"))
    q, s = (x.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).dropna().crossJoin(F.broadcast(grid)) for x in (queries, sample))
    row = F.pmod(F.xxhash64("id"), F.col("down"))
    column = F.pmod(F.xxhash64("id", F.lit(1)), F.col("across"))
    q = q.select("id", "vec", F.lit(0).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: row * F.col("across") + j)).alias("cell"))
    s = s.select("id", "vec", F.lit(1).alias("side"), F.explode(F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: i * F.col("across") + column)).alias("cell"))
    grid = q.unionByName(s).repartition("cell").sortWithinPartitions("cell", "side").select(F.col("cell").cast("long").alias("cell"), "side", "id", "vec")
    near = grid.mapInArrow(_cells(k, metric, skip_self), "query long, found long, score double")
    if metric == "l2":
        near = near.withColumn("score", -F.col("score"))
    order = [F.col("score").asc() if metric == "l2" else F.col("score").desc(), F.col("found")]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def knn_overlap(queries: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """Neighbours whose base intervals meet the query's: distinct (q_row_idx, s_row_idx) with the intervals.

    Both sides are (id, base_idx, vec, chrom, start, end): id numbers the transformed rows, base_idx and the coordinates are those of the row they come from.
    Sample vectors are normalised, query vectors are not (their order stays).
    """
    near = knn(queries.select("id", "vec"), sample.select("id", unit(F.col("vec")).alias("vec")), k)
    q = queries.select(F.col("id").alias("query"), *[F.col(c).alias(f"q_{'row_idx' if c == 'base_idx' else c}") for c in ("base_idx", "chrom", "start", "end")])
    s = sample.select(F.col("id").alias("found"), *[F.col(c).alias(f"s_{'row_idx' if c == 'base_idx' else c}") for c in ("base_idx", "chrom", "start", "end")])
    hits = near.join(q, "query").join(s, "found").filter(intersects("q_", "s_"))
    return hits.select("q_row_idx", "q_chrom", "q_start", "q_end", "s_row_idx", "s_chrom", "s_start", "s_end").distinct()
