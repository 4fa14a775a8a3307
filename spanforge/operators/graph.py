"""Similarity masks, sampling and triplets."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import digest, number as drawn
from ..functions.vectors import vector_mean
from ..sources.text import require
from .cells import Cell, by_cell, square
from .lineage import cut


def similarity_mask(scores: DataFrame, labels: DataFrame, label: str, threshold: float = 0.96) -> DataFrame:
    """(other, is_positive) for every known label: distance 1 − similarity of at most the threshold; pairs without a score are not. An unknown label is an error."""
    own = scores.filter(F.col("label") == label).select("other", "similarity")
    known = labels.agg(F.count_if(F.col("other") == label).alias("__k"))
    rows = labels.join(own, "other", "left").crossJoin(F.broadcast(known)).filter(require(F.col("__k") > 0, f"unknown: {label}"))
    return rows.select("other", F.coalesce(1 - F.col("similarity") <= threshold, F.lit(False)).alias("is_positive"))


def mask_to_labels(mask: DataFrame) -> DataFrame:
    return mask.groupBy("is_positive").agg(F.array_sort(F.collect_list("other")).alias("labels"))


def labels_to_mask(labels: DataFrame, positive: DataFrame) -> DataFrame:
    return labels.join(positive.select("other", F.lit(True).alias("__p")), "other", "left").select("other", F.coalesce("__p", F.lit(False)).alias("is_positive"))


def graph_arguments(batch: int, ratio: float) -> tuple[int, int]:
    """(groups, size of each) for a batch: k = sqrt(batch / ratio), p = k x ratio, rounded, 1 at least."""
    k = math.sqrt(batch / ratio)
    return max(1, round(k)), max(1, round(k * ratio))


def cluster_sample(sets: DataFrame, positives: DataFrame, anchors: int, size: int, rate: float, seed: int = 42) -> DataFrame:
    """(cluster, place, set_id, k): anchors with replacement; each with itself and size − 1 of its positives with replacement;
    max(1, round(rate x n)) rows of each chosen set without replacement. sets: (set_id, n); positives: (set_id, other). Draws are by hash."""
    ordered = sets.withColumn("o", F.row_number().over(Window.orderBy("set_id")) - 1)
    count = ordered.agg(F.count("*").alias("c"))
    spark = sets.sparkSession
    picks = spark.range(anchors).select(F.col("id").alias("cluster")).crossJoin(F.broadcast(count)).select("cluster", (drawn(F.col("cluster"), seed) % F.col("c")).alias("o"))
    chosen = picks.join(ordered, "o").select("cluster", F.col("set_id").alias("anchor"))
    pos = positives.withColumn("o", F.row_number().over(Window.partitionBy("set_id").orderBy("other")) - 1)
    sizes = positives.groupBy("set_id").agg(F.count("*").alias("m"))
    slots = chosen.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).join(sizes, F.col("anchor") == F.col("set_id"), "left").drop("set_id")
    slots = slots.withColumn("o", F.when((F.col("place") > 0) & (F.col("m") > 0), drawn(F.col("cluster"), F.col("place"), seed) % F.col("m")))
    rows = slots.join(pos.select(F.col("set_id").alias("anchor"), "o", "other"), ["anchor", "o"], "left").select("cluster", "place", F.coalesce("other", "anchor").alias("set_id"))
    rows = rows.join(sets, "set_id").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    w = Window.partitionBy("cluster", "place").orderBy(digest(F.col("cluster"), F.col("place"), F.col("k"), seed), "k")
    rows = rows.withColumn("d", F.row_number().over(w)).filter(F.col("d") <= F.greatest(F.lit(1), F.rint(F.col("n") * rate)))
    return rows.select("cluster", "place", "set_id", "k")


def batch_nodes(sample: DataFrame, vectors: DataFrame, anchors: int, size: int) -> DataFrame:
    """(batch, node, set_id, vec): a node for each set that `cluster_sample` chose, with the mean of its rows' vectors; `anchors` clusters of `size`
    sets are a batch. vectors: (set_id, k, vec)."""
    rows = sample.join(vectors, ["set_id", "k"])
    rows = rows.withColumns({"batch": F.floor(F.col("cluster") / anchors), "node": F.col("cluster") % anchors * size + F.col("place")})
    return vector_mean(rows.select("batch", "node", "set_id", "vec"), ["batch", "node", "set_id"])


def batch_edges(nodes: DataFrame, positives: DataFrame) -> DataFrame:
    """(batch, i, j): the adjacency of the chosen nodes, as the entries that are true: nodes of one set, and those whose sets are
    positives (set_id, other). A batch is bounded, so this grows with the number of batches."""
    a = nodes.select("batch", F.col("node").alias("i"), "set_id")
    b = nodes.select("batch", F.col("node").alias("j"), F.col("set_id").alias("other"))
    alike = a.join(b.withColumnRenamed("other", "set_id"), ["batch", "set_id"]).select("batch", "i", "j")
    near = a.join(positives.filter("set_id <> other").distinct(), "set_id").join(b, ["batch", "other"]).select("batch", "i", "j")
    return alike.unionByName(near)


def _mined(strategy: str, margin: float, within: float):
    """Triplets of one batch: nodes and edges of a batch are one group, of a size that sampling bounds."""

    def run(nodes, edges):
        import pandas as pd

        if not len(nodes):
            return pd.DataFrame({"batch": [], "a": [], "p": [], "n": [], "d_ap": [], "d_an": []})
        nodes = nodes.sort_values("node")
        ids, at = nodes["node"].to_numpy(), {n: k for k, n in enumerate(nodes["node"])}
        x = np.array(nodes["vec"].tolist(), float).reshape(len(ids), -1)
        d = np.round(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 9)
        same = np.zeros((len(ids), len(ids)), bool)
        known = edges[edges["i"].isin(at) & edges["j"].isin(at)]
        same[known["i"].map(at).to_numpy(int), known["j"].map(at).to_numpy(int)] = True
        other = ~same
        np.fill_diagonal(same, False)
        np.fill_diagonal(other, False)
        if strategy == "all":
            a, p, n = np.nonzero(same[:, :, None] & other[:, None, :] & (d[:, :, None] - d[:, None, :] + margin > 0))
        else:
            far = np.where(same, d, -np.inf)
            p = far.argmax(1)
            d_ap = far.max(1)
            valid = other if strategy == "hard" else other & (d > d_ap[:, None]) & (d < d_ap[:, None] + within)
            near = np.where(valid, d, np.inf)
            n = near.argmin(1)
            a = np.flatnonzero(d_ap - near.min(1) + margin > 0)
            p, n = p[a], n[a]
        return pd.DataFrame({"batch": nodes["batch"].iloc[0], "a": ids[a], "p": ids[p], "n": ids[n], "d_ap": d[a, p], "d_an": d[a, n]})

    return run


def mine_batches(nodes: DataFrame, edges: DataFrame, margin: float, strategy: str = "hard", within: float | None = None) -> DataFrame:
    """(batch, a, p, n, d_ap, d_an): triplets of the nodes (batch, node, vec) of each batch, by its adjacency (batch, i, j), squared L2.

    hard: the farthest positive and the nearest negative of each anchor; semi-hard: the nearest negative that is farther than that positive, by less
    than `within` (margin, if not given); all: each pair of a positive and a negative. Ties go to the smaller node; only triplets with
    d_ap - d_an + margin > 0 count. A batch is mined in one task, the batches in parallel.
    """
    if strategy not in ("hard", "semi-hard", "all"):
        raise ValueError(f"unknown strategy: {strategy}")
    nodes = nodes.select(F.col("batch").cast("long").alias("batch"), F.col("node").cast("long").alias("node"), "vec")
    edges = edges.select(F.col("batch").cast("long").alias("batch"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    both = nodes.groupBy("batch").cogroup(edges.groupBy("batch"))
    return both.applyInPandas(_mined(strategy, margin, margin if within is None else within), "batch long, a long, p long, n long, d_ap double, d_an double")


def pairwise_squared(rows: DataFrame, block: int = 8192) -> DataFrame:
    """(i, j, same, d) of all ordered pairs i != j of rows (row_idx, label, vec): squared L2. Rows are dealt into blocks, and a cell of the
    square of blocks is worked out at a time, so no task holds more than two blocks and some of their pairs. Two blocks meet once, for both
    orders of their pairs. Rows without id or vector are left out."""
    rows = rows.select(F.col("row_idx").cast("long").alias("row_idx"), "label", F.col("vec").cast("array<double>").alias("vec")).dropna(subset=["row_idx", "vec"])
    names = ["i", "j", "same", "d"]

    def run(x: Cell, y: Cell) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 18) // len(y))
        for lo in range(0, len(x), step):
            at = slice(lo, lo + step)
            d = np.zeros((len(x.vec[at]), len(y)))
            for k in range(x.vec.shape[1]):
                apart = x.vec[at, k, None] - y.vec[None, :, k]
                d += apart * apart
            r, c = np.nonzero(x.id[at][:, None] != y.id[None, :])
            same = pc.equal(x.rows.column("label").take(pa.array(r + lo)), y.rows.column("label").take(pa.array(c)))
            i, j, d = pa.array(x.id[r + lo]), pa.array(y.id[c]), pa.array(d[r, c])
            yield pa.RecordBatch.from_arrays([i, j, same, d], names=names)
            if x is not y:
                yield pa.RecordBatch.from_arrays([j, i, same, d], names=names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return square(rows.withColumnRenamed("row_idx", "id"), [], block, True, parts).mapInArrow(by_cell([], run), "i long, j long, same boolean, d double")


def triplets_hard(dist: DataFrame, margin: float) -> DataFrame:
    """(a, p, n, d_ap, d_an): farthest positive and nearest negative of each anchor, ties by smaller id, where d_ap − d_an + margin > 0."""
    far = F.min_by("j", F.struct(-F.round("d", 9), F.col("j")))
    near = F.min_by("j", F.struct(F.round("d", 9), F.col("j")))
    p = dist.filter("same").groupBy("i").agg(far.alias("p"), F.max("d").alias("d_ap"))
    n = dist.filter("NOT same").groupBy("i").agg(near.alias("n"), F.min("d").alias("d_an"))
    return p.join(n, "i").filter(F.col("d_ap") - F.col("d_an") + margin > 0).select(F.col("i").alias("a"), "p", "n", "d_ap", "d_an")


def triplets_semi_hard(dist: DataFrame, margin: float) -> DataFrame:
    """As triplets_hard, with the nearest negative that is farther than the positive, but by less than the margin."""
    far = F.min_by("j", F.struct(-F.round("d", 9), F.col("j")))
    p = dist.filter("same").groupBy("i").agg(far.alias("p"), F.max("d").alias("d_ap"))
    n = dist.filter("NOT same").join(p, "i").filter((F.col("d") > F.col("d_ap")) & (F.col("d") < F.col("d_ap") + margin))
    n = n.groupBy("i").agg(F.min_by("j", F.struct(F.round("d", 9), F.col("j"))).alias("n"), F.min("d").alias("d_an"))
    return p.join(n, "i").select(F.col("i").alias("a"), "p", "n", "d_ap", "d_an")


def triplets_all(dist: DataFrame, margin: float) -> DataFrame:
    """Every (a, p, n) with d_ap − d_an + margin > 0."""
    p = dist.filter("same").select(F.col("i").alias("a"), F.col("j").alias("p"), F.col("d").alias("d_ap"))
    n = dist.filter("NOT same").select(F.col("i").alias("a"), F.col("j").alias("n"), F.col("d").alias("d_an"))
    return p.join(n, "a").filter(F.col("d_ap") - F.col("d_an") + margin > 0)


def max_triplets(nodes: DataFrame) -> DataFrame:
    """(hard, every): the most triplets there can be: one an anchor, and sum of positives x negatives. nodes: (row_idx, label)."""
    per = nodes.groupBy("label").agg(F.count("*").alias("n"))
    total = nodes.agg(F.count("*").alias("t"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum("n").alias("hard"), F.sum(F.col("n") * (F.col("n") - 1) * (F.col("t") - F.col("n"))).alias("every"))


def triplet_loss(triplets: DataFrame, margin: float) -> DataFrame:
    """Mean of max(L2(a, p) − L2(a, n) + margin, 0); distances in triplets are squared."""
    return triplets.agg(F.avg(F.greatest(F.sqrt("d_ap") - F.sqrt("d_an") + margin, F.lit(0.0))).alias("loss"))


BLOCK_ROWS = 2048
#: Anchors that stay in a task while all rows stream past, at most.
ANCHORS = 65_536
#: Distances that a task works out at a time where an anchor needs all of its own.
KEPT = 24_000_000
#: How far a distance by matrix product may be from the one by differences, with room for the ninth digit.
NEAR = 1e-8


class _Rows:
    """A block of rows in the order of their labels. `runs` says where a label's rows are."""

    def __init__(self, cell: pa.Scalar):
        rows = cell.values
        label = rows.field("label").to_numpy(zero_copy_only=False)
        order = np.argsort(label, kind="stable")
        label = label[order]
        self.id = rows.field("row_idx").to_numpy(zero_copy_only=False)[order]
        self.given = rows.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
        self.vec = self.given.astype(float, copy=False)
        self.bound = rows.field("bound").to_numpy(zero_copy_only=False)[order]
        starts = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        self.runs = {label[lo]: (lo, hi) for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(label)], strict=True)}
        square, one = (self.vec * self.vec).sum(1)[:, None], np.ones((len(label), 1))
        self.largest = square.max()
        self.left, self.right = np.hstack((-2 * self.vec, square, one)), np.hstack((self.vec, one, square))

    def shared(self, other: _Rows) -> Iterator[tuple[slice, slice]]:
        for label, (lo, hi) in self.runs.items():
            if at := other.runs.get(label):
                yield slice(lo, hi), slice(*at)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared L2 of rows, summed in the order of squared_l2."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        x = a[:, k] - b[:, k]
        out += x * x
    return out


class _Best:
    """The farthest (sign -1) or nearest (1) row of each anchor, ties to nine digits by smaller id, over blocks."""

    def __init__(self, anchors: _Rows, sign: int):
        n = len(anchors.id)
        self.anchors, self.sign = anchors, sign
        self.key, self.value, self.id = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, np.int64)

    def add(self, rows: _Rows, first: int, columns: int, d: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> None:
        """d: sign x distance of anchors from `first` on to rows from `columns` on, infinite where they do not count; only what is above
        low and below high counts. Only what may reach an anchor's best is looked at closely."""
        at, near = slice(first, first + len(d)), NEAR + 1e-12 * (self.anchors.largest + rows.largest)
        best = self.value[at].copy()
        new = np.flatnonzero(np.isinf(best))
        if len(new):
            best[new] = (d[new] if low is None else np.where(d[new] > low[at][new, None] + near, d[new], np.inf)).min(1)
        limit = best + near if high is None else np.minimum(best, high[at]) + near
        maybe = d <= np.minimum(limit, np.finfo(float).max)[:, None]
        if low is not None:
            maybe &= d > (low[at] - near)[:, None]
        every, each = np.nonzero(maybe)
        for lo in range(0, len(every), 1 << 18):
            r, c = every[lo : lo + (1 << 18)] + first, each[lo : lo + (1 << 18)] + columns
            r, c = (x[self.anchors.id[r] != rows.id[c]] for x in (r, c))
            exact = _squared(self.anchors.vec[r], rows.vec[c])
            if low is not None:
                ok = (exact > low[r]) & (exact < high[r])
                r, c, exact = r[ok], c[ok], exact[ok]
            if len(r):
                self._take(r, rows.id[c], self.sign * exact)

    def _take(self, r: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        np.minimum.at(self.value, r, exact)
        key = np.round(exact, 9)
        order = np.lexsort((ids, key, r))
        order = order[np.diff(r[order], prepend=-1) > 0]
        r, key, ids = r[order], key[order], ids[order]
        better = (key < self.key[r]) | ((key == self.key[r]) & (ids < self.id[r]))
        self.key[r[better]], self.id[r[better]] = key[better], ids[better]


def _apart(anchors: _Rows, rows: _Rows) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of some anchors at a time to rows of other labels, infinite to those of the same."""
    shared = list(anchors.shared(rows))
    for lo in range(0, len(anchors.id), 512):
        d = anchors.left[lo : lo + 512] @ rows.right.T
        for a, b in shared:
            d[max(a.start - lo, 0) : max(a.stop - lo, 0), b] = np.inf
        yield lo, d


class _Far:
    """The farthest row of the same label."""

    SCHEMA = "a long, p long, d_ap double"

    def __init__(self, anchors: _Rows, margin: float):
        self.anchors, self.far = anchors, _Best(anchors, -1)

    def add(self, rows: _Rows) -> None:
        for a, b in self.anchors.shared(rows):
            for lo in range(a.start, a.stop, 512):
                d = self.anchors.left[lo : min(lo + 512, a.stop)] @ rows.right[b].T
                d[self.anchors.id[lo : min(lo + 512, a.stop), None] == rows.id[None, b]] = -np.inf
                self.far.add(rows, lo, b.start, -d)

    def done(self) -> list:
        p = np.isfinite(self.far.key)
        return [self.anchors.id[p], self.far.id[p], -self.far.value[p]]


class _Hard(_Far):
    SCHEMA = "a long, p long, n long, d_ap double, d_an double"

    def __init__(self, anchors: _Rows, margin: float):
        super().__init__(anchors, margin)
        self.near = _Best(anchors, 1)

    def add(self, rows: _Rows) -> None:
        super().add(rows)
        for lo, d in _apart(self.anchors, rows):
            self.near.add(rows, lo, 0, d)

    def done(self) -> list:
        k = np.isfinite(self.far.key) & np.isfinite(self.near.key)
        return [self.anchors.id[k], self.far.id[k], self.near.id[k], -self.far.value[k], self.near.value[k]]


class _SemiHard:
    SCHEMA = "a long, n long, d_an double"

    def __init__(self, anchors: _Rows, margin: float):
        self.anchors, self.low, self.high, self.near = anchors, anchors.bound, anchors.bound + margin, _Best(anchors, 1)

    def add(self, rows: _Rows) -> None:
        for lo, d in _apart(self.anchors, rows):
            self.near.add(rows, lo, 0, d, self.low, self.high)

    def done(self) -> list:
        k = np.isfinite(self.near.key)
        return [self.anchors.id[k], self.near.id[k], self.near.value[k]]


class _All:
    """What streams past is laid down in a file of the task, in the order of labels, since a few anchors at a time need all of it."""

    SCHEMA = "a long, n long, total double"

    def __init__(self, anchors: _Rows, margin: float):
        self.anchors, self.margin, self.file, self.ids, self.runs, self.total = anchors, margin, tempfile.TemporaryFile(), [], {}, 0

    def add(self, rows: _Rows) -> None:
        self.kind = rows.given.dtype
        rows.given.tofile(self.file)
        self.ids.append(rows.id)
        for label, (lo, hi) in rows.runs.items():
            self.runs.setdefault(label, []).append((self.total + lo, self.total + hi))
        self.total += len(rows.id)

    def _by_label(self) -> tuple[np.ndarray, dict]:
        """The ids of all rows by label, and where a label's rows are; the file is in that order thereafter."""
        order = np.concatenate([np.arange(*at) for runs in self.runs.values() for at in runs])
        sizes = [sum(hi - lo for lo, hi in runs) for runs in self.runs.values()]
        ends = np.cumsum(sizes).tolist()
        self.file.flush()
        laid, new = self._mapped(), tempfile.TemporaryFile()
        for lo in range(0, self.total, 16_384):
            laid[order[lo : lo + 16_384]].tofile(new)
        new.flush()
        del laid
        self.file.close()
        self.file = new
        return np.concatenate(self.ids)[order], {label: slice(end - n, end) for label, n, end in zip(self.runs, sizes, ends, strict=True)}

    def _mapped(self) -> np.ndarray:
        return np.memmap(self.file, self.kind, "r", shape=(self.total, self.anchors.vec.shape[1]))

    def done(self) -> list:
        count, total = np.zeros(len(self.anchors.id), np.int64), np.zeros(len(self.anchors.id))
        ids, labels = self._by_label()
        laid, order = self._mapped(), np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[order], self.anchors.id, side) for side in ("left", "right"))
        step = max(1, KEPT // max(1, self.total))
        held = np.empty((min(step, len(count)), self.total))
        none = slice(0, 0)
        for label, (lo, hi) in self.anchors.runs.items():
            own = labels.get(label, none)
            for some in range(lo, hi, step):
                d = held[: min(step, hi - some)]
                for at in range(0, self.total, 16_384):
                    vec = laid[at : at + 16_384].astype(float)
                    right = np.hstack((vec, np.ones((len(vec), 1)), (vec * vec).sum(1)[:, None]))
                    np.matmul(self.anchors.left[some : some + len(d)], right.T, out=d[:, at : at + len(vec)])
                np.maximum(d, 0, out=d)
                for k, x in enumerate(d, some):
                    x[order[first[k] : last[k]]] = np.inf  # the anchor itself
                    pos = np.sort(x[own])
                    pos = pos[: np.searchsorted(pos, np.inf)]
                    neg = np.concatenate((x[: own.start], x[own.stop :]))
                    neg.sort()
                    closer = np.searchsorted(neg, pos + self.margin)
                    count[k] = closer.sum()
                    total[k] = (closer * pos).sum()
                    if len(closer) and closer[-1]:
                        total[k] -= np.concatenate(([0.0], np.cumsum(neg[: closer[-1]])))[closer].sum()
        del laid
        self.file.close()
        k = count > 0
        return [self.anchors.id[k], count[k], total[k]]


def _folded(rows: DataFrame, fold: type, margin: float) -> DataFrame:
    """What fold says of each anchor after it has met all rows (row_idx, label, vec, bound). A block of anchors stays in one task
    and the blocks of all rows stream past it. Rows without id, label or vector are left out. Vectors are sent as floats where that loses nothing."""
    rows = rows.dropna(subset=["row_idx", "label", "vec"])
    same = F.forall("vec", lambda x: x.cast("float").cast("double") == x)
    total, floats = rows.agg(F.count("*"), F.coalesce(F.every(F.coalesce(same, F.lit(False))), F.lit(False))).first()
    if floats:
        rows = rows.withColumn("vec", F.col("vec").cast("array<float>"))
    # as few blocks of anchors as keep all cores busy: each takes a copy of the table
    spark = rows.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = max(1, min(ANCHORS, max(BLOCK_ROWS, -(-total // parts))))
    names = [c.split()[0] for c in fold.SCHEMA.split(", ")]

    def packed(n: int, name: str) -> DataFrame:
        cell = F.collect_list(F.struct("row_idx", "label", "vec", "bound")).alias("rows")
        return rows.groupBy(F.pmod(F.xxhash64("row_idx"), F.lit(n)).cast("int").alias(name)).agg(cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(state) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in state.done()], names=names)

        state = None
        for batch in batches:
            for s, cell in zip(batch.column("sb").to_pylist(), batch.column("rows"), strict=True):
                if s >= 0:
                    if state:
                        state.add(_Rows(cell))
                    continue
                if state:
                    yield told(state)
                state = fold(_Rows(cell), margin)
        if state:
            yield told(state)

    n, m = max(1, -(-total // size)), max(1, -(-total // BLOCK_ROWS))
    anchors = packed(n, "qb").withColumn("sb", F.lit(-1))
    past = packed(m, "sb").crossJoin(F.broadcast(anchors.select("qb")))  # every block of rows once a block of anchors
    grid = anchors.unionByName(past).repartitionById(n, "qb").sortWithinPartitions("qb", "sb")
    return grid.select("sb", "rows").mapInArrow(run, fold.SCHEMA)


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_idx").cast("long").alias("row_idx"), "label", "vec", F.lit(0.0).alias("bound"))


def mine_hard(rows: DataFrame, margin: float) -> DataFrame:
    """triplets_hard of all pairs of rows (row_idx, label, vec), of which only the best of each anchor is kept."""
    return _folded(_nodes(rows), _Hard, margin).filter(F.col("d_ap") - F.col("d_an") + margin > 0)


def mine_semi_hard(rows: DataFrame, margin: float) -> DataFrame:
    """triplets_semi_hard of all pairs of rows: the farthest positives first, then the negatives beyond them."""
    far = cut(_folded(_nodes(rows), _Far, margin))  # worked out once
    bound = _nodes(rows).drop("bound").join(far.select(F.col("a").alias("row_idx"), F.col("d_ap").alias("bound")), "row_idx", "left")
    near = _folded(bound.withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), _SemiHard, margin)
    return far.join(near, "a").select("a", "p", "n", "d_ap", "d_an")


def mine_all(rows: DataFrame, margin: float) -> DataFrame:
    """(a, n, total): how many triplets_all an anchor has among all pairs of rows, and their sum of d_ap − d_an. Positives are
    held against sorted negatives, so no triplet is a row; a task works out the distances of as many anchors at a time as fit."""
    return _folded(_nodes(rows), _All, margin)
