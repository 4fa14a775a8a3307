"""Exact neighbours among vectors of few numbers: near rows share a box along their own axes, and boxes that hold no neighbour are passed over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample in a box, at most, and queries that look at boxes together.
BOX, TOGETHER = 256, 32
#: Queries that a task holds, at most, about, and rows of the sample that it holds at a time.
HELD, PIECE = 16_384, 1 << 18


def _near(vecs: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of rows in parts of at most `size` that are near each other: halves by the widest column."""
    todo, done = [np.arange(len(vecs))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        x, half = vecs[at], len(at) // 2
        order = np.argpartition(x[:, np.argmax(np.ptp(x, 0))], half)
        todo += [at[order[half:]], at[order[:half]]]
    return done


class _Rows:
    """(id, base_idx, vec, chrom, start, end) as arrays; rows with anything but finite numbers in vec are left out."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        vec = column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        ok = np.flatnonzero(np.isfinite(vec).all(1))
        self.vec, self.chrom = vec[ok], column("chrom").take(pa.array(ok))
        self.id, self.base, self.start, self.end, self.run = (column(c).fill_null(0).to_numpy()[ok] for c in ("id", "base_idx", "start", "end", "run"))
        self.known = np.array([column(c).is_valid().to_numpy(zero_copy_only=False)[ok] for c in ("chrom", "start", "end")]).all(0)

    def __len__(self) -> int:
        return len(self.id)


class _Boxes:
    """A piece of the sample. A box is the mean of its rows, their axes, and how far they go along each."""

    def __init__(self, rows: _Rows):
        squares = np.zeros(len(rows))
        for d in range(rows.vec.shape[1]):
            squares += rows.vec[:, d] * rows.vec[:, d]
        some = np.flatnonzero(squares > 0)
        norm = np.sqrt(squares[some])
        parts = _near(rows.vec[some] / norm[:, None], BOX)
        order = np.concatenate(parts)
        self.rows, self.at, self.norm = rows, some[order], norm[order]
        self.vec = np.ascontiguousarray(rows.vec[self.at].T)
        self.sizes = np.array([len(p) for p in parts])
        self.cuts = np.concatenate(([0], np.cumsum(self.sizes)))
        if not len(some):
            return
        unit = self.vec.T / self.norm[:, None]
        self.mean = np.add.reduceat(unit, self.cuts[:-1]) / self.sizes[:, None]
        off = unit - np.repeat(self.mean, self.sizes, axis=0)
        axes = np.linalg.eigh(np.add.reduceat(off[:, :, None] * off[:, None, :], self.cuts[:-1]))[1]
        along = np.einsum("nd,nde->ne", off, np.repeat(axes, self.sizes, axis=0))
        self.low, self.high = np.minimum.reduceat(along, self.cuts[:-1]).T, np.maximum.reduceat(along, self.cuts[:-1]).T
        self.axes = np.ascontiguousarray(axes.transpose(2, 1, 0))

    def candidates(self, vecs: np.ndarray, k: int, worst: np.ndarray) -> np.ndarray:
        """Places of the rows among which the k best of each query are, if they are better than what it has at worst."""
        mid = vecs @ self.mean.T
        upper, lower = mid.copy(), mid
        for axis, low, high in zip(self.axes, self.low, self.high, strict=True):
            p = vecs @ axis
            a, b = p * low, p * high
            upper += np.maximum(a, b)
            lower += np.minimum(a, b)
        boxes, many = len(self.sizes), -(-k // self.sizes.min())
        least = np.maximum(worst, np.partition(lower, boxes - many, axis=1)[:, boxes - many]) if many <= boxes else worst
        slack = 2e-9 + 1e-12 * np.abs(vecs).sum(1)
        keep = np.flatnonzero((upper >= (least - slack)[:, None]).any(0))
        n = self.sizes[keep]
        return np.arange(n.sum()) + np.repeat(self.cuts[keep] - np.cumsum(n) + n, n)


class _Group:
    """Near queries of one run, and the k best of each so far: score in units of the ninth digit, id, base and whether they meet."""

    def __init__(self, rows: _Rows, at: np.ndarray, k: int):
        self.rows, self.at, self.k = rows, at, k
        self.score, self.id, self.base = (np.zeros((len(at), 0), t) for t in (float, np.int64, np.int64))
        self.meets = np.zeros((len(at), 0), bool)

    def add(self, sample: _Boxes, codes: tuple[np.ndarray, np.ndarray]) -> None:
        vecs, had = self.rows.vec[self.at], self.score.shape[1]
        worst = self.score.min(1) / 1e9 if had == self.k else np.full(len(self.at), -np.inf)
        found = sample.candidates(vecs, self.k, worst)
        score = np.zeros((len(self.at), len(found)))
        for d, column in enumerate(sample.vec):  # in the order of the sum in SQL
            score += vecs[:, d, None] * column[found]
        score = np.hstack((self.score, np.rint(score / sample.norm[found] * 1e9)))
        at = sample.at[found]

        def of(q: np.ndarray, c: np.ndarray, own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
            out = np.empty(len(q), theirs.dtype)
            old = c < had
            out[old], out[~old] = own[q[old], c[old]], theirs[at[c[~old] - had]]
            return out

        width = min(self.k, score.shape[1])
        if score.shape[1] > width:
            kth = np.partition(score, score.shape[1] - width, axis=1)[:, score.shape[1] - width, None]
            take, tie = score > kth, score == kth
            need = width - take.sum(1)
            if (tie.sum(1) > need).any():
                q, c = np.nonzero(tie)
                order = np.lexsort((of(q, c, self.id, sample.rows.id), q))
                q, c = q[order], c[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < need[q]
                take[q[first], c[first]] = True
            else:
                take |= tie
            q, c = np.nonzero(take)
        else:
            q, c = (x.ravel() for x in np.indices(score.shape))
        new, shape = np.zeros(len(q), bool), (len(self.at), width)
        old, mine, theirs = c < had, self.at[q], sample.rows
        new[old] = self.meets[q[old], c[old]]
        a, b = mine[~old], at[c[~old] - had]
        shared = np.minimum(self.rows.end[a], theirs.end[b]) - np.maximum(self.rows.start[a], theirs.start[b])
        new[~old] = (codes[0][a] == codes[1][b]) & (shared > 0) & self.rows.known[a] & theirs.known[b]
        ids, base = of(q, c, self.id, theirs.id), of(q, c, self.base, theirs.base)
        self.score, self.id, self.base, self.meets = score[q, c].reshape(shape), ids.reshape(shape), base.reshape(shape), new.reshape(shape)


def _cell(ks: list[int]):
    """The rows of a task are queries, then all of the sample, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, piece, groups, queries = [], [], [], None

        def add() -> None:
            sample = _Rows(piece)
            names = pa.chunked_array([queries.chrom, sample.chrom]).dictionary_encode().unify_dictionaries()
            codes = tuple(x.indices.fill_null(-1).to_numpy() for x in names.chunks)
            boxes = _Boxes(sample)
            for group in groups if len(boxes.at) else ():
                group.add(boxes, codes)

        for batch in batches:
            side = batch.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))
            if cut:
                held.append(batch.slice(0, cut))
            if cut == batch.num_rows or not held:
                continue
            if queries is None:
                queries = _Rows(held)
                for r in np.unique(queries.run):
                    mine = np.flatnonzero(queries.run == r)
                    groups += [_Group(queries, mine[at], ks[r]) for at in _near(queries.vec[mine], TOGETHER)]
            piece.append(batch.slice(cut))
            if sum(map(len, piece)) >= PIECE:
                add()
                piece = []
        if piece:
            add()
        for group in groups:
            q, c = np.nonzero(group.meets)
            at = group.at[q]
            yield pa.RecordBatch.from_arrays([pa.array(queries.run[at]), pa.array(queries.base[at]), pa.array(group.base[q, c])], names=["run", "q_row_idx", "s_row_idx"])

    return run


def hits(queries: DataFrame, sample: DataFrame, ks: list[int]) -> DataFrame:
    """Distinct (run, q_row_idx, s_row_idx): base intervals that meet, of queries and their ks[run] nearest of the sample by inner product with
    unit vectors, to nine digits, ties by smaller id. Both sides are (id, base_idx, vec, chrom, start, end), queries also run; id numbers the
    rows of a side. A task holds its queries and a copy of the sample streams past, a piece at a time; only what meets leaves it."""
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-queries.count() // HELD))
    columns = [F.col(c).cast("long").alias(c) for c in ("id", "base_idx", "start", "end")]
    columns += [F.col("vec").cast("array<double>").alias("vec"), F.col("chrom"), F.col("run").cast("int").alias("run")]
    q = queries.dropna(subset=["id", "vec"]).select(F.pmod(F.xxhash64("base_idx"), F.lit(parts)).cast("int").alias("cell"), F.lit(0).alias("side"), *columns)
    s = sample.dropna(subset=["id", "vec"]).withColumn("run", F.lit(0)).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cell"), F.lit(1).alias("side"), *columns)
    grid = q.unionByName(s).repartitionById(parts, "cell").sortWithinPartitions("side").drop("cell")
    return grid.mapInArrow(_cell(ks), "run int, q_row_idx long, s_row_idx long").distinct()
