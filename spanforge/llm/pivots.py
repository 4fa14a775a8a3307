"""Exact top-k inner products by pivot-table elimination.

The index is a table of blocks of rows: packed vectors beside their distances to the same few dozen pivots. As the triangle inequality
gives |d(q, p) - d(x, p)| <= d(q, x) for every pivot p, the largest of these differences bounds a candidate's distance from
below and so its inner product, (q² + x² - d²) / 2, from above. Candidates are worked out in the order of their bounds until the
next bound is strictly below the k-th best score so far. Pivots only order and end the work: results are exact with any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import exact_type, grouped, is_usable, largest, packed, scaled, unpacked

#: Pivots, and the rows by smallest hash of their id among which they are chosen.
PIVOTS, FIT = 32, 1024
#: Most bytes of queries that are sent to the tasks at a time, about; queries of a block, at most.
ROUND_BYTES, QUERY_ROWS = 16 << 20, 512
#: The first candidates of a query in a block that are worked out before it looks at its bounds again; then twice as many, and so on.
FIRST = 32
INDEX = "block long, n int, ids array<long>, body binary, norms array<long>, apart binary"
RESULT = "query_id long, rank int, vec_id long, score long"


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, the shorter ones padded by zeros; exact integers."""
    width = min(x.shape[1], y.shape[1])
    kind = exact_type(max(largest(x), largest(y)), max(x.shape[1], y.shape[1]))
    return x[:, :width].astype(kind) @ y[:, :width].astype(kind).T


def _norms(x: np.ndarray) -> np.ndarray:
    exact_type(largest(x), x.shape[1])
    return np.einsum("ij,ij->i", x, x)


def _apart(x: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to the pivots."""
    squares = norms[:, None].astype(np.float64) + _norms(pivots)[None, :] - 2.0 * _dot(x, pivots)
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


def _choose(rows: list[list[float]], scale: int, pivots: int) -> np.ndarray:
    """Pivots far from each other: each next one is the row that is furthest from those before it."""
    width = max(map(len, rows), default=0)
    x = scaled(np.array([[*r, *[0.0] * (width - len(r))] for r in rows], np.float64).reshape(len(rows), width), scale)
    norms, chosen = _norms(x), [0][: len(x)]
    nearest = np.full(len(x), np.inf)
    while chosen and len(chosen) < min(pivots, len(x)):
        last = x[chosen[-1] : chosen[-1] + 1]
        nearest = np.minimum(nearest, norms + float(_norms(last)[0]) - 2.0 * _dot(x, last)[:, 0])
        chosen.append(int(np.argmax(nearest)))
    return x[chosen]


def build_index(df: DataFrame, scale: int = 1024, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Blocks of all usable vectors, those without null or non-finite components, with their distances to the pivots, stored in the
    shared folder. A component x counts as floor(scale * x). (block, place in it) names a row, so repeated rows stay apart."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(is_usable("vector"))
    some = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(FIT).select("vector").collect()
    chosen = _choose([r[0] for r in some], scale, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for at, x in grouped(batch, "vector", scale):
                norms = _norms(x)
                block = TaskContext.get().partitionId() << 32 | made
                made += 1
                cells = (block, len(x), batch.column("id").take(pa.array(at)).to_pylist(), packed(x), norms.tolist(), _apart(x, norms, chosen).tobytes())
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.binary())
                names = ("block", "n", "ids", "body", "norms", "apart")
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)

    return cut(rows.mapInArrow(run, INDEX))


@dataclass
class Block:
    block: int
    ids: np.ndarray
    null: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    apart: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, ids = batch.column("n")[i].as_py(), batch.column("ids")[i].values
            null = ids.is_null().to_numpy(zero_copy_only=False)
            apart = np.frombuffer(batch.column("apart")[i].as_py(), np.float32).reshape(n, -1)
            yield Block(batch.column("block")[i].as_py(), ids.fill_null(0).to_numpy(), null, unpacked(batch.column("body")[i].as_py(), n), batch.column("norms")[i].values.to_numpy(), apart)


@dataclass
class Queries:
    """Up to QUERY_ROWS queries of one length, and the best candidates of each so far."""

    k: int
    of: np.ndarray  # the block and place of the row that a query is
    place: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    apart: np.ndarray
    best: list = field(default_factory=list)
    evaluated: int = 0

    def __post_init__(self) -> None:
        self.best = [np.zeros((3, 0), np.int64) for _ in self.ids]  # score, whether the id is null, id

    def _keep(self, q: int, found: np.ndarray) -> None:
        both = np.concatenate((self.best[q], found), axis=1)
        self.best[q] = both[:, np.lexsort((both[2], both[1], -both[0]))[: self.k]]

    def bounds(self, at: slice, block: Block) -> np.ndarray:
        """Upper bounds of the scores of some queries with all rows of the block."""
        low = np.zeros((len(self.ids[at]), len(block.ids)), np.float32)
        mine, theirs = self.apart[at], np.ascontiguousarray(block.apart.T)
        for p in range(mine.shape[1]):
            np.maximum(low, np.abs(mine[:, p : p + 1] - theirs[p][None, :]), out=low)
        most = float(max(self.apart[at].max(initial=0), block.apart.max(initial=0)))
        low = np.maximum(low.astype(np.float64) - most * 2.0**-21, 0)  # distances are rounded to 24 bits
        both = self.norms[at][:, None].astype(np.float64) + block.norms[None, :]
        return (both - low * low) / 2 + 1 + both * 2.0**-50

    def search(self, block: Block) -> None:
        for lo in range(0, len(self.ids), 64):
            bounds = self.bounds(slice(lo, lo + 64), block)
            for q in range(lo, lo + len(bounds)):
                self._search(q, bounds[q - lo], block)

    def _search(self, q: int, bound: np.ndarray, block: Block) -> None:
        if self.of[q] == block.block:
            bound[self.place[q]] = -np.inf
        last = lambda: self.best[q][0, -1] if self.best[q].shape[1] == self.k else -np.inf
        order = np.flatnonzero((bound >= last()) & (bound > -np.inf))
        order = order[np.argsort(-bound[order], kind="stable")]
        at, step = 0, FIRST
        while at < len(order) and bound[order[at]] >= last():
            some = order[at : at + step]
            score = _dot(block.x[some], self.x[q : q + 1])[:, 0].astype(np.int64)
            self.evaluated += len(some)
            self._keep(q, np.stack((score, block.null[some].astype(np.int64), block.ids[some])))
            at, step = at + step, 2 * step


def _pick(divisor: int) -> Callable:
    """The rows that are queries, without their blocks' other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            at = np.flatnonzero(~b.null & (b.ids % divisor == 0))
            for i in range(0, len(at), QUERY_ROWS):
                some = at[i : i + QUERY_ROWS]
                cells = (b.block, len(some), some.tolist(), b.ids[some].tolist(), packed(b.x[some]), b.norms[some].tolist(), b.apart[some].tobytes(), b.x.shape[1])
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["block", "n", "places", "ids", "body", "norms", "apart", "width"])

    return run


PICKED = "block long, n int, places array<long>, ids array<long>, body binary, norms array<long>, apart binary, width int"


def _joined(rows: list, k: int) -> list[Queries]:
    """Queries of equal length together, up to QUERY_ROWS."""
    out: list[Queries] = []
    for width in sorted({r["width"] for r in rows}):
        mine = [r for r in rows if r["width"] == width]
        of = np.concatenate([np.full(r["n"], r["block"], np.int64) for r in mine])
        place, ids, norms = (np.concatenate([np.array(r[c], np.int64) for r in mine]) for c in ("places", "ids", "norms"))
        x = np.concatenate([unpacked(bytes(r["body"]), r["n"]) for r in mine])
        apart = np.concatenate([np.frombuffer(r["apart"], np.float32).reshape(r["n"], -1) for r in mine])
        out += [Queries(k, *(a[i : i + QUERY_ROWS] for a in (of, place, ids, x, norms, apart))) for i in range(0, len(ids), QUERY_ROWS)]
    return out


def _find(sent, k: int) -> Callable:
    """Each task's k best candidates of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _joined(sent.value, k)
        for block in _blocks(batches):
            for some in queries:
                some.search(block)
        for some in queries:
            sizes = [b.shape[1] for b in some.best]
            score, null, ids = np.concatenate(some.best, axis=1)
            columns = [pa.array(np.repeat(a, sizes)) for a in (some.of, some.place, some.ids)] + [pa.array(ids, mask=null > 0), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, k: int = 10, divisor: int = 100) -> DataFrame:
    """The k highest inner products of each query with all other rows of the index: query_id, rank from 1, vec_id, score.

    Queries are the rows whose id is divisible by `divisor`; a row is no candidate of its own, but a repeated row is one of the other.
    Ties go to the smaller id, null ids last. A shorter vector counts as padded by zeros. Queries go to the tasks in
    rounds of about ROUND_BYTES, so what is broadcast does not grow with the table; each round reads the index once.
    """
    picked = cut(index.mapInArrow(_pick(divisor), PICKED))
    size = F.length("body") + F.length("apart") + 40 * F.col("n")
    before = Window.orderBy("part")
    # a running total in two levels: over the parts, a row each, and over the rows of a part
    sized = picked.select("*", size.alias("size"), F.shiftright("block", 32).alias("part"))
    starts = sized.groupBy("part").agg(F.sum("size").alias("of_part")).select("part", (F.sum("of_part").over(before) - F.col("of_part")).alias("start"))
    total = F.sum("size").over(Window.partitionBy("part").orderBy("block", F.col("places")[0]))
    rounds = sized.join(starts, "part").select("*", F.floor((F.col("start") + total - 1) / ROUND_BYTES).alias("round"))
    found = None
    for r in [x[0] for x in rounds.select("round").distinct().sort("round").collect()]:
        rows = rounds.filter(F.col("round") == r).select(*picked.columns).collect()
        sent = index.sparkSession.sparkContext.broadcast([x.asDict() for x in rows])
        one = index.mapInArrow(_find(sent, k), "block long, place long, query_id long, vec_id long, score long")
        found = one if found is None else cut(found.unionByName(one))
    if found is None:
        return index.sparkSession.createDataFrame([], RESULT)
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(df: DataFrame, k: int = 10, divisor: int = 100, scale: int = 1024, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`search` over an index of the whole table. Null vectors and those with null or non-finite components take no part; columns other
    than the two named are not read; an empty table gives an empty one."""
    return search(build_index(df, scale, pivots, id_col, vector_col), k, divisor)


ORACLE = """WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 1 + (SELECT max(len(embedding)) FROM kept)) AS t(i) WHERE i <= len(embedding)),
scores AS (SELECT q.row AS q, c.row AS c, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM v AS q JOIN kept ON kept.row = q.row AND kept.vec_id % 100 = 0
  JOIN v AS c ON c.i = q.i AND c.row <> q.row GROUP BY q.row, c.row)
SELECT query_id, rank, vec_id, score FROM (SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, b.vec_id NULLS LAST) AS INTEGER) AS rank, b.vec_id, score
  FROM scores JOIN kept AS a ON a.row = q JOIN kept AS b ON b.row = c) WHERE rank <= 10"""
