"""Quality classifier: a generalised additive model with pairwise interactions over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, grams, sliced

FEATURES = (
    "log_words", "word_bytes", "upper", "other_punctuation", "stops", "digits", "line_feeds", "beyond_ascii",
    "distinct_words", "distinct_pairs", "odd_endings", "bare_punctuation", "top_word", "log_distinct",
)

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 other punctuation, 3 full stop or comma, 4 digit, 5 line feed, 6 beyond ASCII
_KIND[65:91] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KIND[[44, 46]] = 3
_KIND[48:58] = 4
_KIND[10] = 5
_KIND[128:] = 6


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text; null and empty texts are all zeros."""
    w = Words(texts)
    n = len(w.rows) - 1
    offs = np.concatenate(([0], np.cumsum(_lengths(texts))))
    size = np.maximum(np.diff(offs), 1)
    kinds = _KIND[w.raw]
    words = np.diff(w.rows)
    some = np.maximum(words, 1)
    row = w.row_of()
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.bincount(row, w.ends - w.starts, n) / some
    for k in range(1, 7):
        sums = np.concatenate(([0], np.cumsum(kinds == k)))
        out[:, 1 + k] = (sums[offs[1:]] - sums[offs[:-1]]) / size
    salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(7))
    _, at, count = np.unique(w.hash ^ salt[row], return_index=True, return_counts=True)
    distinct = np.bincount(row[at], minlength=n)
    out[:, 8] = distinct / some
    pairs = grams(w.hash, 2)
    inside = row[: len(pairs)] == row[1:] if len(pairs) else np.zeros(0, bool)
    _, first = np.unique(pairs[inside] ^ salt[row[: len(pairs)][inside]], return_index=True)
    out[:, 9] = np.bincount(row[: len(pairs)][inside][first], minlength=n) / np.maximum(words - 1, 1)
    ends = _KIND[w.raw[w.ends - 1]] == 2
    out[:, 10] = np.bincount(row, ends, n) / some
    out[:, 11] = np.bincount(row, ends & (w.ends - w.starts == 1), n) / some
    top = np.zeros(n)
    np.maximum.at(top, row[at], count)
    out[:, 12] = top / some
    out[:, 13] = np.log1p(distinct)
    return out


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Gam:
    """Bin edges and a score table a feature, and a table a pair of features; a score is the sum of the entries a text falls in."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _split(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best cut of bins into two by gain."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    left = g[:-1] ** 2 / (h[:-1] + ridge)
    right = (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
    gain = left + right - g[-1] ** 2 / (h[-1] + ridge)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree of this depth over one feature's bins."""
    if depth == 0 or len(grad) < 2 or (best := _split(grad, hess, ridge))[0] <= 1e-9:
        return np.full(len(grad), -grad.sum() / (hess.sum() + ridge))
    at = best[1]
    return np.concatenate((_tree(grad[:at], hess[:at], depth - 1, ridge), _tree(grad[at:], hess[at:], depth - 1, ridge)))


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut of one feature followed by a cut of the other on either side."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros_like(grad))
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        for cut_at in range(1, len(g)):
            gain, values = 0.0, np.empty_like(g)
            for rows in (slice(0, cut_at), slice(cut_at, None)):
                gr, he = g[rows].sum(0), h[rows].sum(0)
                own = _split(gr, he, ridge)
                gain += own[0] + gr.sum() ** 2 / (he.sum() + ridge)
                values[rows] = _tree(gr, he, 1, ridge)
            if gain > best[0]:
                best = (gain, values.T.copy() if flip else values)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 32, pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> Gam:
    """Cyclic boosting under logistic loss: in each round each feature in turn gets one shallow tree, added to its table;
    then the pairs that explain most of what is left are boosted in the same way. With one class only, a constant."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    rate_of = (y.sum() + 1) / (len(y) + 2)
    model = Gam(cuts, coarse, [np.zeros(len(c) + 1) for c in cuts], intercept=float(np.log(rate_of / (1 - rate_of))))
    if len(y) == 0 or y.min() == y.max():
        return model
    binned = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, b in enumerate(binned):
            grad, hess = slopes()
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(b, grad, size), np.bincount(b, hess, size), 2, ridge)
            model.tables[f] += step
            margin += step[b]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def cells(f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        at = rough[f] * shape[1] + rough[g]
        grad, hess = slopes()
        return at, np.bincount(at, grad, shape[0] * shape[1]).reshape(shape), np.bincount(at, hess, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_pair_tree(*cells(f, g)[1:], ridge)[0], f, g) for f in range(x.shape[1]) for g in range(f)), reverse=True)
    model.pairs = [(f, g) for _, f, g in ranked[:pairs]]
    model.pair_tables = [np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1)) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for k, (f, g) in enumerate(model.pairs):
            at, grad, hess = cells(f, g)
            step = rate * _pair_tree(grad, hess, ridge)[1]
            model.pair_tables[k] += step
            margin += step.ravel()[at]
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> Gam:
    """Fit on the labelled documents that are not held out, `bound` of them at most (those with the smallest hashes of doc_id)."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `bound` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("quality").to_pylist(), float)
    order = np.lexsort((*x.T, y, np.array(got.column("doc_id").to_pylist(), dtype=float) if len(y) else y))
    return fit(x[order], (y[order] > 0).astype(float))


def score_quality(docs: DataFrame, model: Gam) -> DataFrame:
    """One row a row of docs: doc_id, held_out, score, predicted.

    A score is worked out from the whole text alone; null and empty texts get the score of all-zero statistics. Null doc_id is not held
    out; repeated rows get a row each; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(batch.column("text"))))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam) -> DataFrame:
    """The rows of docs, with all their columns, that the model scores 0.5 or more. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(model.score(features(batch.column("text"))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
