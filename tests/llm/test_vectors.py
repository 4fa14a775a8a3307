"""Centroid clustering and top-k search against plain loops, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from spanforge.llm import centroids, pivots

KIND = "vec_id long, embedding array<float>, cluster int, rank int, score string, distance long"


def floors(vector, scale):
    return [math.floor(float(x) * scale) for x in vector]


def whole(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def told(spark, rows, parts=3):
    """The rows as a table whose other columns have the names of the results."""
    rows = [(i, v, 9, 9, "x", 9) for i, v in rows]
    return spark.createDataFrame(rows, KIND).repartition(parts)


def plain_means(rows, k, rounds, dim, scale=256):
    kept = [(i, v) for i, v in rows if whole(v) and len(v) == dim]
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    x = [floors(v, scale) for _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (digest(kept[r][0]), kept[r][1]))
    c = [list(x[r]) for r in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, o, strict=True)), j) for j, o in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for v in x]
        for j in range(len(c)):
            mine = [v for v, o in zip(x, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [nearest(v) for v in x]
    inertia = [sum(d for d, o in last if o == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, o)).encode()).hexdigest() for o in c]
    return sorted(((i, o, d, inertia[o], sum(inertia), sha[o]) for (i, _), (d, o) in zip(kept, last, strict=True)), key=repr)


def vectors(rng, n, dim, near=5):
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(near)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in centres[i % near]]) for i in range(n)]
    rows += [(n, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (n + 1, None), (n + 2, []), (n + 3, [1.0] * (dim - 1)), (n + 4, [math.nan] * dim), (n + 5, [math.inf] * dim), (n + 6, [None] * dim), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize(("k", "rounds"), [(7, 3), (1, 1), (500, 2)])
def test_sort_means_as_plain_loops(spark, k, rounds):
    rows = vectors(random.Random(k), 120, 6)
    got = centroids.sort_means(told(spark, rows), k, rounds, 6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_means(rows, k, rounds, 6)


def test_sort_means_without_usable_vectors(spark):
    assert centroids.sort_means(told(spark, [(1, None), (2, [1.0])]), 3, 2, 2).collect() == []
    assert centroids.sort_means(told(spark, []), 3, 2, 2).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.sort_means(told(spark, [(1, [1e30, 0.0])]), 1, 1, 2).collect()


def test_scan_stops_early_and_keeps_ties():
    rng = np.random.default_rng(5)
    c = rng.integers(-200, 200, (50, 8))
    c[30] = c[10]
    x = c[rng.integers(0, 50, 4000)] + rng.integers(-4, 5, (4000, 8))
    scan = centroids.Scan(c)
    was = np.array([int(((c - v) ** 2).sum(1).argmin()) for v in x], np.int32)
    cluster, distance = scan.assign(x, was)
    assert (cluster == was).all() and (distance == ((x - c[was]) ** 2).sum(1)).all() and 30 not in cluster
    assert scan.evaluated < 4000 * 50 / 5
    assert (scan.assign(x, np.zeros(4000, np.int32))[0] == was).all()
    huge = centroids.Scan(c * 100_000)
    assert (huge.assign(x * 100_000, was)[0] == was).all()


def plain_top(rows, k, divisor):
    kept = [(i, floors(v, 1024)) for i, v in rows if whole(v)]
    out = []
    for q, (i, v) in enumerate(kept):
        if i is None or i % divisor:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0) for c, (j, w) in enumerate(kept) if c != q]
        out += [(i, n, None if null else j, -s) for n, (s, null, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "divisor", "least"), [(10, 10, 16 << 20), (3, 7, 1), (1000, 20, 16 << 20)])
def test_top_k_as_plain_loops(spark, monkeypatch, k, divisor, least):
    monkeypatch.setattr(pivots, "ROUND_BYTES", least)  # at 1, a round a piece of the queries
    rows = vectors(random.Random(k), 150, 6)
    got = pivots.top_k(told(spark, rows), k, divisor)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows, k, divisor)


def test_top_k_without_queries_or_rows(spark):
    assert pivots.top_k(told(spark, [])).collect() == []
    assert pivots.top_k(told(spark, [(1, [1.0]), (2, [2.0])]), divisor=100).collect() == []
    assert pivots.top_k(told(spark, [(100, [1.0])]), divisor=100).collect() == []


def test_pivots_spare_most_of_a_clustered_table():
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-20, 21, (4000, 16))
    x = np.rint(x * (4000 / np.sqrt((x * x).sum(1)))[:, None]).astype(np.int64)
    norms, chosen = pivots._norms(x), pivots._choose((x[:1000] / 1024.0).tolist(), 1024, 32)
    block = pivots.Block(0, np.arange(4000), np.zeros(4000, bool), x, norms, pivots._apart(x, norms, chosen))
    some = pivots.Queries(10, np.zeros(50, np.int64), np.arange(50), np.arange(50), x[:50], norms[:50], block.apart[:50])
    some.search(block)
    for q in range(50):
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[q]) if j != q)[:10]
        assert [(-int(s), int(j)) for s, _, j in some.best[q].T] == want
    assert some.evaluated < 50 * 4000 / 5
