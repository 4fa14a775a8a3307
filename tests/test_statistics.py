"""Statistics of embeddings against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import embedding_stats as S
from spanforge.operators import graph as G
from spanforge.operators import knn as K
from spanforge.operators import ranking as R


def table(spark, x, kind="row_idx long, vec array<double>", *more):
    return spark.createDataFrame([(i, v.tolist(), *[m[i] for m in more]) for i, v in enumerate(x)], kind).repartition(3)


def draw(*parts):
    return int(hashlib.md5("_".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def test_regression_as_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = np.round(x @ rng.normal(size=(5, 4)) + rng.normal(size=(300, 4)))
    y[:, 3] = 2.0
    got = {r["fold"]: r for r in S.rct(table(spark, x, "row_idx long, vec array<double>, target array<double>", y.tolist()), 5, 0.5).collect()}
    fold = np.array([draw(i, 42) % 5 for i in range(300)])
    one = np.concatenate((np.ones((300, 1)), x), axis=1)
    for f in range(5):
        a, b = one[fold != f], y[fold != f]
        beta = np.linalg.solve(a.T @ a + 0.5 * np.diag([0, 1, 1, 1, 1, 1]), a.T @ b)
        error = ((y[fold == f] - one[fold == f] @ beta) ** 2).sum(0)
        spread = ((y[fold == f] - y[fold == f].mean(0)) ** 2).sum(0)
        want = np.append(1 - error[:3] / spread[:3], 1.0)  # the last one never changes, and is told exactly
        assert got[f]["rows"] == (fold == f).sum() and got[f]["r2"] == pytest.approx(want.mean())


@pytest.mark.parametrize("size", [3, 4096])
def test_likeness_in_rounds(spark, monkeypatch, size):
    monkeypatch.setattr(S, "POOL", size)
    monkeypatch.setattr(S, "LARGEST_POOL", 2 * size)
    rng = np.random.default_rng(3)
    n = 25 if size == 3 else 60
    x = rng.normal(size=(n, 3))
    x[7] = 0
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    for least in (0.5, 0.95) if size == 3 else (-2.0, 0.5, 2.0):
        found = sum(any(unit[i] @ unit[j] > least for j in range(i + 1, n) if i != 7 and j != 7) for i in range(n))
        row = S.cct_similarity(table(spark, x), least).first()
        assert row["found"] == found and row["share"] == pytest.approx(found / (n * (n - 1) / 2))
    assert S.cct_similarity(table(spark, x[:1]), 0.1).first()["share"] is None


def test_pairs_are_drawn_and_taken_apart(spark):
    rows = [(i * 3, f"c{0 if i < 50 else 1 if i < 52 else 2}") for i in range(53)]
    df = spark.createDataFrame(rows, "row_idx long, chrom string").repartition(4)
    found = S.sampled_pairs(df, 3000).collect()
    chrom = dict(rows)
    assert len(found) == 3000 and all(r["a"] != r["b"] and chrom[r["a"]] == chrom[r["b"]] != "c2" for r in found)
    ids = {c: sorted(i for i, x in rows if x == c) for c in ("c0", "c1")}
    every = {c: [(v[i], v[j]) for j in range(len(v)) for i in range(j)] for c, v in ids.items()}
    for r in found:
        c = ("c0", "c1")[draw(r["pair"], 42) % 2]
        at = int(draw(r["pair"], 43) / 16.0**13 * len(every[c]))
        assert (r["a"], r["b"]) == every[c][at]
    assert S.sampled_pairs(df.filter("row_idx >= 156"), 10).count() == 0


@pytest.mark.parametrize(("held", "parts"), [(4, 4), (32_768, 9)])
def test_neighbours_on_a_grid(spark, monkeypatch, held, parts):
    monkeypatch.setattr(K, "HELD", held)
    monkeypatch.setattr(K, "ROWS", 5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = np.random.default_rng(4)
        x = rng.integers(-3, 4, (90, 4)).astype(float)
        df = table(spark, x).withColumnRenamed("row_idx", "id")
        df = df.unionByName(spark.createDataFrame([(None, [0.0] * 4), (999, None)], "id long, vec array<double>"))
        got = sorted(tuple(r) for r in K.knn(df.filter("id % 4 = 0"), df, 6, skip_self=True).select("query", "rank", "found", "score").collect())
        far = sorted(tuple(r) for r in K.knn(df.filter("id % 4 = 0"), df, 200, "l2").select("query", "rank", "found").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    near = {q: sorted((-float(x[q] @ x[j]), j) for j in range(90) if j != q)[:6] for q in range(0, 90, 4)}
    assert got == sorted((q, n, j, -s) for q, found in near.items() for n, (s, j) in enumerate(found, 1))
    apart = {q: sorted((round(float(np.linalg.norm(x[q] - x[j])), 9), j) for j in range(90)) for q in range(0, 90, 4)}
    assert far == sorted((q, n, j) for q, found in apart.items() for n, (_, j) in enumerate(found, 1))


def test_checkpoints_in_the_order_of_their_names(spark):
    rows = [("2025-12-07_10-00-00", 0.5, 0.6), ("2025-12-06_23-59-59", 0.9, 1.0), ("2025-12-07_10-00-01", 0.4, 0.5)]
    got = R.loss_curve(spark.createDataFrame(rows, "name string, train_loss double, eval_loss double")).collect()
    assert sorted(map(tuple, got)) == [(0, 0.9, 1.0), (100, 0.5, 0.6), (200, 0.4, 0.5)]


def test_batches_without_partners(spark):
    nodes = spark.createDataFrame([(0, 0, [0.0]), (0, 1, [1.0]), (1, 5, [0.0]), (2, 0, [0.0]), (2, 1, [1.0]), (2, 2, [1.5])], "batch long, node long, vec array<double>")
    edges = spark.createDataFrame([(2, 0, 0), (2, 0, 1), (2, 1, 0), (9, 1, 1)], "batch long, i long, j long")
    for strategy, want in (("hard", [(2, 1, 0, 2)]), ("all", [(2, 1, 0, 2)]), ("semi-hard", [])):
        found = G.mine_batches(nodes, edges, 0.3, strategy).collect()
        assert [tuple(r)[:4] for r in found] == want
    with pytest.raises(ValueError, match="unknown strategy"):
        G.mine_batches(nodes, edges, 0.3, "soft")
    assert G.mine_batches(nodes.filter("false"), edges.filter("false"), 1.0).count() == 0
    assert G.batch_edges(nodes.withColumn("set_id", F.col("node").cast("string")), spark.createDataFrame([("0", "1"), ("0", "1")], "set_id string, other string")).count() == 6 + 2
