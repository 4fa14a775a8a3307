"""Mining over the whole embeddings against brute force."""

import collections
import math

import numpy as np
import pytest

from spanforge.operators import graph as G
from spanforge.plans import registry, views


def brute(ids, labels, vecs):
    d = ((vecs[:, None, :] - vecs[None, :, :]) ** 2).sum(2)
    hard, semi, every = {}, {}, {}
    for i, a in enumerate(ids):
        pos = [(round(d[i, j], 9), -ids[j], d[i, j]) for j in range(len(ids)) if ids[j] != a and labels[j] == labels[i]]
        neg = sorted((round(d[i, j], 9), ids[j], d[i, j]) for j in range(len(ids)) if labels[j] != labels[i])
        if not pos or not neg:
            continue
        _, p, far = max(pos)
        if far - neg[0][2] + 0.1 > 0:
            hard[a] = (-p, neg[0][1], round(far, 6), round(neg[0][2], 6))
        if beyond := [x for x in neg if far + 1e-11 < x[2] < far + 0.5]:
            semi[a] = (-p, beyond[0][1], round(far, 6), round(beyond[0][2], 6))
        closer = [x[2] - y[2] for x in pos for y in neg if x[2] - y[2] + 0.1 > 0]
        if closer:
            every[a] = (len(closer), sum(closer))
    return hard, semi, every


def six(df):
    return {r["a"]: (r["p"], r["n"], round(r["d_ap"], 6), round(r["d_an"], 6)) for r in df.collect()}


def test_mining_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(90, 6)) * 0.3
    vecs[40:60] = vecs[7]  # ties
    labels = rng.integers(0, 4, 90)
    labels[0] = 9  # without a positive
    rows = [(i * 3, int(labels[i]), vecs[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows + [(None, 1, [0.0] * 6), (1000, None, [0.0] * 6), (1001, 1, None)], "row_idx long, label int, vec array<double>")
    hard, semi, every = brute([r[0] for r in rows], labels.tolist(), vecs)
    dist = G.pairwise_squared(df.filter("row_idx < 1000"))
    assert six(G.triplets_hard(dist, 0.1)) == hard and six(G.triplets_semi_hard(dist, 0.5)) == semi
    listed = collections.Counter(r["a"] for r in G.triplets_all(dist, 0.1).select("a").collect())
    assert dict(listed) == {a: n for a, (n, _) in every.items()}
    for size, kept in ((2048, 32_000_000), (16, 800)):
        monkeypatch.setattr(G, "BLOCK_ROWS", size)
        monkeypatch.setattr(G, "KEPT", kept)
        assert six(G.mine_hard(df, 0.1)) == hard and semi
        assert six(G.mine_semi_hard(df, 0.5)) == semi
        got = {r["a"]: (r["n"], r["total"]) for r in G.mine_all(df, 0.1).collect()}
        assert got.keys() == every.keys()
        assert all(got[a][0] == n and math.isclose(got[a][1], t, abs_tol=1e-6) for a, (n, t) in every.items())
        assert G.mine_hard(df.filter("false"), 0.1).count() == 0


@pytest.mark.parametrize("name", ["triplets_hard", "triplets_semi_hard", "triplets_all", "triplet_loss", "pairwise_sq_l2", "merge_recall"])
def test_whole_embeddings(spark, sf, name):
    got = [r.asDict() for r in registry.QUERIES[name](spark, sf).collect()]
    rows = views.vecs(spark, sf).orderBy("row_idx").collect()
    ids, labels, vecs = [r["row_idx"] for r in rows], [r["label"] for r in rows], np.array([r["vec"] for r in rows])
    d = ((vecs[:, None, :] - vecs[None, :, :]) ** 2).sum(2)
    assert max(ids) >= 200
    if name == "pairwise_sq_l2":
        at = {a: k for k, a in enumerate(ids)}
        assert len({(r["i"], r["j"]) for r in got}) == len(got) == len(ids) * (len(ids) - 1)
        assert all(abs(r["d"] - d[at[r["i"]], at[r["j"]]]) < 2e-6 and r["same"] == (labels[at[r["i"]]] == labels[at[r["j"]]]) for r in got)
        return
    if name == "merge_recall":
        place, want = {a: k for k, a in enumerate(ids)}, {}
        for pair in {a // 2 for a in ids if {a // 2 * 2, a // 2 * 2 + 1} <= place.keys()}:
            both = [place[pair * 2], place[pair * 2 + 1]]
            single = {j for k in both for j in sorted(range(len(ids)), key=lambda j: (round(math.sqrt(d[k, j]), 9), ids[j]))[:5]}
            far = np.sqrt(((vecs - vecs[both].mean(0)) ** 2).sum(1))
            merged = set(sorted(range(len(ids)), key=lambda j: (round(far[j], 9), ids[j]))[:10])
            want[pair] = round(len(single & merged) / len(single), 6)
        assert {r["pair"]: r["recall"] for r in got} == want
        return
    hard, semi, every = brute(ids, labels, vecs)
    near = lambda a, b: a.keys() == b.keys() and all(a[k][:2] == b[k][:2] and np.allclose(a[k][2:], b[k][2:], atol=2e-6) for k in a)
    found = collections.defaultdict(tuple, {r.get("a"): tuple(v for k, v in r.items() if k != "a") for r in got})
    if name == "triplet_loss":
        assert math.isclose(got[0]["loss"], np.mean([max(math.sqrt(x[2]) - math.sqrt(x[3]) + 0.5, 0) for x in hard.values()]), abs_tol=2e-6)
    elif name == "triplets_all":
        assert {a: x[0] for a, x in found.items()} == {a: x[0] for a, x in every.items()}
        assert all(abs(found[a][1] - t) < 2e-4 for a, (_, t) in every.items())
    else:
        assert near(dict(found), hard if name == "triplets_hard" else semi)


def test_copies_of_the_table_are_bounded_by_cores(spark, monkeypatch):
    rows = [(i, i % 3, [float(i % 11), 0.1 * (i % 5)]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_idx long, label int, vec array<double>")
    monkeypatch.setattr(G, "BLOCK_ROWS", 5)
    want = sorted(map(tuple, G.triplets_semi_hard(G.pairwise_squared(df), 0.5).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert sorted(map(tuple, G.mine_semi_hard(df, 0.5).collect())) == want and want
        folded = G._folded(G._nodes(df), G._Far, 0.5)
        assert folded.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert "array<float>" not in folded._jdf.queryExecution().analyzed().toString()  # 0.1 is no float
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_all_triplets_by_label_a_few_anchors_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    v, label, ids = rng.normal(size=(90, 3)).astype(np.float32), rng.integers(0, 4, 90), np.arange(90)
    ids[70:75], label[:3] = ids[:5], [7, 8, 8]  # ids of several rows, labels of one row and two

    def block(at, kind):
        rows = [{"row_idx": int(ids[i]), "label": int(label[i]), "vec": v[i].tolist(), "bound": 0.0} for i in at]
        return pa.array([rows], pa.list_(pa.struct([("row_idx", pa.int64()), ("label", pa.int32()), ("vec", pa.list_(kind)), ("bound", pa.float64())])))[0]

    d = ((v[:, None].astype(float) - v[None]) ** 2).sum(2)
    for kept, kind in ((1, pa.float32()), (400, pa.float64())):
        monkeypatch.setattr(G, "KEPT", kept)
        state = G._All(G._Rows(block(range(40), kind)), 0.1)
        for lo in range(0, 90, 20):
            state.add(G._Rows(block(range(lo, min(lo + 20, 90)), kind)))
        got = {int(a): (int(n), round(float(t), 6)) for a, n, t in zip(*state.done(), strict=True)}
        want = {}
        for a in range(40):
            x = [d[a, p] - d[a, n] for p in range(90) for n in range(90) if ids[p] != ids[a] != ids[n] and label[p] == label[a] != label[n] and d[a, p] - d[a, n] + 0.1 > 0]
            if x:
                want[a] = (len(x), round(sum(x), 6))
        assert got == want
