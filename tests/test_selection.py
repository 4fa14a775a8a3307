"""Order statistics, inversions and sampled pairs against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import ranking as R
from spanforge.operators import selection as L


@pytest.mark.parametrize("small", [0, 200_000])
def test_percentiles_as_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(L, "SMALL", small)
    rows = spark.range(400_000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.when(F.col("id") % 5 > 1, F.lit(7.0)).otherwise((F.col("id") * 7919 % 100_003).cast("double")).alias("x"))
    plain = {k: np.array([r["x"] for r in rows.filter(F.col("k") == k).select("x").collect()]) for k in (0, 1)}
    for share in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = {r["k"]: (r["n"], r["percentile"]) for r in L.percentile(rows, ["k"], "x", share).collect()}
        assert got == {k: (len(v), pytest.approx(np.percentile(v, share * 100))) for k, v in plain.items()}
    whole = L.percentile(rows, [], "x", 0.37).first()
    assert whole["percentile"] == pytest.approx(np.percentile(np.concatenate(list(plain.values())), 37)) and whole["n"] == 400_000


def test_ten_million_values_a_label(spark):
    rows = spark.range(10_000_000).select(F.lit("a").alias("label"), (F.col("id") * 48271 % 9_999_991).alias("x"))
    got = L.at_places(rows, ["label"], "x", {"p10": (0.1, lambda n: F.rint(n * 0.1)), "last": (1.0, lambda n: n - 1), "beyond": (1.0, lambda n: n)}).first()
    # the first 9,999,991 are 0 … 9,999,990 once each; the other nine repeat the first nine of them
    again = sorted(i * 48271 % 9_999_991 for i in range(9))
    assert got["p10"] == 1_000_000 - sum(a < 999_995 for a in again) and got["last"] == 9_999_990 and got["beyond"] is None


def test_places_of_small_groups_and_nulls(spark):
    rows = spark.createDataFrame([("a", 3), ("a", None), ("b", None), ("c", 1), ("c", 1), ("c", 9)], "k string, x int")
    got = {r["k"]: tuple(r)[1:] for r in L.at_places(rows, ["k"], "x", {"low": (0.0, lambda n: F.lit(0)), "second": (0.5, lambda n: F.lit(1))}).collect()}
    assert got == {"a": (1, 3, None), "c": (3, 1, 1)}
    assert L.percentile(rows.filter("false"), ["k"], "x", 0.5).collect() == []


def test_inversions_as_plain_counting():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        orders = [rng.sample(range(n), n) for _ in range(5)]
        want = [sum(o[i] > o[j] for i in range(n) for j in range(i + 1, n)) for o in orders]
        assert R.inversions(np.array(orders, np.int64).reshape(5, n)).tolist() == want


def test_tau_on_common_items(spark):
    rng = random.Random(2)
    rankings = {f"r{i}": rng.sample(range(30), rng.randrange(0, 30)) for i in range(40)}
    rows = [(n, i, p) for n, items in rankings.items() for p, i in enumerate(items)]
    got = {(r["a"], r["b"]): r["tau"] for r in R.kendall_tau(spark.createDataFrame(rows, "name string, item int, place int")).collect()}
    want = {}
    for a, x in rankings.items():
        for b, y in rankings.items():
            both = [i for i in x if i in y]
            pairs = [math.copysign(1, y.index(j) - y.index(i)) for k, i in enumerate(both) for j in both[k + 1 :]]
            if pairs:
                want[a, b] = sum(pairs) / len(pairs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
