"""Golden cases and constraints of the interval transforms."""

import math
import random

import pytest

from spanforge.operators import joins as J
from spanforge.operators import transforms as T

IV = "row_idx long, chrom string, start long, end long"


def run(spark, spans, *transforms):
    df = spark.createDataFrame([(i, c, s, e) for i, (c, s, e) in enumerate(spans)], IV)
    out = T.apply(df, *transforms, numbered=True).orderBy("new_idx").collect()
    return [(r["chrom"], r["start"], r["end"]) for r in out]


def test_chunk_max(spark):
    assert run(spark, [("", 0, 2), ("", 5, 17), ("", 9, 9)], T.chunk_max(5)) == [("", 0, 2), ("", 5, 10), ("", 10, 15), ("", 15, 17)]
    assert run(spark, [("", 9, 9)], T.chunk_keep(5)) == [("", 9, 9)]


def test_slide(spark):
    assert [x[1:] for x in run(spark, [("chrX", 0, 10)], T.slide(4))] == [(0, 10), (3, 13), (7, 17), (10, 20)]
    assert [x[1:] for x in run(spark, [("c", -3, 7)], T.slide(3))] == [(-3, 7), (-8, 2), (-13, -3)]


def test_translate_swell_split(spark):
    assert run(spark, [("chr1", 100, 200)], T.translate(50)) == [("chr1", 150, 250)]
    assert run(spark, [("chr2", 200, 300)], T.translate(-50)) == [("chr2", 150, 250)]
    for factor, span, want in ((0.5, (100, 200), (125, 175)), (2.0, (100, 200), (50, 250)), (1.0, (100, 201), (100, 201))):
        assert run(spark, [("c", *span)], T.swell(factor)) == [("c", *want)]
    assert [x[1:] for x in run(spark, [("c", 100, 103), ("c", 100, 107), ("c", 100, 101)], T.split(3))] == [(100, 101), (101, 102), (102, 103), (100, 103), (103, 105), (105, 107), (100, 101)]
    with pytest.raises(ValueError):
        T.split(0)


def test_lineage_and_backward_sum(spark):
    df = spark.createDataFrame([(i, "c", i, i + 1) for i in range(3)], IV)
    new = T.apply(df, T.repeat(3), numbered=True)
    assert [r["new_idx"] for r in new.filter("base_idx = 1").orderBy("new_idx").collect()] == [3, 4, 5]
    values = {0: 0, 1: 1, 2: 10}
    from pyspark.sql import functions as F

    held = new.withColumn("v", F.when(F.col("base_idx") == 0, 0).when(F.col("base_idx") == 1, 1).otherwise(10))
    assert {r["row_idx"]: r["total"] for r in T.backward_sum(df, held, "v").collect()} == {k: 3 * v for k, v in values.items()}


def reference_tiles(s, e, base, octaves, offsets):
    """One span at a time, as the definition reads."""
    if e <= s:
        return []
    size = base if e - s < base else base * 2 ** min(int(math.log2((e - s) / base)), octaves - 1)
    grid = size / offsets
    at = round(round((s + (e - s) / 2) / grid) * grid - size / 2)
    if 2 * (min(e, at + size) - max(s, at)) < size:
        return []
    return [(at, at + size), *reference_tiles(s, at, base, octaves, offsets), *reference_tiles(at + size, e, base, octaves, offsets)]


def test_tiles(spark):
    rng = random.Random(4)
    spans = [(s := rng.randrange(0, 1000), s + rng.randrange(1, 3000)) for _ in range(120)]
    df = spark.createDataFrame([(i, "chr1", s, e) for i, (s, e) in enumerate(spans)], IV)
    got = {}
    for r in T.tile(df, 16, 4, 3).collect():
        got.setdefault(r["row_idx"], []).append((r["start"], r["end"]))
    for i, (s, e) in enumerate(spans):
        assert sorted(got.get(i, [])) == sorted(reference_tiles(s, e, 16, 4, 3))
        for a, b in got.get(i, []):
            assert (b - a) in (16, 32, 64, 128) and 2 * (min(b, e) - max(a, s)) >= b - a


def test_overlap_join_is_the_plain_join(spark):
    rng = random.Random(7)

    def some(n):
        return [(i, f"chr{rng.randrange(3)}", s := rng.randrange(-5000, 20000), s + rng.choice([0, 1, 50, 3000, 400_000])) for i in range(n)]

    q, s = spark.createDataFrame(some(150), IV), spark.createDataFrame(some(150), IV)
    want = sorted((r["q_row_idx"], r["s_row_idx"]) for r in J.overlap_join_plain(q.filter("end > start"), s.filter("end > start")).collect())
    for width, most in ((2000, 64), (500, 4), (100_000, 1)):
        assert sorted((r["q_row_idx"], r["s_row_idx"]) for r in J.overlap_join(q, s, width, most).collect()) == want


def test_backward_takes_any_aggregate(spark):
    import pytest
    from pyspark.sql import functions as F

    base = spark.createDataFrame([(i, "c", i * 10, i * 10 + 9) for i in range(3)] + [(3, "c", 50, 50)], "row_idx long, chrom string, start long, end long")
    new = T.apply(base, T.split(3), T.chunk_max(9), numbered=True)
    values = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 0, 1, 1, 1, 10, 10, 10])], "new_idx long, value long")


    assert {r["row_idx"]: r["value"] for r in T.backward(base, new, values, F.sum).collect()} == {0: 0, 1: 3, 2: 30, 3: None}
    with pytest.raises(Exception, match="do not match at 9"):
        T.backward(base, new, values.unionByName(values.selectExpr("new_idx + 1 AS new_idx", "value").filter("new_idx = 9")), F.sum).collect()
    with pytest.raises(Exception, match="do not match at 8"):
        T.backward(base, new, values.filter("new_idx < 8"), F.sum).collect()


def test_neighbours_with_many_ties(spark):
    from spanforge.operators.knn import knn

    points = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(50, [2.0, 0.0])], "id long, vec array<double>")
    for metric, want in (("ip", [50, 0, 1]), ("l2", [0, 1, 2])):
        got = knn(points.filter("id = 7"), points, 3, metric).orderBy("rank").collect()
        assert [r["found"] for r in got] == want
    assert [r["found"] for r in knn(points.filter("id = 7"), points, 3, "l2", skip_self=True).orderBy("rank").collect()] == [0, 1, 2]


def test_projection(spark):
    import numpy as np

    from spanforge.operators.embedding_stats import project

    x = np.random.default_rng(3).normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    got = project(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, vec array<double>")).orderBy("row_idx").collect()
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs([r["point"] for r in got]), np.abs(u[:, :2] * s[:2]))
