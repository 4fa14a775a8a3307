"""The error by tile size: rows and sequences are read once, and a place is embedded once."""

import math

import pytest
from pyspark.sql import functions as F

from spanforge.operators import embed as E
from spanforge.operators.embedding_stats import tiling_error
from spanforge.plans import registry


def tiles(start, end, size):
    if end <= start:
        return []
    at = round(round((start + end) / 2 / size) * size - size / 2)
    if (min(end, at + size) - max(start, at)) * 2 < size:
        return []
    return [at, *tiles(start, at, size), *tiles(at + size, end, size)]


def plain(rows, vector):
    """(size, error, error95, sets) by loops."""
    mean = lambda vs: [sum(x) / len(vs) for x in zip(*vs, strict=True)]
    m = round(sum(e - s for *_, s, e in rows) / len(rows))
    out = []
    for size in range(m // 10, round(m * 1.2), m // 10):
        apart = []
        for k in {r[0] for r in rows}:
            of = []
            for _, _, c, s, e in (r for r in rows if r[0] == k):
                found = tiles(s, e, size)
                share = [min(t + size, e) - max(t, s) for t in found]
                of += [[x * b / sum(share) for x in vector(c, t, t + size)] for t, b in zip(found, share, strict=True)]
            if of:
                apart.append(math.dist(mean(of), mean([vector(*r[2:]) for r in rows if r[0] == k])))
        if apart:
            centre = sum(apart) / len(apart)
            out.append((size, centre, 1.96 * math.sqrt(sum((x - centre) ** 2 for x in apart) / len(apart)) / math.sqrt(len(apart)), len(apart)))
    return out


#: Copies, overlaps, places that sets share, tiles that pass both ends of a sequence of 300 letters, and a set too short for most sizes.
ROWS = [(k, 10 * k + i, "ab"[i % 2], (i * 37 + k) % 200, (i * 37 + k) % 200 + 40 + i * 9) for k in range(3) for i in range(8)]
ROWS += [(0, 90, "a", 0, 100), (1, 91, "a", 0, 100), (1, 92, "a", 0, 100), (2, 93, "b", 200, 300), (3, 94, "b", 5, 9)]
LETTERS = {c: "".join("ACGTN"[(i * i + i // 7 + k) % 5] for i in range(300)) for k, c in enumerate("ab")}


def test_a_place_is_embedded_once(spark):
    rows = spark.createDataFrame(ROWS, "set_id long, row_idx long, chrom string, start long, end long")
    sequences, seen = spark.createDataFrame(list(LETTERS.items()), "chrom string, seq string"), []

    def embed(places):
        seen.append(places)
        return E.embed(places.withColumn("start", F.greatest("start", F.lit(0))), sequences, E.CountAcgt(), longest=300, keys=("uses",), anywhere=True)

    got = sorted(map(tuple, tiling_error(rows, embed).collect()))
    want = plain(ROWS, lambda c, s, e: [LETTERS[c][max(s, 0) : max(e, 0)].count(x) for x in "ACGT"])
    assert [(r[0], r[3]) for r in got] == [(r[0], r[3]) for r in want] and len({r[3] for r in got}) > 1
    assert [x for r in got for x in r[1:3]] == pytest.approx([x for r in want for x in r[1:3]])
    assert len(seen) == 1  # intervals and tiles go together
    places = [(r["chrom"], r["start"], r["end"]) for r in seen[0].collect()]
    assert len(places) == len(set(places)) > 100


def test_documents_are_not_read_again_for_every_step(spark, sf):
    plan = registry.QUERIES["tiling_error"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1  # the letters; intervals are worked out before


def test_an_uncut_string_meets_the_model_once(spark):
    df = spark.createDataFrame([(0, "AACGN"), (1, ""), (2, None)], "row_idx long, letters string")
    found = df.select("row_idx", E.of_letters(F.col("letters"), E.CountAcgt()).alias("vec"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 4
    assert [r["vec"] for r in found.orderBy("row_idx").collect()] == [[2.0, 1.0, 1.0, 0.0], [0.0] * 4, None]
    lasts = df.select(E.of_letters(F.col("letters"), E.CountAcgt(), lambda parts: F.try_element_at(parts, F.lit(-1))).alias("vec"))
    assert sorted(map(str, lasts.collect())) == sorted(map(str, found.select("vec").collect()))
