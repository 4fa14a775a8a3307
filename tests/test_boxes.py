"""Neighbours by boxes against all scores: ties, several runs and pieces, rows without numbers."""

import math
import random

import pyarrow as pa

from spanforge.operators import boxes as B

IV = "id long, base_idx long, vec array<double>, chrom string, start long, end long"


def sides():
    rng = random.Random(3)

    def some(n):
        rows = []
        for i in range(n):
            s, e = (s := rng.randrange(0, 900)), s + rng.choice([0, 5, 40, 300])
            rows.append((i, i // 2, [1.0, s / 1e3, e / 1e3, (e - s) / 1e2], rng.choice(["a", "b", None]), s, e))
        return [*rows, *((n + i, *r[1:]) for i, r in enumerate(rows[: n // 4])), (2 * n, 5, [1.0, math.nan, 0.0, 0.0], "a", 1, 9), (2 * n + 1, 6, [0.0] * 4, "a", 1, 9)]

    return [(r % 2, *x) for r, x in enumerate(some(150))], some(700)


def brute(queries, sample, ks):
    found = set()
    for run, _, qb, q, c, lo, hi in queries:
        scored = []
        for i, sb, s, d, a, b in sample:
            norm = math.sqrt(sum(x * x for x in s))
            if norm > 0 and not math.isnan(norm) and not any(map(math.isnan, q)):
                scored.append((-round(sum(x * y for x, y in zip(q, s, strict=True)) / norm, 9), i, sb, c == d is not None and min(b, hi) > max(a, lo)))
        found |= {(run, qb, sb) for _, _, sb, meets in sorted(scored)[: ks[run]] if meets}
    return found


def test_hits_are_those_of_all_scores(spark):
    q, s = sides()
    found = B.hits(spark.createDataFrame(q, f"run int, {IV}"), spark.createDataFrame(s, IV), [3, 60])
    assert sorted(map(tuple, found.collect())) == sorted(brute(q, s, [3, 60]))


def test_pieces_and_boxes_of_any_size(monkeypatch):
    q, s = sides()
    names = ["side", "run", "id", "base_idx", "vec", "chrom", "start", "end"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.string(), pa.int64(), pa.int64()]
    rows = [(0, *r) for r in q] + [(1, 0, *r) for r in s]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for box, piece, ks in ((4, 50, [3, 60]), (16, 300, [1, 200]), (256, 10**6, [5, 2000])):
        monkeypatch.setattr(B, "BOX", box)
        monkeypatch.setattr(B, "PIECE", piece)
        found = {tuple(r.values()) for out in B._cell(ks)(batch.slice(k, 70) for k in range(0, len(rows), 70)) for r in out.to_pylist()}
        assert found == brute(q, s, ks)


def test_few_rows_are_looked_at():
    rng = random.Random(1)
    rows = [[1.0, s := rng.random(), s + 0.1 + rng.random() / 50, 1 + rng.random() / 5] for _ in range(20_000)]
    table = pa.table({c: range(20_000) for c in ("id", "base_idx", "start", "end", "run")} | {"vec": rows, "chrom": ["a"] * 20_000})
    sample = B._Boxes(B._Rows(table.to_batches()))
    queries = B._Rows(table.to_batches()).vec[:64]
    looked = [len(sample.candidates(queries[at], 100, B.np.full(len(at), -math.inf))) for at in B._near(queries, 4)]
    assert sum(looked) / len(looked) < 5_000
