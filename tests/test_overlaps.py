"""Overlaps by cells: pairs, counts by rank and bins against the plain join."""

import random

import pyarrow as pa

from spanforge.operators import aggregates as A
from spanforge.operators import joins as J
from spanforge.operators import overlaps as O

IV = "row_idx long, set_id string, chrom string, start long, end long"


def sides(spark):
    rng = random.Random(11)
    lengths = [0, 1, 40, 3000, 70_000, 5_000_000, -3]

    def some(n, names):
        rows = [(i, rng.choice(names), f"chr{rng.randrange(3)}", s := rng.randrange(-80_000, 200_000), s + rng.choice(lengths)) for i in range(n)]
        return spark.createDataFrame([*rows, (n, None, "chr1", 5, 90), (n + 1, "a", None, 5, 90), *rows[:5]], IV)

    q, s = some(200, ["x"]), some(200, ["a", "b"])
    pairs = J.overlap_join_plain(q.filter("end > start"), s.filter("end > start"))
    return q, s, pairs


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pairs_and_counts_at_any_level(spark):
    q, s, pairs = sides(spark)
    assert plain(J.overlap_join(q, s)) == plain(pairs)
    assert plain(J.overlap_join(q, s, columns=["q_row_idx", "s_row_idx"])) == plain(pairs.select("q_row_idx", "s_row_idx"))
    assert plain(J.overlap_count_by_set(q, s)) == plain(pairs.groupBy("q_row_idx", "s_set_id").count())
    assert plain(J.overlap_count(q, s)) == plain(pairs.groupBy("q_row_idx").count())


def test_bins_without_pairs(spark):
    q, s, pairs = sides(spark)
    want = plain(A.recall_by_overlap(pairs, (pairs.q_row_idx + pairs.s_row_idx) % 3 != 0))
    O.PAIRS, kept = 100, O.PAIRS
    try:
        assert plain(A.recall_of_overlaps(q, s, lambda a, b: (a + b) % 3 != 0)) == want
    finally:
        O.PAIRS = kept


def test_cells_of_one_hash_are_told_apart():
    def batch(side):
        at = {"__chrom": ["a", "b"], "__kind": [0, 0], "__level": [0, 0], "__bin": [0, 0], "__key": [2 + side] * 2, "__start": [1, 2], "__end": [9, 9]}
        return pa.RecordBatch.from_pydict(at | {"q": [{"i": 1}, {"i": 2}], "s": [{"i": 1}, {"i": 2}]})

    found = list(O.read_cells([batch(0), batch(1)]))
    assert sorted((c.chrom.as_py(), len(c.covers[0]), len(c.starts[0])) for c in found) == [("a", 1, 1), ("b", 1, 1)]


def test_no_pairs_are_shuffled(spark, sf):
    """What follows the pairs of distinct_hits is no grouping of them."""
    from spanforge.plans.registry import QUERIES

    plan = QUERIES["distinct_hits"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0]


def test_cct_counts_pairs_where_they_are_made(spark):
    """Also with ids of several rows, empty and reversed intervals; what is grouped after the join is a row a task, not a row a pair."""
    from spanforge.operators import embedding_stats as S

    rng = random.Random(5)
    rows = [(i, f"chr{rng.randrange(2)}", s := rng.randrange(-3000, 9000), s + rng.choice([0, 1, 5, 700, 6000, -50])) for i in [*range(80), *range(5), 3]]
    at = lambda s, e, k: (s * 16 + (e - s) * (2 * k + 1)) // 16
    want = {(i, j) for i, c, s, e in rows for j, d, lo, hi in rows if i < j and c == d and any(lo <= at(s, e, k) <= hi for k in range(8))}
    found = S.cct_intersection(spark.createDataFrame(rows, "row_idx long, chrom string, start long, end long"))
    assert found.first()["pairs"] == len(want)
    assert "Aggregate [i#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_true_pairs_of_a_search_are_not_made(spark, sf):
    from spanforge.operators import search as X
    from spanforge.plans.registry import QUERIES

    q, s, pairs = sides(spark)
    hits = pairs.filter("(q_row_idx + s_row_idx) % 3 = 0").select("q_row_idx", "s_row_idx")
    got = X.compare(X.true_pairs(q, s), X.found_pairs(q, s, hits)).first()
    assert (got["truth"], got["found"]) == (pairs.count(), hits.count())
    assert "LeftOuter" not in QUERIES["search_benchmark"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_that_covers_a_bin_and_starts_in_it_is_one_copy(spark):
    rows = [(i, "a", f"chr{i % 3}", i * 100, i * 100 + 50) for i in range(600)]
    q, s = (spark.createDataFrame([r for r in rows if r[0] % 2 == k], IV) for k in (0, 1))
    assert O.cells(q, s, ["row_idx"], ["row_idx"], J.BIN, 64).count() == 600  # none of them is over the border of a bin


def test_distinct_pairs_are_made_so_in_their_cells(spark, sf):
    from spanforge.plans.registry import QUERIES

    q, s, pairs = sides(spark)
    q, s = (x.unionByName(x.limit(60)) for x in (q, s))
    want = pairs.select("q_chrom", "q_start", "q_end", "s_start", "s_end").distinct()
    assert plain(J.distinct_overlaps(q, s)) == plain(want)
    plan = QUERIES["distinct_hits"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [chrom" not in plan and plan.count("Aggregate") == 2  # the levels of either side
