"""Each query with SQL against DuckDB; the others by what must hold of them."""

import pytest

from spanforge.plans import registry

from .oracle import both


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, sf, name):
    got, want = both(spark, sf, registry.QUERIES[name], registry.ORACLE[name])
    assert got == want


def test_entry_without_llm(monkeypatch):
    import importlib
    import importlib.util
    import sys

    for name in [m for m in sys.modules if m.startswith("spanforge.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("corpus_pipeline", "spanforge.llm") else real(name, *a))
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) == set(registry.ORACLE)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_keys_of_one_side_are_an_error(spark):
    from spanforge.operators.joins import require_same_keys

    left, right = (spark.createDataFrame([(x,) for x in xs], "label int") for xs in ((1, 2), (1, 2, 3)))
    assert require_same_keys(left, left, "label").count() == 2
    with pytest.raises(Exception, match="only on one side: 3"):
        require_same_keys(left, right, "label").collect()


def test_shuffled_scan_does_not_depend_on_partitions(spark, sf):
    from spanforge.plans.scan_queries import _bed_lines
    from spanforge.sources import bed

    rows = bed.parse(_bed_lines(spark, sf))
    a, b = bed.shuffled(rows, 9), bed.shuffled(rows.repartition(7), 9)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.groupBy("set_id").count().filter("count > 9").isEmpty()


def test_permutation_p_value(spark, sf):
    row = registry.QUERIES["kendall_pvalue"](spark, sf).first()
    assert -1 <= row["tau"] <= 1 and 0 < row["p"] <= 1
    one = spark.createDataFrame([(1, 1)], "item long, rank int")
    from spanforge.operators.ranking import kendall_pvalue

    assert kendall_pvalue(one, one, 9).first()["p"] is None
    same = spark.createDataFrame([(i, i) for i in range(1, 9)], "item long, rank int")
    got = kendall_pvalue(same, same, 99).first()
    assert got["tau"] == 1 and got["p"] <= 0.05


def test_synthesis(spark):
    from spanforge.operators import synthesis as Y

    rows = Y.intervals(spark, 500, 10, 99).collect()
    sizes = {r["chrom"]: r["size"] for r in Y.chrom_sizes(spark).collect()}
    assert len(sizes) == 24
    assert all(10 <= r["end"] - r["start"] <= 99 and 0 <= r["start"] and r["end"] <= sizes[r["chrom"]] for r in rows)
    assert len({r["chrom"] for r in rows}) == 24
    blocks = Y.blocks(spark.createDataFrame([("chr1", 95, 205)], "chrom string, start long, end long"), 100).collect()
    assert sorted(b["block"] for b in blocks) == [0, 1, 2] and all(len(b["seq"]) == 100 and set(b["seq"]) <= set("ACGT") for b in blocks)
    whole = Y.assemble(Y.blocks(spark.createDataFrame([("chr1", 95, 205), ("chr1", 410, 420)], "chrom string, start long, end long"), 100), 100).first()["seq"]
    assert whole == "".join(b["seq"] for b in sorted(blocks, key=lambda b: b["block"])) + "N" * 100 + whole[400:] and len(whole) == 500 and set(whole[400:]) <= set("ACGT")


def test_cluster_sample(spark, sf):
    rows = registry.QUERIES["cluster_sample"](spark, sf).collect()
    assert {r["place"] for r in rows} == {0, 1, 2, 3} and len({r["cluster"] for r in rows}) == 12
    cells = {}
    for r in rows:
        cells.setdefault(r["cluster"], set()).add(r["set_id"].split("_")[0])
    assert all(len(c) == 1 for c in cells.values())
    assert len({(r["cluster"], r["place"], r["k"]) for r in rows}) == len(rows)


def test_displacement_starts_at_zero(spark, sf):
    rows = {r["tick"]: r for r in registry.QUERIES["swt"](spark, sf).collect()}
    assert rows[0]["mean"] == 0 and rows[300]["mean"] > 0


def test_regression_folds(spark, sf):
    assert [r["fold"] for r in registry.QUERIES["rct"](spark, sf).orderBy("fold").collect()] == [0, 1, 2, 3, 4]
