"""Queries over all rows, on a larger table than the other tests use."""

import pytest
from pyspark.sql import functions as F

from spanforge.operators import transforms as T
from spanforge.plans import registry, views

from .oracle import both

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["compose", "lineage", "except_keys", "triplets_hard", "triplets_semi_hard", "triplets_all", "triplet_loss", "pairwise_sq_l2", "merge_recall"])
def test_same_as_sql(spark, name):
    got, want = both(spark, LARGER, registry.QUERIES[name], registry.ORACLE[name])
    assert got == want
    if name in ("compose", "lineage"):
        rows = {r["row_idx"] for r in views.iv_sample(spark, LARGER).select("row_idx").collect()}
        assert max(rows) >= 3000 and {r[got[0].index("base_idx")] for r in got[1]} == rows


def test_numbers_over_blocks_of_ids(spark):
    df = spark.range(-100_000, 200_000, 7).select(F.col("id").alias("row_idx"), F.lit("c").alias("chrom"), F.lit(0).cast("long").alias("start"), (1 + F.pmod("id", F.lit(5))).cast("long").alias("end"))
    rows = T.apply(df, T.chunk_max(2), numbered=True).select("new_idx", "base_idx", "start").orderBy("base_idx", "start").collect()
    assert [r["new_idx"] for r in rows] == list(range(len(rows)))
