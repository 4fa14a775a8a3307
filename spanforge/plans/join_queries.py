"""Joins, set operations and partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import partitioning as P
from ..sources import blocks
from . import views
from .core import query

_ON = 'q.chrom = s.chrom AND q.start < s."end" AND s.start < q."end"'


@query(f"SELECT q.row_idx AS q_row_idx, s.row_idx AS s_row_idx FROM iv_query q JOIN iv_sample s ON {_ON}")
def overlap_join(spark, d):
    return J.overlap_join(views.iv_query(spark, d), views.iv_sample(spark, d), columns=["q_row_idx", "s_row_idx"])


@query(f"SELECT q.row_idx, s.set_id, count(*) AS hits FROM iv_query q JOIN iv_sample s ON {_ON} GROUP BY 1, 2")
def overlap_count_by_set(spark, d):
    return J.overlap_count_by_set(views.iv_query(spark, d), views.iv_sample(spark, d))


@query(f"SELECT row_idx, set_id FROM iv_query q WHERE EXISTS (SELECT 1 FROM iv_sample s WHERE {_ON})")
def overlap_any(spark, d):
    return J.overlap_any(views.iv_query(spark, d), views.iv_sample(spark, d)).select("row_idx", "set_id")


@query(f"SELECT row_idx, set_id FROM iv_query q WHERE NOT EXISTS (SELECT 1 FROM iv_sample s WHERE {_ON})")
def overlap_none(spark, d):
    return J.overlap_none(views.iv_query(spark, d), views.iv_sample(spark, d)).select("row_idx", "set_id")


@query("SELECT v.row_idx, v.label, s.chrom, s.start FROM vecs v JOIN iv_sample s ON v.row_idx = s.row_idx")
def positional_zip(spark, d):
    return J.zip_rows(views.vecs(spark, d), views.iv_sample(spark, d), ["row_idx"]).select("row_idx", "label", "chrom", "start")


@query("SELECT n.n_nationkey AS ord, v.row_idx, v.label FROM nation n JOIN vecs v ON v.row_idx = n.n_nationkey * 7")
def set_row_gather(spark, d):
    wanted = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") * 7).cast("long").alias("row_idx"))
    return F.broadcast(wanted).join(views.vecs(spark, d), "row_idx").select("ord", "row_idx", "label").orderBy("ord")


@query("SELECT i.row_idx, length(s.seq) AS n FROM seq_iv i JOIN sequences s USING (chrom)")
def fasta_join(spark, d):
    sizes = blocks.cut(views.sequences(spark, d)).sizes
    return views.seq_iv(spark, d).join(sizes, "chrom").select("row_idx", F.col("size").alias("n"))


@query("SELECT a.row_idx AS i, b.row_idx AS j FROM vecs a JOIN vecs b ON a.label = b.label AND a.row_idx < b.row_idx")
def self_pairs_upper(spark, d):
    return J.upper_pairs(views.vecs(spark, d).select("row_idx", "label"), "row_idx", "label").select(F.col("a_row_idx").alias("i"), F.col("b_row_idx").alias("j"))


_RANKED = """WITH a AS (SELECT row_idx AS item, row_number() OVER (ORDER BY md5(row_idx::VARCHAR))::INT AS rank FROM vecs WHERE row_idx % 2 = 0),
b AS (SELECT row_idx AS item, row_number() OVER (ORDER BY md5('b' || row_idx))::INT AS rank FROM vecs WHERE row_idx % 3 = 0) """


def _two_rankings(spark, d):
    from pyspark.sql import Window

    v = views.vecs(spark, d)
    a = v.filter("row_idx % 2 = 0").select(F.col("row_idx").alias("item"), F.row_number().over(Window.orderBy(F.md5(F.col("row_idx").cast("string")))).alias("rank"))
    b = v.filter("row_idx % 3 = 0").select(F.col("row_idx").alias("item"), F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("b"), F.col("row_idx").cast("string"))))).alias("rank"))
    return a, b


@query(_RANKED + "SELECT item, row_number() OVER (ORDER BY a.rank)::INT AS left_rank, row_number() OVER (ORDER BY b.rank)::INT AS right_rank FROM a JOIN b USING (item)")
def common_items(spark, d):
    return J.common_items(*_two_rankings(spark, d))


@query(_RANKED + "SELECT a.rank, a.item AS l, b.item AS r FROM a JOIN b USING (rank)")
def zip_rankings(spark, d):
    a, b = _two_rankings(spark, d)
    return a.withColumnRenamed("item", "l").join(b.withColumnRenamed("item", "r"), "rank").select("rank", "l", "r")


@query("SELECT DISTINCT label FROM vecs")
def outer_check(spark, d):
    v = views.vecs(spark, d)
    return J.require_same_keys(v.select("label"), v.filter("row_idx % 2 = 0").select("label"), "label")


@query("SELECT set_id FROM (SELECT DISTINCT o_orderpriority AS set_id FROM orders) WHERE set_id NOT IN (SELECT set_id FROM iv_sample)")
def label_complete(spark, d):
    known = views.iv_query(spark, d).select("set_id").distinct()
    return J.missing_keys(known, views.iv_sample(spark, d).select("set_id"), "set_id")


@query("SELECT label FROM vecs WHERE row_idx % 2 = 0 INTERSECT SELECT label FROM vecs WHERE row_idx % 3 = 0")
def intersect_keys(spark, d):
    v = views.vecs(spark, d)
    return v.filter("row_idx % 2 = 0").select("label").intersect(v.filter("row_idx % 3 = 0").select("label"))


@query("SELECT chrom FROM iv_query EXCEPT ALL SELECT chrom FROM iv_sample")
def except_keys(spark, d):
    return views.iv_query(spark, d).select("chrom").exceptAll(views.iv_sample(spark, d).select("chrom"))


@query('SELECT 0 AS part, set_id, row_idx, chrom, start, "end" FROM iv_sample UNION ALL SELECT 1, set_id, row_idx, chrom, start, "end" FROM iv_query')
def union_all(spark, d):
    return P.union_all(views.iv_sample(spark, d), views.iv_query(spark, d))


@query("""WITH l AS (SELECT n_nationkey AS list, n_nationkey % 5 + 1 AS size FROM nation), s AS (SELECT *, sum(size) OVER (ORDER BY list) - size AS lo FROM l)
SELECT row_idx AS idx, list, (row_idx - lo)::BIGINT AS "offset" FROM vecs JOIN s ON row_idx >= lo AND row_idx < lo + size""")
def locate_in_union(spark, d):
    lists = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("list"), (F.col("n_nationkey") % 5 + 1).alias("size"))
    return J.locate(lists, views.vecs(spark, d).select(F.col("row_idx").alias("idx")))


@query("""WITH n AS (SELECT set_id, count(*) AS n FROM iv_sample GROUP BY 1), k AS (SELECT set_id, n, unnest(range(0, ((n + 63) // 64) * 64)) AS k FROM n)
SELECT set_id, k, CASE WHEN k < n THEN k END AS row_idx FROM k""")
def flatten_pad(spark, d):
    return P.flatten_padded(views.iv_sample(spark, d).groupBy("set_id").agg(F.count("*").alias("n")), 64)


@query("SELECT row_idx, row_idx % 7 AS shard FROM iv_sample")
def round_robin(spark, d):
    return views.iv_sample(spark, d).select("row_idx", P.round_robin(F.col("row_idx"), 7).alias("shard"))


@query("SELECT row_idx, (row_idx // 32) % 3 AS shard FROM iv_sample")
def block_round_robin(spark, d):
    return views.iv_sample(spark, d).select("row_idx", P.block_round_robin(F.col("row_idx"), 32, 3).alias("shard"))


@query("WITH t AS (SELECT count(*) AS n FROM vecs) SELECT row_idx, least(row_idx // (n // 7), 6) AS shard FROM vecs, t")
def block_split(spark, d):
    v = views.vecs(spark, d).select("row_idx")
    return v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).select("row_idx", P.block_split(F.col("row_idx"), F.col("n"), 7).alias("shard"))


@query("SELECT row_idx, ntile(7) OVER (ORDER BY row_idx) - 1 AS shard FROM vecs")
def even_split(spark, d):
    v = views.vecs(spark, d).select("row_idx")
    return v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).select("row_idx", P.even_split(F.col("row_idx"), F.col("n"), 7).cast("long").alias("shard"))


_CV = """WITH n AS (SELECT DISTINCT set_id AS name FROM set_vecs), t AS (SELECT count(*) AS n FROM n), p AS (SELECT name, row_number() OVER (ORDER BY md5(name || '_42'), name) - 1 AS place FROM n)
SELECT name, place, CASE WHEN place < floor(n * 0.7::DOUBLE) THEN 'train' WHEN place < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM p, t"""


@query(_CV)
def cv_split(spark, d):
    return P.cv_split(views.set_vecs(spark, d).select(F.col("set_id").alias("name")).distinct())


