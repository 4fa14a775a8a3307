"""Rounding as the SQL rounds, to the sign of a zero."""

import math

import duckdb

from spanforge.functions.columns import rounded
from spanforge.plans import registry


def test_rounded_is_that_of_sql(spark):
    values = [-1e-7, 1e-7, 0.0, -0.0, 5e-7, -5e-7, 1.5e-6, 2.5e-6, -2.5e-6, 0.5000005, 1.0000005, -3.1234565, 449 / 1e6, 1e300, math.inf, -math.inf, 123456789.1234565, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r["y"] for r in df.select("i", rounded("x", 6).alias("y")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))
    assert math.isnan(spark.sql("SELECT double('nan') AS x").select(rounded("x", 6)).first()[0])


def test_negative_means_and_sines_next_to_zero_keep_their_sign(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 0::BIGINT AS vec_id, list_transform(range(64), lambda i: -1e-7::FLOAT) AS embedding, 1 AS label) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"COPY (SELECT 0::BIGINT AS event_id, 1::BIGINT AS user_id, 'a' AS event_type, 1.0::DOUBLE AS value, TIMESTAMP '2024-01-01' + to_seconds(x) AS ts FROM (VALUES (5419351), (6167950)) t(x)) TO '{tmp_path}/events.parquet'")
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("set_mean", "group_centroid", "sinusoid_pe", "locus_encoding"):
        got = sorted(repr(r["vec"]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
        want = sorted(repr(r[0]) for r in con.execute(f"SELECT vec FROM ({registry.ORACLE[name]})").fetchall())
        assert got == want and any("-0.0," in w for w in want)


def test_genome_distance_of_reversed_intervals_is_that_of_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT k::BIGINT AS o_orderkey, (k % 2)::BIGINT AS o_custkey, CASE k % 5 WHEN 4 THEN NULL ELSE (k % 5 - 2) * 30000.0 END::DOUBLE AS o_totalprice, 'a' AS o_orderpriority
        FROM range(60) t(k)) TO '{tmp_path}/orders.parquet'""")
    con.execute(f"""COPY (SELECT k::BIGINT AS event_id, (k % 4)::BIGINT AS user_id, 'a' AS event_type, (k % 7 - 3) * 11.0::DOUBLE AS value, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts
        FROM range(60) t(k)) TO '{tmp_path}/events.parquet'""")
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = sorted((r["row_idx"], repr(r["mb"])) for r in registry.QUERIES["genome_distance"](spark, str(tmp_path)).collect())
    assert got == sorted((i, repr(mb)) for i, mb in con.execute(registry.ORACLE["genome_distance"]).fetchall())
