"""Fixture views over the star-schema tables, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str):
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', CAST({ts} AS timestamp_ntz))").cast("long")


def iv_sample(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select(F.col("event_type").alias("set_id"), F.col("event_id").cast("long").alias("row_idx"), F.concat(F.lit("chr"), (F.col("user_id") % 22 + 1).cast("string")).alias("chrom"), _seconds("ts").alias("start"), (_seconds("ts") + 1 + F.floor(F.col("value") * 20)).cast("long").alias("end"))


def iv_query(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders")
    s = (F.col("o_orderkey") * 7919) % 2592000
    return o.select(F.col("o_orderpriority").alias("set_id"), F.col("o_orderkey").cast("long").alias("row_idx"), F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")).alias("chrom"), s.cast("long").alias("start"), (s + 1 + F.floor(F.col("o_totalprice") / 250)).cast("long").alias("end"))


def iv_bulk(spark: SparkSession, d: str) -> DataFrame:
    i = _table(spark, d, "lineitem")
    s = F.col("l_partkey") * 50 + F.col("l_linenumber") * 7
    return i.select(F.concat("l_returnflag", "l_linestatus").alias("set_id"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"), s.cast("long").alias("start"), (s + F.floor("l_quantity") * 10).cast("long").alias("end"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "documents").filter("lang = 'en'")
    return t.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), F.regexp_replace(F.upper("text"), "[^ACGTN]+", "").alias("seq"))


def seq_iv(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d).withColumn("id", F.substring("chrom", 4, 20).cast("long"))
    start = F.pmod(F.col("id") * 31, F.greatest(F.length("seq") - 60, F.lit(1)).cast("long"))
    return s.filter(F.length("seq") >= 60).select("chrom", F.col("id").alias("row_idx"), start.alias("start"), (start + 1 + F.col("id") % 60).alias("end"))


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("row_idx"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


def set_vecs(spark: SparkSession, d: str) -> DataFrame:
    v = vecs(spark, d)
    return v.select(F.concat(F.lit("cell"), F.col("label").cast("string"), F.lit("_state"), (F.col("row_idx") % 5).cast("string")).alias("set_id"), F.concat(F.lit("cell"), F.col("label").cast("string")).alias("cell"), F.concat(F.lit("state"), (F.col("row_idx") % 5).cast("string")).alias("state"), "row_idx", "vec")


def vec_iv(spark: SparkSession, d: str) -> DataFrame:
    return vecs(spark, d).join(iv_sample(spark, d), "row_idx").select("row_idx", "label", "vec", "set_id", "chrom", "start", "end")


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (iv_sample, iv_query, iv_bulk, sequences, seq_iv, vecs, set_vecs, vec_iv)}

SQL = {
    "iv_sample": """SELECT event_type AS set_id, event_id::BIGINT AS row_idx, 'chr' || (user_id % 22 + 1) AS chrom,
        date_diff('second', timestamp '2024-01-01', ts)::BIGINT AS start,
        (date_diff('second', timestamp '2024-01-01', ts) + 1 + floor(value * 20))::BIGINT AS "end" FROM events""",
    "iv_query": """SELECT o_orderpriority AS set_id, o_orderkey::BIGINT AS row_idx, 'chr' || (o_custkey % 22 + 1) AS chrom,
        ((o_orderkey * 7919) % 2592000)::BIGINT AS start,
        ((o_orderkey * 7919) % 2592000 + 1 + floor(o_totalprice / 250))::BIGINT AS "end" FROM orders""",
    "iv_bulk": """SELECT l_returnflag || l_linestatus AS set_id, 'chr' || (l_suppkey % 22 + 1) AS chrom,
        (l_partkey * 50 + l_linenumber * 7)::BIGINT AS start,
        (l_partkey * 50 + l_linenumber * 7 + floor(l_quantity) * 10)::BIGINT AS "end" FROM lineitem""",
    "sequences": "SELECT 'doc' || doc_id AS chrom, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS seq FROM documents WHERE lang = 'en'",
    "seq_iv": """SELECT chrom, substr(chrom, 4)::BIGINT AS row_idx, (substr(chrom, 4)::BIGINT * 31) % greatest(length(seq) - 60, 1) AS start,
        (substr(chrom, 4)::BIGINT * 31) % greatest(length(seq) - 60, 1) + 1 + substr(chrom, 4)::BIGINT % 60 AS "end" FROM sequences WHERE length(seq) >= 60""",
    "vecs": "SELECT vec_id::BIGINT AS row_idx, label::INT AS label, embedding::DOUBLE[] AS vec FROM embeddings",
    "set_vecs": """SELECT 'cell' || label || '_state' || (row_idx % 5) AS set_id, 'cell' || label AS cell, 'state' || (row_idx % 5) AS state, row_idx, vec FROM vecs""",
    "vec_iv": 'SELECT v.row_idx, v.label, v.vec, s.set_id, s.chrom, s.start, s."end" FROM vecs v JOIN iv_sample s ON s.row_idx = v.row_idx',
}


def with_views(sql: str) -> str:
    """The statement with the views it names, and those they name, ahead of it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(SQL[name])
                need.append(name)

    add(sql)
    sql = sql.strip()
    if not need:
        return sql
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {m[1] or ''}{head}, {sql[m.end():]}" if m else f"WITH {head} {sql}"
