"""Source mixing by target weights over a time-varying curriculum. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: By rank of the source, repeating: its weight in the mix and, at the start and the end of training, its relative pace.
WEIGHTS = (1.0, 2.0, 3.0)
PACE = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))


def _cycled(values, rank):
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when((rank - 1) % len(values) == i, F.lit(v)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row a source (no_source, src, source_size, target, pace0, pace1) from rows (no_source, src, size).

    Targets share the total of all sizes by weight; none is above cap x its source's size, and what is cut off is shared
    again by weight. That fixed point is min(cap x size, level x weight): sources are ordered by the level at which they
    fill up, and the level is the first at which the rest fits. The windows run over one row a source.
    """
    per = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "src")))
    per = per.withColumn("weight", _cycled(weights, F.col("rank"))).withColumn("room", F.col("source_size") * F.lit(float(cap)))
    per = per.withColumn("fills_at", F.col("room") / F.col("weight"))
    order = Window.orderBy("fills_at", "rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    fits = F.when(F.col("level") <= F.col("fills_at"), F.col("level"))
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(everything))
    target = F.round(F.least(F.col("room"), F.coalesce(F.col("level") * F.col("weight"), F.col("room"))), 6)
    return per.select("no_source", "src", "source_size", target.alias("target"), _cycled([a for a, _ in PACE], F.col("rank")).alias("pace0"), _cycled([b for _, b in PACE], F.col("rank")).alias("pace1"))


def _occurrences(docs: DataFrame, weights, cap: float, bucket_digits: int) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = cut(docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), word_count("text").alias("size"), key.alias("key")))
    targets = source_targets(sized, weights, cap)
    sized = sized.withColumn("bucket", F.substring("key", 1, bucket_digits))
    in_source = Window.partitionBy("no_source", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sized.groupBy("no_source", "src", "bucket").agg(F.sum("size").alias("here")).withColumn("base", F.coalesce(F.sum("here").over(in_source), F.lit(0)))
    bases = bases.join(targets, ["no_source", "src"]).drop("here")
    in_bucket = Window.partitionBy("no_source", "src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(bases, ["no_source", "src", "bucket"])
    rows = rows.withColumn("start", F.col("base") + F.col("inside")).withColumn("goal", F.round("target").cast("long"))
    rows = rows.withColumn("passes", F.expr("if(source_size > 0, goal div source_size, 0)")).withColumn("rest", F.expr("goal - passes * source_size"))
    rows = rows.withColumn("taken", F.expr("passes * size + least(size, greatest(0, rest - start))"))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes").cast("long"))))
    rows = rows.withColumn("words", F.expr("if(pass < passes, size, least(size, greatest(0, rest - start)))")).filter("words > 0 OR (pass = 0 AND taken = 0)")
    share = F.least(F.lit(1.0), (F.col("start") + F.col("pass") * F.col("source_size")) / F.col("target"))
    a, b = F.col("pace0"), F.col("pace1")
    when = share * (a + b) / (a + F.sqrt(a * a + (b * b - a * a) * share))
    return rows.withColumn("position", F.when(F.col("words") > 0, F.round(when, 9)))


def schedule(docs: DataFrame, weights=WEIGHTS, cap: float = 3.0, bucket_digits: int = 4) -> DataFrame:
    """Plan of a training mix, one row each time a document is read: doc_id, size, source_size, target, taken (over all passes),
    pass (from 0), words (taken in this pass), position (0 to 1). A document of which nothing is taken has one row, without position.

    Documents of a source follow each other in the order of md5(doc_id). Demand for a source up to time t is target x the
    normalised integral of its linear pace; a row's position is the time at which demand reaches its first word. If a target is
    over the source's size, whole passes come first, each after the words of those before it; the last pass ends inside one
    document at most. Rows come range-sorted by position (not taken: last). Running totals: sums per (source, hash bucket),
    running sums of those, and a window within each bucket, so a source with a third of all rows is spread over
    16^bucket_digits buckets.
    Null text: size 0; null source: a source of its own, last; null doc_id: hashed as the empty string; repeated rows count
    each; an empty table gives no rows; columns besides doc_id, text and source are not read.
    """
    rows = _occurrences(docs, weights, cap, bucket_digits)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "pass", "words", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id", "pass")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = 3.0, bucket_digits: int = 4) -> DataFrame:
    """The schedule's first row of each document: doc_id, size, source_size, target, taken (over all passes), position (of the first)."""
    rows = _occurrences(docs, weights, cap, bucket_digits).filter("pass = 0")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
per AS (SELECT no_source, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY no_source, src) AS rk FROM sized GROUP BY 1, 2),
w AS (SELECT *, (CASE (rk - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS room FROM per),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(room) OVER (ORDER BY room / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY room / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT no_source, src, source_size, rk,
             round(least(room, (SELECT level FROM l WHERE level <= room / weight ORDER BY room / weight, rk LIMIT 1) * weight), 6) AS target FROM l),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.rk, round(t.target)::BIGINT AS goal,
             coalesce(sum(s.size) OVER (PARTITION BY s.no_source, s.src ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM sized s JOIN t ON s.no_source = t.no_source AND s.src = t.src),
u AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM r),
v AS (SELECT *, (passes * size + least(size, greatest(0, goal - passes * source_size - start)))::BIGINT AS taken, least(1.0::DOUBLE, start / target) AS share,
             (CASE (rk - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1.5 END)::DOUBLE AS a, (CASE (rk - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 0.5 END)::DOUBLE AS b FROM u)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(share * (a + b) / (a + sqrt(a * a + (b * b - a * a) * share)), 9) END AS position FROM v
"""
