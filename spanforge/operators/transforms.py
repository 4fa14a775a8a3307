"""Interval transforms. Each gives a column of arrays of structs (start, end), so a transform is one generator projection.

`apply` carries the lineage: base_idx is the row a new interval comes from, ord its place in depth-first order, and new_idx (on
request) its number over all new rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import vector_mean

Transform = Callable[[Column, Column], Column]


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint>>")


def chunk_max(size: int) -> Transform:
    """Windows of `size` from the start, the last one short; an empty interval gives none."""
    return lambda s, e: F.when(e > s, F.transform(F.sequence(F.lit(0), e - s - 1, F.lit(size)), lambda o: _span(s + o, F.least(s + o + size, e)))).otherwise(_none())


def chunk_keep(size: int) -> Transform:
    """As chunk_max, but an interval of up to `size`, empty ones too, stays as it is."""
    return lambda s, e: F.when(e - s <= size, F.array(_span(s, e))).otherwise(chunk_max(size)(s, e))


def translate(offset: int) -> Transform:
    return lambda s, e: F.array(_span(s + offset, e + offset))


def swell(factor: float) -> Transform:
    """Scale the length about the middle; sizes and starts are rounded half to even."""

    def make(s: Column, e: Column) -> Column:
        size = F.rint((e - s) * F.lit(float(factor)))
        start = F.rint((s + e) / 2 - size / 2)
        return F.array(_span(start, start + size))

    return make


def split(parts: int) -> Transform:
    """Near-equal parts, the first ones longer; an interval shorter than `parts` stays."""
    if parts < 1:
        raise ValueError("parts must be 1 or more")

    def make(s: Column, e: Column) -> Column:
        each, rest = F.floor((e - s) / parts), (e - s) % parts
        at = lambda i: s + i * each + F.least(i.cast("long"), rest)
        pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: _span(at(i), at(i + 1)))
        return F.when(e - s < parts, F.array(_span(s, e))).otherwise(pieces)

    return make


def slide(steps: int, strides: int | None = None) -> Transform:
    """`steps` copies, each a stride (length / strides) after the last; odd starts slide to the left."""

    def make(s: Column, e: Column) -> Column:
        stride = (e - s) / F.lit(float(strides or steps - 1)) * F.when(F.pmod(s, F.lit(2)) == 1, -1).otherwise(1)
        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: _span(F.rint(s + i * stride), F.rint(e + i * stride)))

    return make


def repeat(times: int) -> Transform:
    return lambda s, e: F.array_repeat(_span(s, e), times)


class UserTransform:
    """A transform of one's own: (chrom, start, end) -> such tuples, in any number. It runs as a table function of Spark, joined
    laterally, so `apply` keeps the lineage as with the built-in ones, and after `register` SQL can call it:
    SELECT … FROM intervals, LATERAL name(chrom, start, `end`)."""

    def __init__(self, transform: Callable[[tuple], Iterable[tuple]]):
        class Run:
            def eval(self, chrom, start, end):
                for k, (c, s, e) in enumerate(transform((chrom, start, end))):
                    yield k, c, s, e

        self.function = F.udtf(Run, returnType="place int, chrom string, start long, end long")

    def register(self, spark: SparkSession, name: str) -> None:
        spark.udtf.register(name, self.function)

    def rows(self, df: DataFrame) -> DataFrame:
        """df with each row's new intervals instead of its own, and their place from 0."""
        at = {c: F.col(c).outer() for c in ("chrom", "start", "end")}
        rest = [c for c in df.columns if c not in at]
        new = self.function(at["chrom"], at["start"].cast("long"), at["end"].cast("long")).alias("__new")
        return df.lateralJoin(new).select(*rest, *[F.col(f"__new.{c}").alias(c) for c in ("place", "chrom", "start", "end")])


def apply(df: DataFrame, *transforms: Transform | UserTransform, limit: int | None = None, numbered: bool = False) -> DataFrame:
    """Rows of (row_idx, chrom, start, end, …) through the transforms in turn: base_idx, ord and the new start and end."""
    if limit is not None:
        df = df.filter(F.col("row_idx") < limit)
    out = df.withColumnRenamed("row_idx", "base_idx").withColumn("ord", F.array().cast("array<int>"))
    rest = [c for c in out.columns if c not in ("start", "end", "ord")]
    for t in transforms:
        if isinstance(t, UserTransform):
            out = t.rows(out).select(*rest, F.concat("ord", F.array("place")).alias("ord"), "start", "end")
            continue
        out = out.select(*rest, "ord", F.posexplode(t(F.col("start"), F.col("end"))).alias("__k", "__iv"))
        out = out.select(*rest, F.concat("ord", F.array("__k")).alias("ord"), F.col("__iv.start").alias("start"), F.col("__iv.end").alias("end"))
    return number(out) if numbered else out


def number(new: DataFrame, by: str = "base_idx") -> DataFrame:
    """new_idx in depth-first order. Counts by base are summed first, so that only one row a base meets in the running total, and
    that runs within and over blocks of 65,536 ids, so no task has all of them."""
    counts = new.groupBy(by).agg(F.count("*").alias("__n")).withColumn("__b", F.shiftright(F.col(by), 16))
    blocks = counts.groupBy("__b").agg(F.sum("__n").alias("__t"))
    over = F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("__n").over(Window.partitionBy("__b").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.withColumn("__within", within).join(blocks.select("__b", over.alias("__over")), "__b").select(by, (F.col("__over") + F.col("__within")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by).orderBy("ord")) - 1
    return new.withColumn("__i", inside).join(before, by).withColumn("new_idx", (F.col("__before") + F.col("__i")).cast("long")).drop("__i", "__before")


def backward_mean(base: DataFrame, new: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean of the new rows' vectors for each base row; null for a base row without any."""
    return base.select("row_idx").join(vector_mean(new, ["base_idx"], vec), F.col("row_idx") == F.col("base_idx"), "left").select("row_idx", "vec")


def backward_sum(base: DataFrame, new: DataFrame, value: str) -> DataFrame:
    sums = new.groupBy("base_idx").agg(F.sum(value).alias("total"))
    return base.select("row_idx").join(sums, F.col("row_idx") == F.col("base_idx"), "left").select("row_idx", F.coalesce("total", F.lit(0)).alias("total"))


def backward(base: DataFrame, new: DataFrame, values: DataFrame, aggregate: Callable[[Column], Column]) -> DataFrame:
    """(row_idx, value): values (new_idx, value) of transformed rows, aggregated for each base row by any aggregate of a column,
    built-in or a grouped pandas UDF; null for a base row without new rows. new: (base_idx, new_idx). A new row without a value,
    or a value without a new row, is an error."""
    both = new.select("new_idx", "base_idx").withColumn("__new", F.lit(True)).join(values.select("new_idx", "value").withColumn("__value", F.lit(True)), "new_idx", "full_outer")
    bad = F.raise_error(F.concat(F.lit("rows and values do not match at "), F.col("new_idx").cast("string"))).cast("long")
    both = both.select(F.when(F.col("__new").isNull() | F.col("__value").isNull(), bad).otherwise(F.col("base_idx")).alias("base_idx"), "value")
    got = both.groupBy("base_idx").agg(aggregate(F.col("value")).alias("value"))
    return base.select("row_idx").join(got, F.col("row_idx") == F.col("base_idx"), "left").select("row_idx", "value")


def _cover(s: np.ndarray, e: np.ndarray, base: int, octaves: int, offsets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, size) of tiles of the spans of a batch, level by level."""
    row = np.arange(len(s))
    while len(row):
        octave = np.clip(np.floor(np.log2((e - s) / base)), 0, octaves - 1)
        size = base << octave.astype(np.int64)
        grid = size / offsets
        at = np.rint(np.rint((s + e) / 2 / grid) * grid - size / 2).astype(np.int64)
        keep = (np.minimum(e, at + size) - np.maximum(s, at)) * 2 >= size
        row, s, e, at, size = (x[keep] for x in (row, s, e, at, size))
        yield row, at, size
        row, s, e = np.concatenate([row, row]), np.concatenate([s, at + size]), np.concatenate([at, e])
        left = e > s
        row, s, e = row[left], s[left], e[left]


def tile(df: DataFrame, base: int, octaves: int, offsets: int) -> DataFrame:
    """Tiles of power-of-two sizes: row_idx, chrom, start, end of each tile.

    A span gets one tile: its size is base x 2^k for the largest octave that fits (base if none does), its middle the multiple of
    size/offsets nearest to the span's (halves to even). The tile counts if it covers half of its size at least; then the tips left and
    right of it are spans of their own. A row's tiles depend on that row alone, so this is a generator without a shuffle: the
    spans of a batch are tiled level by level, and depth goes with log2(length / base). Empty intervals and nulls give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, e = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            for row, at, size in _cover(s, e, base, octaves, offsets):
                of = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([of.column("row_idx"), of.column("chrom"), pa.array(at), pa.array(at + size)], names=["row_idx", "chrom", "start", "end"])

    kinds = dict(df.dtypes)
    spans = df.select("row_idx", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("start < `end`")
    return spans.mapInArrow(run, f"row_idx {kinds['row_idx']}, chrom {kinds['chrom']}, start long, end long")


def tile_sizes(df: DataFrame, sizes: str, octaves: int = 1, offsets: int = 1) -> DataFrame:
    """(set_id, row_idx, chrom, size, start, end, weight): `tile` with each base size in the array column `sizes`, in one pass. A
    tile's weight is its share of the positions that all the tiles of its row and size cover of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, e = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            for base in batch.column("sizes")[0].as_py() if batch.num_rows else ():
                parts = list(_cover(s, e, base, octaves, offsets))
                row, at, size = (np.concatenate(x) for x in zip(*parts, strict=True))
                shared = np.minimum(at + size, e[row]) - np.maximum(at, s[row])
                weight = shared / np.bincount(row, shared, minlength=len(s))[row]
                of = batch.take(pa.array(row))
                columns = [*[of.column(c) for c in ("set_id", "row_idx", "chrom")], pa.array(np.full(len(row), base)), pa.array(at), pa.array(at + size), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, names=["set_id", "row_idx", "chrom", "size", "start", "end", "weight"])

    kinds = dict(df.dtypes)
    spans = df.select("set_id", "row_idx", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(sizes).alias("sizes")).filter("start < `end`")
    return spans.mapInArrow(run, f"set_id {kinds['set_id']}, row_idx {kinds['row_idx']}, chrom {kinds['chrom']}, size long, start long, end long, weight double")


def tile_weights(base: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each tile's share of the positions that all the tiles of its base row cover of it."""
    own = base.select("row_idx", F.col("start").alias("s"), F.col("end").alias("e"))
    shared = F.least("e", "end") - F.greatest("s", "start")
    rows = tiles.join(own, "row_idx").withColumn("bp", shared)
    return rows.withColumn("weight", F.col("bp") / F.sum("bp").over(Window.partitionBy("row_idx"))).drop("s", "e")


def displaced(df: DataFrame, ticks: list[int], size: int) -> DataFrame:
    """For each interval, windows of another size displaced from its start by each tick."""
    return df.select("*", F.explode(F.array(*[F.lit(t) for t in ticks])).alias("tick")).select("row_idx", "chrom", "tick", (F.col("start") + F.col("tick")).alias("start"), (F.col("start") + F.col("tick") + size).alias("end"))
