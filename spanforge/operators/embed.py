"""Chunk, look up, run a model, put together again."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.columns import unused
from ..functions.vectors import mean_of
from ..sources.blocks import SequenceBlocks, cut
from .stages import Model, hooks_of, staged


class CountAcgt:
    """Counts of the four letters. wants a sequence; an expression, so that no row leaves the JVM."""

    wants, embed_dim = "sequence", 4

    def __init__(self, max_seq_len: int | None = None):
        self.max_seq_len = max_seq_len

    def __call__(self, seq: Column) -> Column:
        return S.count_acgt(seq)


class IntervalLength:
    """The interval's length as a vector of one."""

    wants, embed_dim, max_seq_len = "interval", 1, None

    def __call__(self, start: Column, end: Column) -> Column:
        return F.array((end - start).cast("double"))


def _outside(intervals: DataFrame, sizes: DataFrame) -> DataFrame:
    """No rows, or an error: worst cases by chromosome meet the sizes, so intervals themselves are not shuffled for it."""
    worst = intervals.groupBy("chrom").agg(F.max(F.col("end") - F.col("start")).alias("n"), F.min("start").alias("first"))
    lacking = F.raise_error(F.concat(F.lit("no sequence: "), F.coalesce("chrom", F.lit("null")))).cast("boolean")
    outside = F.raise_error(F.concat(F.lit("an interval is outside its sequence: "), F.col("chrom"))).cast("boolean")
    wrong = F.when(F.col("size").isNull(), lacking).when((F.col("first") < 0) | (F.col("n") > F.col("size")), outside).otherwise(F.lit(False))
    return worst.join(sizes, "chrom", "left").filter(wrong)


def look_up(intervals: DataFrame, sequences: DataFrame | SequenceBlocks, longest: int | None = None, anywhere: bool = False, **sizes: int) -> DataFrame:
    """The letters of each interval; a chromosome that sequences lack, a negative start or an interval longer than its sequence
    is an error, what lies beyond the end is cut off; with `anywhere`, for places that are not below 0 but may be anywhere else,
    there are no such errors and no pass for them. sequences: blocks, or rows (chrom, seq), which are cut into blocks first.

    Intervals meet the letters by (chrom, block), so that a chromosome is neither one key nor one row. One of up to `margin`
    letters lies in the block that it starts in; a longer one takes a piece from each block it meets, and its pieces are put
    together by the row (equal rows together, then repeated). Who knows that no interval is longer than `longest` letters, at most
    a margin, saves the plan for long ones; a longer one is then an error.
    """
    blocks = sequences if isinstance(sequences, SequenceBlocks) else cut(sequences, **sizes)
    block, margin = blocks.block, blocks.margin
    if longest is not None and longest > margin:
        raise ValueError("longest must not pass the margin")
    cols, number, letters_of = intervals.columns, unused(intervals, "block"), unused(intervals, "letters")
    start, end, b = F.col("start"), F.col("end"), F.col(number)
    letters = blocks.letters.select(F.col("chrom"), F.col("block").alias(number), F.col("letters").alias(letters_of))
    first = F.floor(start / block)
    size = F.greatest(end - start, F.lit(0))
    within = F.substring(letters_of, (start - b * block + 1).cast("int"), size.cast("int"))
    checked = F.when(F.lit(longest is not None) & (end - start > F.lit(longest or 0)), F.raise_error(F.lit(f"an interval is longer than {longest}")).cast("long")).otherwise(first)
    found = F.when(start.isNotNull() & end.isNotNull(), F.coalesce(within, F.lit("")))
    is_long = F.coalesce(end - start > margin, F.lit(False))
    short = intervals if longest is not None else intervals.filter(~is_long)
    short = short.withColumn(number, checked).join(letters, ["chrom", number], "left").select(*cols, found.alias("letters"))
    none = intervals.limit(0) if anywhere else _outside(intervals, blocks.sizes)
    none = none.select(*[F.lit(None).cast(kind).alias(c) for c, kind in [*intervals.dtypes, ("letters", "string")]])
    if longest is not None:
        return short.unionByName(none)
    last = F.greatest(F.floor((end - 1) / block), first)
    met = intervals.filter(is_long).withColumn(number, F.explode(F.sequence(first, last))).join(letters, ["chrom", number], "left")
    lo, hi = F.greatest(start, b * block), F.least(end, (b + 1) * block)
    piece = F.coalesce(F.substring(letters_of, (lo - b * block + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")), F.lit(""))
    pieces = met.withColumn(letters_of, piece).groupBy(*cols).agg(F.collect_set(F.struct(number, letters_of)).alias(letters_of), F.count_if(b == first).alias(number))
    whole = F.array_join(F.transform(F.array_sort(letters_of), lambda x: x[letters_of]), "")
    long_ = pieces.select(*cols, whole.alias("letters"), F.explode(F.sequence(F.lit(1), b.cast("int"))).alias(number)).drop(number)
    return short.unionByName(long_).unionByName(none)


def of_letters(letters: Column, model, pool: Callable[[Column], Column] = mean_of) -> Column:
    """The vector of a string: it is cut into chunks of the model's length, the model is run on each, and their plain mean
    (or another `pool` of the array of vectors) is taken. All chunks are in one row, so that needs no shuffle. Without such a
    length the string is one chunk, whose vector is its own mean."""
    if model.max_seq_len is None:
        return F.when(letters.isNotNull(), model(letters) if pool is mean_of else pool(F.array(model(letters))))
    parts = F.when(F.length(letters) == 0, F.array(F.lit(""))).otherwise(S.chunks(letters, model.max_seq_len))
    return pool(F.transform(parts, model))


def embed(intervals: DataFrame, sequences: DataFrame | SequenceBlocks | None, model, pool: Callable[[Column], Column] = mean_of, longest: int | None = None, keys: tuple[str, ...] = ("set_id", "row_idx"), anywhere: bool = False) -> DataFrame:
    """(keys…, vec) of each interval, by its letters (`look_up`, `of_letters`) or by its position, as the model wants."""
    keys = [c for c in keys if c in intervals.columns]
    if model.wants == "interval":
        return intervals.select(*keys, model(F.col("start"), F.col("end")).alias("vec"))
    return look_up(intervals, sequences, longest, anywhere).select(*keys, of_letters(F.col("letters"), model, pool).alias("vec"))


@dataclass(frozen=True)
class FunctionModel:
    """A function from a list of strings to a vector each, as a model."""

    forward: Callable[[list[str]], Iterable]
    max_seq_len: int | None
    embed_dim: int | None = None
    wants: str = "sequence"

    def collate(self, items: list[str]) -> list[str]:
        return items

    def __call__(self, batch: list[str]) -> Iterable:
        return self.forward(batch)


def embed_with(intervals: DataFrame, sequences: DataFrame | SequenceBlocks, model: Model, longest: int | None = None, batch: int = 64, **hooks) -> DataFrame:
    """As embed, with a model in Python (`stages.Model`): batches go over the borders of intervals. hooks: postprocess and consume, as in `stages.hooks_of`."""
    keys = [c for c in ("set_id", "row_idx") if c in intervals.columns]
    rows = intervals if model.wants == "interval" else look_up(intervals, sequences, longest).select(*keys, "letters")
    return staged(rows, keys, hooks_of(model, **hooks), batch, model.embed_dim)


def dechunk_mean(strings: DataFrame, size: int, model) -> DataFrame:
    """(idx, vec): strings (idx, seq) cut into pieces, the model run on each, and their plain mean; null for an empty string."""
    return strings.select("idx", mean_of(F.transform(S.chunks(F.col("seq"), size), model)).alias("vec"))
