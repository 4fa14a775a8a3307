"""Functions of nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = ("A", "C", "G", "T")


def count_letter(seq: Column, letter: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))).cast("double")


def count_acgt(seq: Column, max_len: int | None = None) -> Column:
    """Counts of upper-case A, C, G and T; over max_len is an error."""
    counts = F.array(*[count_letter(seq, x) for x in LETTERS])
    if max_len is None:
        return counts
    return F.when(F.length(seq) > max_len, F.raise_error(F.lit(f"a sequence is longer than {max_len}")).cast("array<double>")).otherwise(counts)


def reverse_complement(seq: Column, keep_case: bool = False) -> Column:
    """Other letters stay; without keep_case the result is upper-case."""
    if keep_case:
        return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")
    return F.translate(F.reverse(F.upper(seq)), "ATCG", "TAGC")


def window(seq: Column, start: Column, end: Column) -> Column:
    """seq[start:end]; what lies beyond the end is cut off, a negative start or a window longer than the sequence is an error."""
    bad = (start < 0) | (end - start > F.length(seq))
    return F.when(bad, F.raise_error(F.lit("an interval is outside its sequence")).cast("string")).otherwise(F.substring(seq, (start + 1).cast("int"), (end - start).cast("int")))


def chunks(seq: Column, size: int) -> Column:
    """Pieces of `size` letters, the last one shorter; an empty sequence has none."""
    starts = F.when(F.length(seq) > 0, F.sequence(F.lit(0), F.length(seq) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(seq, i + 1, F.lit(size)))


def half_windows(seq: Column, size: int, gap: float) -> Column:
    """Windows of `size` letters whose starts are gap x size apart, as many as fit in 1/gap + 1 steps."""
    step, steps = round(size * gap), round(1 / gap) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.substring(seq, i * step + 1, F.lit(size)))


#: Numbers of the letters, as a regression target and as model tokens.
AS_FLOAT = "ACGTN"
AS_TOKEN = "ATCG"


def letter_numbers(seq: Column, order: str = AS_FLOAT) -> Column:
    """Position of each letter in `order`; other letters are null."""
    return F.transform(F.filter(F.split(seq, ""), lambda x: x != ""), lambda x: F.nullif(F.position(x, F.lit(order)), F.lit(0)) - 1)


def padded(seq: Column, size: int, pad: str = "N") -> Column:
    """Upper-case letters, padded on the left."""
    return F.lpad(F.upper(seq), size, pad)
