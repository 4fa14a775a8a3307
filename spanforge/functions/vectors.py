"""Functions of ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def mean_of(parts: Column) -> Column:
    """Mean of an array of vectors of one length, within the row; null if there are none."""
    n = F.size(parts)
    total = F.aggregate(F.slice(parts, 2, 1 << 30), F.element_at(parts, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def last_of(parts: Column) -> Column:
    """The last of an array of vectors, for models that pool by their last position; null if there are none."""
    return F.try_element_at(parts, F.lit(-1))


def vector_mean(df: DataFrame, keys: list[str], vec: str = "vec", out: str = "vec") -> DataFrame:
    """Mean vector by group: partial sums by (group, position), so a group of any size is summed where its rows are."""
    places = df.select(*keys, F.posexplode(vec).alias("pos", "x"))
    means = places.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    rows = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("__p"))
    return rows.select(*keys, F.transform("__p", lambda p: p["x"]).alias(out))


def sinusoid(pos: Column, width: int = 32, base: float = 3e9) -> Column:
    """Interleaved sines and cosines of pos at width/2 frequencies."""
    import math

    angles = [pos * F.lit(math.exp(2 * i * -math.log(base) / width)) for i in range(width // 2)]
    return F.flatten(F.array(*[F.array(F.sin(a), F.cos(a)) for a in angles]))
