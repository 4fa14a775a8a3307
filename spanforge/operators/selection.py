"""Exact order statistics without a sorted list or a map of values in one buffer.

A quantile sketch of bounded size (Spark's, with a proven rank error) gives a bracket around each place asked for. A second pass counts what
lies below the bracket and each distinct value inside it; a running total over those few values finds the place. The bracket
holds 10^-4 of the rows, or SMALL, or fewer distinct values. A place outside its bracket would be an error, not a wrong value.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is 1 / ACCURACY of the rows.
ACCURACY = 100_000
#: Groups of up to so many rows are their own bracket: a bracket of shares would be narrower than a place or two.
SMALL = 200_000


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """(keys…, n, a column a name): of the n values of each group that are not null, in ascending order, the one at a 0-based place
    that is worked out from n; null beyond the last. places: name -> (about which share of n that is, place). Groups without values are left out."""
    rows = df.select(*keys, F.col(value).alias("__x")).filter(F.col("__x").isNotNull())
    names, wide = list(places), 3 / ACCURACY
    ends = [F.lit(e) for p, _ in places.values() for e in (max(0.0, p - wide), min(1.0, p + wide))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__x", F.array(*ends), ACCURACY).alias("__ends"))
    met = rows.join(sketch, keys) if keys else rows.crossJoin(F.broadcast(sketch))  # one row
    low, high = (lambda i: F.get("__ends", F.lit(2 * i))), (lambda i: F.get("__ends", F.lit(2 * i + 1)))
    x, small, places_of = F.col("__x"), F.col("n") <= SMALL, range(len(names))
    within = lambda i: small | x.between(low(i), high(i))
    below = met.groupBy(*keys, "n").agg(*[F.count_if(~small & (x < low(i))).alias(f"__b{i}") for i in places_of])
    some = met.filter(reduce(operator.or_, [within(i) for i in places_of]))
    inside = some.select(*keys, "__x", F.explode(F.array_compact(F.array(*[F.when(within(i), F.lit(i)) for i in places_of]))).alias("i"))
    counts = inside.groupBy(*keys, "i", "__x").agg(F.count("*").alias("__c"))
    counts = counts.join(below, keys) if keys else counts.crossJoin(F.broadcast(below))  # one row
    of = lambda columns: F.element_at(F.array(*columns), F.col("i") + 1)
    upto = of([F.col(f"__b{i}") for i in places_of]) + F.sum("__c").over(Window.partitionBy(*keys, "i").orderBy("__x"))
    place = of([places[k][1](F.col("n")).cast("long") for k in names])
    # the place lies in the bracket if fewer values than that lie below it; the first value that reaches beyond the place is the one
    counts = counts.withColumns({"__upto": upto, "__place": place}).filter((F.col("__upto") > F.col("__place")) & (of([F.col(f"__b{i}") for i in places_of]) <= F.col("__place")))
    found = counts.groupBy(*keys).agg(*[F.min_by(F.when(F.col("i") == i, F.struct(x.alias("x"))), F.when(F.col("i") == i, F.col("__upto"))).alias(f"__{i}") for i in places_of])
    bad = F.raise_error(F.lit("a place is outside of its bracket"))
    kind = dict(df.dtypes)[value]
    base = sketch.select(*keys, "n")
    out = base.join(found, keys, "left") if keys else base.join(found, how="left")
    cell = lambda i, k: F.when(places[k][1](F.col("n")).cast("long") < F.col("n"), F.coalesce(F.col(f"__{i}.x"), bad.cast(kind))).alias(k)
    return out.select(*keys, "n", *[cell(i, k) for i, k in enumerate(names)])


def percentile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys…, n, percentile): linear between the two nearest values, as `percentile` of Spark and numpy have it."""
    at = lambda n: (n - 1) * F.lit(share)
    ends = at_places(df, keys, value, {"__lo": (share, lambda n: F.floor(at(n))), "__hi": (share, lambda n: F.ceil(at(n)))})
    between = (at(F.col("n")) - F.floor(at(F.col("n")))) * (F.col("__hi") - F.col("__lo"))
    return ends.select(*keys, "n", (F.col("__lo") + between).alias("percentile"))
