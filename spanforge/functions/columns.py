"""Names of helper columns, and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def rounded(x: Column | str, digits: int) -> Column:
    """x to so many decimal places as SQL engines on doubles round: x times a power of ten, halves away from zero, zero with the
    sign of x. Spark's own goes by the decimal digits and loses the sign of a zero."""
    x, power = F.col(x) if isinstance(x, str) else x, float(10**digits)
    scaled = F.abs(x) * power
    whole = F.rint(scaled)
    return F.signum(x) * (whole + F.when(scaled - whole == 0.5, 1.0).otherwise(0.0)) / power
