"""Draws by hash: the same under any partitioning, and in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a draw: 52 bits, which a double holds exactly.
DIGITS = 13


def digest(*parts: Column | int) -> Column:
    """md5 of the parts joined by underscores, an order to draw by."""
    return F.md5(F.concat_ws("_", *[(F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts]))


def number(*parts: Column | int) -> Column:
    """A whole number below 16^DIGITS."""
    return F.conv(F.substring(digest(*parts), 1, DIGITS), 16, 10).cast("long")


def fraction(*parts: Column | int) -> Column:
    """A number in [0, 1)."""
    return number(*parts) / F.lit(float(16**DIGITS))
