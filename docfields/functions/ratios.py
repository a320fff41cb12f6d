"""Number column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 for a zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def round_half_even(value: Column, digits: int = 3) -> Column:
    """Round the exact binary value of a double, ties to even.

    ``round`` and ``bround`` look at the shortest decimal text instead, which calls 0.0005 a tie although the
    double lies above it. Here the double is split into two halves whose products with ``10**digits`` are
    exact, so that the distance to the tie has the right sign.
    """
    factor = F.lit(float(10**digits))
    scaled = value * F.lit(134217729.0)  # 2**27 + 1 cuts the 53-bit mantissa in two
    high = scaled - (scaled - value)
    product, rest = high * factor, (value - high) * factor
    below = F.floor(product)
    distance = (product - below.cast("double") - F.lit(0.5)) + rest
    up = (distance > 0) | ((distance == 0) & (below % 2 != 0))
    return (below + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("double") / factor
