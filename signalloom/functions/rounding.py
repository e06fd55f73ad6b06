"""Rounding of doubles that agrees with correctly rounded decimal output.

Spark's ``round`` looks at the printed decimal digits and rounds ties up, so
2.675 gives 2.68 although the stored double lies below the tie, and 0.125 gives
0.13 although that tie is exact and goes to the even neighbour. ``exact_round``
decides on the exact binary value and sends exact ties to the even digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1 halves a double into two 26-bit parts


def _halves(value: float) -> tuple[float, float]:
    carried = _SPLITTER * value
    high = carried - (carried - value)
    return high, value - high


def exact_round(col: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals, ties on the exact value to even.

    ``col`` occurs several times in the result, so callers pass a column or a
    short expression and keep conditions inside it: NULL gives NULL.
    """
    x = col.cast("double")
    scale = float(10**digits)
    product = x * F.lit(scale)
    nearest = F.rint(product)
    gap = product - nearest
    # Only a product that looks like a tie needs what its rounding lost.
    settled = F.when(F.abs(gap) == 0.5, _settle_tie(x, scale, product, nearest, gap)).otherwise(nearest)
    return settled / F.lit(scale)


def _settle_tie(x: Column, scale: float, product: Column, nearest: Column, gap: Column) -> Column:
    """Neighbour chosen by the exact remainder (error-free product of two doubles)."""
    scale_high, scale_low = _halves(scale)
    carried = x * F.lit(_SPLITTER)
    high = carried - (carried - x)
    low = x - high
    lost = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    return nearest + F.when((gap > 0) & (lost > 0), 1.0).when((gap < 0) & (lost < 0), -1.0).otherwise(0.0)


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Rounded quotient; NULL when a side is NULL or the denominator is not positive."""
    den = denominator.cast("double")
    return exact_round(F.when(den > 0, numerator.cast("double") / den), digits)


def clamp(col: Column, low: float, high: float) -> Column:
    """Value limited to [low, high]; NULL stays NULL."""
    return F.when(col < low, F.lit(low)).when(col > high, F.lit(high)).otherwise(col)


def plain_number(col: Column) -> Column:
    """Print a rounded double positionally: 55.0, 0.0001, 12345678.9."""
    x = col.cast("double")
    whole = x == F.floor(x)
    digits = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", "")
    return F.when(whole, F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(digits)
