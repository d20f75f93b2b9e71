"""Mean, variance and rounding over a fixed number of value columns.

Each function takes the values as separate columns and unrolls the arithmetic,
so the result is plain double arithmetic inside whole-stage codegen, in a fixed
order of operations (an ``avg`` aggregate would be free to reorder it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dekker's constant 2**27 + 1 splits a double into two halves of 26 bits.
_SPLIT = 134217729.0


def running_mean(values: Sequence[Column]) -> Column:
    """Incremental mean: ``a += (x - a) / i`` from left to right."""
    mean = F.lit(0.0)
    for i, x in enumerate(values, start=1):
        mean = mean + (x - mean) / F.lit(float(i))
    return mean


def sum_mean(values: Sequence[Column]) -> Column:
    """Left-to-right sum divided by the number of values."""
    total = F.lit(0.0)
    for x in values:
        total = total + x
    return total / F.lit(float(len(values)))


def population_variance(values: Sequence[Column], mean: Column, method: str = "running") -> Column:
    """Mean of the squared deviations from ``mean``, by the same mean method."""
    squares = [(x - mean) * (x - mean) for x in values]
    return running_mean(squares) if method == "running" else sum_mean(squares)


def round_half_up(value: Column, places: int, exact: bool = False) -> Column:
    """Round half up to ``places`` decimals.

    By default a tie is judged on the shortest decimal text of the double, so
    2.675 gives 2.68. With ``exact=True`` it is judged on the binary value, so
    2.675 (stored as 2.67499...) gives 2.67. The two differ on such apparent
    ties only, which the exact form settles with an error-free product.
    """
    rounded = F.round(value, places)
    if not exact:
        return rounded
    # An apparent tie is a double whose shortest text ends in 5 one decimal further
    # on: it equals k / fine for a whole k that ends in 5. The error-free product
    # then tells on which side of the tie the stored value really lies.
    fine = float(10 ** (places + 1))
    size = F.abs(value)
    product = size * F.lit(fine)
    k = F.rint(product)
    apparent_tie = (k < F.lit(2.0**52)) & (k % 10 == 5) & (k / F.lit(fine) == size)
    beyond = (product - k) + _product_error(size, fine, product)
    step = F.when(beyond < 0, F.lit(0.0)).otherwise(F.lit(1.0))
    settled = F.signum(value) * ((k - 5) / 10 + step) / F.lit(float(10**places))
    return F.when(apparent_tie, settled).otherwise(rounded)


def _product_error(x: Column, scale: float, product: Column) -> Column:
    """``x * scale - product`` without rounding error (Dekker's product)."""
    big = x * F.lit(_SPLIT)
    x_hi = big - (big - x)
    x_lo = x - x_hi
    s_big = scale * _SPLIT
    s_hi = s_big - (s_big - scale)
    s_lo = scale - s_hi
    head = x_hi * F.lit(s_hi) - product
    return head + x_hi * F.lit(s_lo) + x_lo * F.lit(s_hi) + x_lo * F.lit(s_lo)
