"""Rounding as Python does it: the exact binary value, halves to even."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
SPLITTER = float((1 << 27) + 1)


def halves(x: Column) -> tuple[Column, Column]:
    t = x * F.lit(SPLITTER)
    high = t - (t - x)
    return high, x - high


def py_round(c: Column | str, digits: int = 2) -> Column:
    """c to `digits` decimals. Null stays null; numbers too large to have so many decimals stay as they are.

    2 * 10**digits * c is taken without error, as a double and what it lacks, and held against the odd number between two results.
    The input and the product are bound by one-element arrays, so that a long expression for c stands in the plan once.
    """
    scale = F.lit(float(10**digits))
    twice = F.lit(float(2 * 10**digits))
    sh, sl = halves(twice)

    def bound(x: Column, f: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def rounded(x: Column, product: Column) -> Column:
        xh, xl = halves(x)
        lacks = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
        low = F.floor(product / 2).cast("double")
        over = product - low * 2 - 1
        up = (over > 0) | ((over == 0) & ((lacks > 0) | ((lacks == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
        return F.when(F.abs(x) < 1e13, (low + up.cast("double")) / scale).otherwise(x)

    given = (F.col(c) if isinstance(c, str) else c).cast("double")
    return bound(given, lambda x: bound(x * twice, lambda product: rounded(x, product)))
