"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def ratio(numerator: Column, denominator: Column, when_zero: Column | None = None) -> Column:
    """Division that never raises: ``when_zero`` (default NULL) replaces a zero denominator."""
    safe = F.when(denominator != 0, numerator / denominator)
    return safe if when_zero is None else F.when(denominator == 0, when_zero).otherwise(safe)


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def rounded(column: Column, digits: int) -> Column:
    """``F.round`` of a double, value for value, in plain arithmetic: the decimal rounding is left to numbers next to a tie, large ones and
    those without a value. Both divide a whole number by a power of ten."""
    scaled = column * F.lit(float(10**digits))
    whole = F.floor(scaled + F.lit(0.5))
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - whole) < 0.499999)
    return F.when(plain, whole / F.lit(float(10**digits))).otherwise(F.round(column, digits))
