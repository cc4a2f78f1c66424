"""Order statistics that must not be confused: upper, lower and interpolating medians, and nearest-rank quantiles. Each takes a sorted array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(a: Column) -> Column:
    return F.when(F.size(a) > 0, a[F.floor(F.size(a) / 2).cast("int")])


def lower_median(a: Column) -> Column:
    return F.when(F.size(a) > 0, a[F.floor((F.size(a) - 1) / 2).cast("int")])


def middle_median(a: Column) -> Column:
    return F.when(F.size(a) > 0, (lower_median(a) + upper_median(a)) / F.lit(2.0))


def nearest_rank(a: Column, q: float) -> Column:
    """The value at round((n - 1) q), halves away from zero."""
    return F.when(F.size(a) > 0, a[F.round((F.size(a) - 1) * F.lit(q)).cast("int")])


def round_scaled(v: Column, digits: int) -> Column:
    """v times 10^digits, rounded to a whole number with halves away from zero, and divided again. F.round reads a double by its shortest digits instead, which may end below a half that the product meets."""
    return F.round(v * F.lit(10.0**digits), 0) / F.lit(10.0**digits)
