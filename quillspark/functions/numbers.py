"""Numeric columns: guarded division, tolerances, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d; null where the denominator is at most 1 in size, which counts as zero."""
    return F.when(F.abs(d) > 1.0, n / d)


def percent(n: Column, d: Column) -> Column:
    return ratio(n, d) * 100


def relative_gap(claimed: Column, filed: Column) -> Column:
    return F.abs(claimed - filed) / F.greatest(F.abs(filed), F.lit(1.0))


def exact_sum(c: Column) -> Column:
    """The sum of doubles as that of decimals with 8 places, which no order of the rows changes; a value that is no such decimal is added as a double."""
    exact = c.try_cast("decimal(28,8)")
    return F.when(F.count(c) > 0, F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(F.when(exact.isNull(), c)), F.lit(0.0)))


def finite(c: Column) -> Column:
    """A double, or null for text that is no number, NaN and infinities."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def to_usd(value: Column, unit: Column) -> Column:
    """Raw dollars; the longest scale suffix is tested first, so millions are not taken for thousands."""
    u = F.lower(unit)
    return F.when(u.contains("1000000") | (u == "millions"), value * 1e6).when(u.contains("1000") | (u == "thousands"), value * 1e3).otherwise(value)


def pick_value(value: Column, val: Column) -> Column:
    """The first that is not null; zero is a value."""
    return F.coalesce(value, val)
