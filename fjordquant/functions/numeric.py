"""Null-aware arithmetic on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or either side is missing."""
    return F.try_divide(col(a), col(b))


def ratio_if_positive(a: Column | str, b: Column | str) -> Column:
    """a / b only where b > 0."""
    return F.when(col(b) > 0, col(a) / col(b))


def change(now: Column | str, before: Column | str) -> Column:
    """now / before - 1 only where the base is positive."""
    return F.when(col(before) > 0, col(now) / col(before) - 1)


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    """Null stays null; ``least``/``greatest`` alone would turn it into a bound."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def finite(c: Column) -> Column:
    """NaN and infinities become null, for every publish boundary."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def hundred(v: Column) -> Column:
    """Round to the nearest 100, ties to even."""
    return F.bround(v / 100.0, 0) * 100


def mean_of(parts: list[Column]) -> Column:
    """Mean over the non-null parts, null when there is none."""
    total = reduce(lambda a, b: a + b, [zero(p) for p in parts])
    n = reduce(lambda a, b: a + b, [p.isNotNull().cast("double") for p in parts])
    return F.when(n > 0, total / n)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the non-null parts with the weights renormalised."""
    total = reduce(lambda a, b: a + b, [zero(p) * w for p, w in parts])
    mass = reduce(lambda a, b: a + b, [p.isNotNull().cast("double") * w for p, w in parts])
    return F.when(mass > 0, total / mass)


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """A fixed dictionary as a literal map; no join needed."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.create_map(*entries)[key]
    return found if default is None else F.coalesce(found, default)


def rounded(df, digits: dict[str, int]):
    """Round the named columns once, at the publish boundary."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})
