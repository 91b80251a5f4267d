"""Column expressions for levels, weightings and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def db(x: Column) -> Column:
    """Amplitude ratio in decibels, floored at -240."""
    return 20 * F.log10(F.greatest(F.abs(x), F.lit(FLOOR)))


def power_db(x: Column) -> Column:
    """Power ratio in decibels, floored at -120."""
    return 10 * F.log10(F.greatest(F.abs(x), F.lit(FLOOR)))


def leq(level: Column) -> Column:
    """Energy mean of levels (an aggregate)."""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), level / 10)) + FLOOR)


def weighting_db(f: Column, curve: str) -> Column:
    """Frequency weighting A, C or Z in decibels."""
    f2 = F.greatest(f, F.lit(1e-6)) * F.greatest(f, F.lit(1e-6))
    # Pole frequencies in Hz and offsets in dB of the A and C curves.
    hi, lo, mid1, mid2, a_off, c_off = 12200.0, 20.6, 107.7, 737.9, 2.0, 0.06
    if curve == "Z":
        return F.lit(0.0)
    if curve == "C":
        ratio, off = hi**2 * f2 / ((f2 + lo**2) * (f2 + hi**2)), c_off
    elif curve == "A":
        ratio, off = hi**2 * f2 * f2 / ((f2 + lo**2) * F.sqrt((f2 + mid1**2) * (f2 + mid2**2)) * (f2 + hi**2)), a_off
    else:
        raise ValueError(f"unknown weighting {curve}")
    return 20 * F.log10(F.greatest(ratio, F.lit(1e-20))) + off


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def below(x: Column, limit: Column) -> Column:
    """x < limit; false where x is NaN."""
    return ~F.isnan(x) & (x < limit)


def above(x: Column, limit: Column) -> Column:
    """x > limit; false where x is NaN (Spark takes NaN for the greatest number)."""
    return ~F.isnan(x) & (x > limit)


def summary_columns(v: str = "v") -> list[Column]:
    """Number, mean, population deviation, extremes and exact percentiles of the finite values of a column."""
    x = F.when(finite(F.col(v)), F.col(v))
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, F.lit(0.5)).alias("p50"), F.percentile(x, F.lit(0.95)).alias("p95"),
    ]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, without negative zero."""
    return df.select(*[(F.round(F.col(c), places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """Means rounded so that engines agree on them: fewer places for large numbers, and just off the ties that short decimals make."""
    c = lambda n: F.when(F.abs(n) >= 1e3, F.round(F.col(n) + 1.7e-7, 5)).otherwise(F.round(F.col(n) + 1.3e-11, 8))
    return df.withColumns({n: c(n) for n in columns})


def settled_sql(x: str) -> str:
    """The same in SQL."""
    return f"CASE WHEN abs({x}) >= 1e3 THEN round({x} + 17e-8, 5) ELSE round({x} + 13e-12, 8) END"


def total(array: Column, value=lambda x: x) -> Column:
    """Sum of a function of an array's elements."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def any_of(conditions: list[Column]) -> Column:
    """Whether at least one holds."""
    return reduce(lambda a, b: a | b, conditions)
