"""Arithmetic and formatting as Column functions. NULL in, NULL out; no division ever fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def safe_div(n: Column, d: Column, places: int = 2) -> Column:
    """Rounded quotient; NULL if the divisor is NULL or 0."""
    return F.round(F.try_divide(n, d), places)


def pct(n: Column, d: Column, precise: bool = False) -> Column:
    """Percentage. By default the quotient is rounded to two places before it is multiplied, as the reference does."""
    return F.round(F.try_divide(n, d) * 100, 2) if precise else F.round(safe_div(n, d) * 100, 2)


def yoy(now: Column, before: Column) -> Column:
    """Change in percent of the earlier figure's size; NULL if that is NULL or 0."""
    return F.round(F.try_divide(now - before, F.abs(nonzero(before))) * 100, 2)


def cagr(start: Column, end: Column, years: Column) -> Column:
    """Compound growth a year in percent; NULL unless start, end and years are positive."""
    return F.when((start > 0) & (end > 0) & (years > 0), F.round((F.pow(end / start, 1.0 / years) - 1) * 100, 2))


def divergence(actual: Column, claim: Column) -> Column:
    """Relative distance of a claim; 0 where the actual is 0."""
    return F.when(actual == 0, F.lit(0.0)).otherwise(F.abs((claim - actual) / nonzero(actual)))


def scaled(c: Column, low: Column, high: Column) -> Column:
    """A score from 0 to 1 within its range; 1 where the range is a point."""
    return F.when(high == low, F.lit(1.0)).otherwise((c - low) / nonzero(high - low))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def shown(value: Column, unit: Column) -> Column:
    """A figure with its unit: 54.70%, 12.30x, 45 days, ₹12.00, ₹23,452.0 cr; 'n/a' for NULL."""
    return (
        F.when(value.isNull(), "n/a").when(unit == "%", F.concat(F.format_number(value, 2), F.lit("%"))).when(unit == "x", F.concat(F.format_number(value, 2), F.lit("x")))
        .when(unit == "days", F.concat(F.format_number(value, 0), F.lit(" days"))).when(unit == "rs", F.concat(F.lit("₹"), F.format_number(value, 2)))
        .when(unit == "crore", F.concat(F.lit("₹"), F.format_number(value, 1), F.lit(" cr"))).otherwise(F.format_number(value, 2))
    )
