"""Fiscal calendar (April to March) as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_year(date: str | Column) -> Column:
    """The fiscal year a date falls in: the year in which it ends. NULL for NULL."""
    return F.year(F.add_months(F.col(date).cast("date") if isinstance(date, str) else date.cast("date"), 9))


def fiscal_quarter(date: str | Column) -> Column:
    """Quarter 1 is April to June."""
    return F.quarter(F.add_months(F.col(date).cast("date") if isinstance(date, str) else date.cast("date"), 9))


def fiscal_year_of_text(period: str | Column) -> Column:
    """The fiscal year of an ISO date in text; NULL where it is none."""
    return F.year(F.add_months(F.try_to_timestamp(period, F.lit("yyyy-MM-dd")).cast("date"), 9))


def fiscal_start(year: str | Column) -> Column:
    return F.make_date(F.col(year) - 1 if isinstance(year, str) else year - 1, F.lit(4), F.lit(1))


def fiscal_end(year: str | Column) -> Column:
    return F.make_date(F.col(year) if isinstance(year, str) else year, F.lit(3), F.lit(31))


def two_digit_year(text: str | Column) -> Column:
    """'24' and '2024' give 2024; NULL outside 2000 to 2099."""
    n = F.col(text).try_cast("int") if isinstance(text, str) else text.try_cast("int")
    full = F.when(n < 100, n + 2000).otherwise(n)
    return F.when(full.between(2000, 2099), full)


def year_of_title(text: str | Column) -> Column:
    """The fiscal year a title names: 'Q3 FY24', then 'FY-24', then '2023-24' or '2023/24' (the year it ends in), then '2023'; NULL if none."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    first = lambda pattern, group=1: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    return F.coalesce(
        two_digit_year(first(r"q[1-4][\s-]*fy[\s-]*(\d{4}|\d{2})")), two_digit_year(first(r"\bfy[\s-]*(\d{4}|\d{2})")),
        first(r"(20\d{2})[–/-]\d{2,4}").try_cast("int") + 1, first(r"(20\d{2})").try_cast("int"),
    )


def fresh(ts: str | Column, now: Column, seconds: int) -> Column:
    """Whether a time is no older than so many seconds at `now`."""
    return F.unix_timestamp(now) - F.unix_timestamp(ts) <= seconds
