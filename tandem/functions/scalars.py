"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_false(cond: Column) -> Column:
    """Comparison as 0/1 where a NULL comparison counts as false (0)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def season_of(date_col: Column, start_month: int = 10) -> Column:
    """Season label of a date: months >= start_month belong to next year's season."""
    return F.when(F.month(date_col) >= start_month, F.year(date_col) + 1).otherwise(F.year(date_col)).cast("int")


def round1(c: Column) -> Column:
    """Round to one decimal, half-to-even like Python's round()."""
    return F.bround(c, 1)


def month_key(date_col: Column) -> Column:
    return F.date_format(date_col, "yyyy-MM")


def number_of(c: Column) -> Column:
    """Text or number as double; a bad number, "nan" included, is NULL (never an ANSI cast error or NaN)."""
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)
