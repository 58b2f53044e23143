"""Column helpers: exact rounding, rates, durations, calendar parts, conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int = 2) -> Column:
    """Half away from zero on doubles, by plain arithmetic that every engine does alike; null stays null."""
    x, unit = as_col(c).cast("double"), 10**digits
    return F.signum(x) * (F.floor(F.abs(x) * F.lit(float(unit)) + 0.5).cast("double") / float(unit)) + 0.0


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """A double; null where the divisor is zero or null."""
    return as_col(top).cast("double") / F.nullif(as_col(bottom).cast("double"), F.lit(0.0))


def percent(top: str | Column, bottom: str | Column) -> Column:
    return rounded(100.0 * as_col(top).cast("double") / F.nullif(as_col(bottom).cast("double"), F.lit(0.0)))


def mean(total: Column, count: Column, digits: int = 2) -> Column:
    return rounded(ratio(total, count), digits)


def seconds(start: str, end: str) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    return F.expr(f"timestampdiff(SECOND, {start}, {end})")


def hours(start: str, end: str) -> Column:
    return rounded(seconds(start, end) / F.lit(3600.0))


def minutes(start: str, end: str) -> Column:
    return rounded(seconds(start, end) / F.lit(60.0))


def mean_seconds(start: str, end: str, unit: float, when: Column | None = None, digits: int = 2) -> Column:
    """Average duration in units of ``unit`` seconds, from an exact sum of seconds."""
    gap = seconds(start, end) if when is None else F.when(when, seconds(start, end))
    return rounded(F.sum(gap).cast("double") / F.nullif(F.count(gap).cast("double"), F.lit(0.0)) / F.lit(unit), digits)


def flag(condition: str | Column) -> Column:
    c = F.expr(condition) if isinstance(condition, str) else condition
    return F.when(c, 1).otherwise(0)


def count_where(condition: str | Column) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def sum_where(value: str, condition: str) -> Column:
    return F.sum(F.expr(f"CASE WHEN {condition} THEN {value} END"))


def iso_day(c: str) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(c) + 1).cast("int")


def weekend(c: str) -> Column:
    return flag(F.weekday(c) >= 5)


def money(c: str | Column) -> Column:
    """Decimal money leaves a report as double."""
    return as_col(c).cast("double")


def zero(c: str | Column) -> Column:
    return F.coalesce(as_col(c), F.lit(0))
