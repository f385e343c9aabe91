"""Column helpers for the few places where SQL dialects differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """Quotient, NULL where the divisor is 0 or either side is NULL."""
    return F.try_divide(a, b)


def like_any_case(column: Column, pattern: str) -> Column:
    """LIKE that ignores case."""
    return column.ilike(pattern)


def year(column: Column) -> Column:
    return F.year(column).cast("bigint")


def month(column: Column) -> Column:
    return F.month(column).cast("bigint")


def day(column: Column) -> Column:
    return F.dayofmonth(column).cast("bigint")


def shift(column: Column, days: int = 0, months: int = 0, years: int = 0) -> Column:
    """A date moved by days, months and years; a day that the month lacks becomes its last one."""
    moved = F.add_months(column.cast("date"), months + 12 * years)
    return F.date_add(moved, days) if days else moved


def substring(column: Column, start: int, length: int | None = None) -> Column:
    """From position ``start`` (1-based) on, ``length`` characters or all."""
    if start < 1:
        raise ValueError("positions start at 1")
    return F.substring(column, start, length if length is not None else (1 << 31) - 1)


def trim_space(column: Column) -> Column:
    """Without white space of any kind at both ends; ``F.trim`` strips blanks only."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def text_of(*columns: Column) -> Column:
    """Concatenation, NULL if any part is."""
    return F.concat(*columns)


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def cents(column: Column) -> Column:
    """Rounded to 2 places: sums of doubles depend on the order in which tasks add them."""
    return F.round(column, 2)


def whole_cents(column: Column) -> Column:
    """Cut off after 2 places."""
    return F.floor(column * 100).cast("double") / 100
