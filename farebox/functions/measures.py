"""Ratios, percentages, flags and text-to-number conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.constants import STATUS_BY_YEAR, STATUS_DEFAULT

_WHOLE = "decimal(20,0)"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def ratio(numerator: Column, denominator: Column, scale: int = 2) -> Column:
    """Exact quotient, rounded half up; NULL on a zero or missing denominator.

    Both sides stay decimals, so the result depends neither on the order in which
    partial sums arrive nor on binary rounding.
    """
    return F.round(F.try_divide(numerator, denominator), scale).cast(f"decimal(20,{scale})")


def passengers_per_bus(passengers: Column | str, buses: Column | str) -> Column:
    """Passengers per bus on whole counts; NULL unless there is at least one bus."""
    buses = _c(buses)
    return F.when(buses > 0, ratio(_c(passengers).cast(_WHOLE), buses.cast(_WHOLE)))


def passengers_per_bus_double(passengers: Column | str, buses: Column | str) -> Column:
    """The unrounded ratio of the consolidated table."""
    buses = _c(buses)
    return F.when(buses > 0, _c(passengers) / buses)


def percent_of(value: Column | str, base: Column | str) -> Column:
    """value as a percentage of base; NULL on a zero or missing base."""
    return ratio(_c(value).cast(_WHOLE) * 100, _c(base).cast(_WHOLE))


def percent_change(value: Column | str, base: Column | str) -> Column:
    """Change from base to value in percent of base, as double; NULL on a zero base."""
    value, base = _c(value).cast("double"), _c(base).cast("double")
    return F.try_divide((value - base) * 100, base)


def mean_of_whole(total: Column, count: Column, scale: int = 2) -> Column:
    """Mean of whole numbers from their sum and count."""
    return ratio(total.cast(_WHOLE), count.cast(_WHOLE), scale)


def mean_of_measure(total: Column, count: Column, scale: int = 2) -> Column:
    """Mean of two-digit measures from their decimal sum and count."""
    return ratio(total.cast("decimal(22,2)"), count.cast("decimal(16,0)"), scale)


def to_number(text: Column | str) -> Column:
    """Text to double; NULL when it is no plain decimal number, or none that is finite."""
    text = F.trim(_c(text).cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def flag(text: Column | str) -> Column:
    """1 for the text 'True' in any case, otherwise 0."""
    return F.when(F.lower(F.trim(_c(text).cast("string"))) == "true", 1).otherwise(0)


def classify(day: Column | str, starts: list[tuple[str, str | None]], before: str | None = None) -> Column:
    """Label of the last period that starts on or before the day.

    `starts` lists (first day as ISO text, label) in ascending order; a label of None opens
    a stretch without a period. `before` labels days ahead of the first start.
    """
    day = _c(day)
    expr = None
    for first, label in reversed(starts):
        condition, value = day >= F.lit(first).cast("date"), F.lit(label).cast("string")
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    rest = F.when(day.isNotNull(), F.lit(before).cast("string"))
    return rest if expr is None else expr.otherwise(rest)


def status_of_year(year: Column | str) -> Column:
    year = _c(year)
    expr = F
    for value, label in STATUS_BY_YEAR.items():
        expr = expr.when(year == value, label)
    return expr.otherwise(STATUS_DEFAULT)


def fill(column: Column | str, default: str) -> Column:
    return F.coalesce(_c(column), F.lit(default))


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for consumers without a decimal type."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({name: F.col(name).cast("double") for name in decimals}) if decimals else df
