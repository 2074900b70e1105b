"""Dates, week labels and calendar attributes as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.constants import DOTTED_MONTHS, MONTH_NUMBERS


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


# ---- dates -------------------------------------------------------------------------

def safe_date(text: Column | str) -> Column:
    """Text to date, ISO or MM/dd/yyyy; NULL when it is neither."""
    text = _c(text)
    return F.coalesce(text.try_cast("date"), F.try_to_timestamp(text, F.lit("MM/dd/yyyy")).cast("date"))


def date_key(day: Column | str) -> Column:
    """yyyymmdd as an integer."""
    return F.date_format(_c(day), "yyyyMMdd").cast("int")


def date_key_from_parts(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """The same key built from separately stored year and month, which may disagree with the day."""
    return F.concat(
        _c(year).cast("string"),
        F.lpad(_c(month).cast("string"), 2, "0"),
        F.lpad(F.dayofmonth(_c(day)).cast("string"), 2, "0"),
    ).cast("int")


def week_friday(moment: Column | str) -> Column:
    """Friday of the ISO week, by day arithmetic alone."""
    day = _c(moment).cast("date")
    return F.date_add(day, 4 - F.weekday(day))


def days_since(day: Column | str, reference: date) -> Column:
    return F.datediff(_c(day), F.lit(reference))


def month_start(day: Column | str) -> Column:
    return F.trunc(_c(day), "month")


# ---- attributes --------------------------------------------------------------------

def season(month: Column | str) -> Column:
    month = _c(month)
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .when(month.isNotNull(), "Fall")
    )


def fiscal_year(day: Column | str) -> Column:
    """Years starting in July carry the calendar year of that July."""
    day = _c(day)
    return F.when(F.month(day) >= 7, F.year(day)).otherwise(F.year(day) - 1)


def with_date_parts(df: DataFrame, day: str = "Week_Date") -> DataFrame:
    """Year, quarter, month, month name, ISO week, season, fiscal year and weekday name."""
    d = F.col(day)
    return df.withColumns({
        "Year": F.year(d),
        "Quarter": F.quarter(d),
        "Month": F.month(d),
        "Month_Name": F.date_format(d, "MMMM"),
        "Week_of_Year": F.weekofyear(d),
        "Season": season(F.month(d)),
        "Fiscal_Year": fiscal_year(d),
        "Day_of_Week": F.date_format(d, "EEEE"),
    })


def with_calendar_flags(df: DataFrame, month: str = "Month") -> DataFrame:
    m = F.col(month)
    return df.withColumns({
        "Is_Summer_Peak": m.isin(7, 8),
        "Is_Holiday_Season": m == 12,
        "Is_Snow_Week": m.isin(12, 1, 2, 3),
        "Is_Hot_Week": m.isin(7, 8),
        "Is_Cold_Week": m.isin(12, 1, 2),
    })


# ---- week labels -------------------------------------------------------------------

_MONTH_DAY = r"([A-Za-z]+)\s+(\d+)"
_ANY_MONTH = "|".join(MONTH_NUMBERS)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _month_number(word: Column) -> Column:
    """Number of a month name; an unknown name reads as January."""
    numbers = F.create_map([F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
    return F.coalesce(F.try_element_at(numbers, word), F.lit(1))


def with_week_ending(df: DataFrame, label: str = "Week_Label", year: str = "Label_Year",
                     fix_year_rollover: bool = True) -> DataFrame:
    """Ending date of a label such as `Jan 4-8`, `Aug 28 - Sept 1` or `Jan 6-10, 2025`.

    Adds `Week_Date` and `Week_Date_Defaulted`, which marks labels read as 1 January
    because they could not be parsed. `fix_year_rollover` moves a label that ends in an
    earlier month than it starts (`Dec. 28-Jan 1`) into the following year.
    """
    text = F.regexp_replace(_strip(F.col(label)), f"({'|'.join(DOTTED_MONTHS)})\\.", "$1")
    parts = F.split(text, "-")
    start, end = _strip(parts[0]), _strip(F.element_at(parts, -1))
    month_in_end = end.rlike(_ANY_MONTH)
    dated = F.when(month_in_end, end).otherwise(start)
    word = F.regexp_extract(dated, _MONTH_DAY, 1)
    day = F.when(month_in_end, F.regexp_extract(end, _MONTH_DAY, 2)).otherwise(
        _strip(F.split(end, ",")[0]))
    end_month = _month_number(word)
    start_month = _month_number(F.regexp_extract(start, _MONTH_DAY, 1))
    rolls = month_in_end & start.rlike(_MONTH_DAY) & (end_month < start_month)
    shift = F.when(rolls, 1).otherwise(0) if fix_year_rollover else F.lit(0)
    parsed = F.when(
        F.contains(text, F.lit("-")) & (word != ""),
        F.concat(F.lpad((F.col(year) + shift).cast("string"), 4, "0"), F.lit("-"),
                 F.lpad(end_month.cast("string"), 2, "0"), F.lit("-"),
                 day.try_cast("int").cast("string")).try_cast("date"))
    return (
        df.withColumn("_parsed", parsed)
        .withColumns({
            "Week_Date": F.coalesce("_parsed", F.make_date(F.col(year), F.lit(1), F.lit(1))),
            "Week_Date_Defaulted": F.col("_parsed").isNull(),
        })
        .drop("_parsed"))


def week_label(friday: Column | str) -> Column:
    """Monday to Friday of the week as `MMM d-d`, or `MMM d-MMM d` across months."""
    friday = _c(friday)
    monday = F.date_sub(friday, 4)
    tail = F.when(F.month(monday) == F.month(friday), F.date_format(friday, "d")).otherwise(
        F.date_format(friday, "MMM d"))
    return F.concat(F.date_format(monday, "MMM d"), F.lit("-"), tail)


def label_year(friday: Column | str) -> Column:
    """Year of the week's Monday, under which its sheet is filed."""
    return F.year(F.date_sub(_c(friday), 4))
