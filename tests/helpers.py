"""Literal staging rows."""

from __future__ import annotations

from datetime import date, timedelta

from farebox.schemas import STAGING, conform
from pyspark.sql import functions as F

DEFAULTS = {
    "Carrier_Full_Name": "Long", "Service_Type": "Regional", "Bus_Departures": 10,
    "Passenger_Departures": 100, "Avg_Temp_F": 50.0, "Precipitation_Inches": 0.1, "Snow_Inches": 0.0,
    "Weather_Condition": "Normal", "Is_Severe_Weather": "False", "COVID_Period": "Pre",
    "Economic_Period": "Stable", "Is_COVID_Period": "False", "Is_High_Inflation": "False",
    "Is_Holiday": "False", "Is_Tourism_Peak": "False", "NYC_Event": None,
}


def week(n: int, first: date = date(2019, 1, 4)) -> date:
    return first + timedelta(weeks=n)


def staging(spark, rows: list[dict]):
    """Rows of (Week_Date, Carrier_Name, ...) as a staging frame; calendar columns are derived."""
    full = []
    for row in rows:
        day = row.get("Week_Date")
        given = DEFAULTS | {"Carrier_Name": "A"} | row
        if day is not None:
            given = {
                "Year": day.year, "Quarter": (day.month - 1) // 3 + 1, "Month": day.month,
                "Month_Name": day.strftime("%B"), "Week_of_Year": day.isocalendar()[1],
                "Season": ["Winter", "Spring", "Summer", "Fall"][day.month % 12 // 3],
                "Days_Since_Pandemic_Start": (day - date(2020, 3, 1)).days} | given
        full.append(given)
    names = [f.name for f in STAGING]
    loose = ", ".join(
        f"`{f.name}` {'double' if 'decimal' in f.dataType.simpleString() else f.dataType.simpleString()}"
        for f in STAGING)
    data = [tuple(row.get(n) for n in names) for row in full]
    return conform(spark.createDataFrame(data, loose), STAGING)


def rows(df, *order):
    """Rows as tuples, ordered, decimals as floats."""
    from farebox.functions.measures import plain
    out = [tuple(r) for r in plain(df).collect()]
    return sorted(out, key=lambda r: tuple(str(v) for v in r)) if not order else out


def lit_date(text: str):
    return F.lit(text).cast("date")
