"""The six dimensions: distinct members first, surrogate key second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.constants import NO_EVENT, SERVICE_SUFFIX, UNKNOWN_CONDITION
from farebox.functions.calendar import date_key
from farebox.functions.measures import fill, flag
from farebox.operators.keys import dense_key
from farebox.operators.rows import not_null
from farebox.schemas import (
    DIM_CARRIER, DIM_DATE, DIM_EVENT, DIM_SERVICE_TYPE, DIM_STATUS, DIM_WEATHER, conform)

# Natural keys: every column of a dimension but its surrogate.
WEATHER_KEY = DIM_WEATHER.names[1:]
NARROW_WEATHER_KEY = ["Avg_Temp_F", "Precipitation_Inches", "Weather_Condition"]
STATUS_KEY = DIM_STATUS.names[1:]
EVENT_KEY = DIM_EVENT.names[1:]


def weather_attributes(df: DataFrame) -> DataFrame:
    """Weather members are identified by all five attributes; no condition reads as Unknown."""
    return df.withColumns({
        "Weather_Condition": fill("Weather_Condition", UNKNOWN_CONDITION),
        "Is_Severe_Weather": flag("Is_Severe_Weather"),
    })


def status_attributes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "Is_COVID_Period": flag("Is_COVID_Period"),
        "Is_High_Inflation": flag("Is_High_Inflation"),
    })


def event_attributes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "Is_Holiday": flag("Is_Holiday"),
        "NYC_Event": fill("NYC_Event", NO_EVENT),
        "Is_Tourism_Peak": flag("Is_Tourism_Peak"),
    })


def service_description(service_type: Column | str, suffix: str = SERVICE_SUFFIX) -> Column:
    column = F.col(service_type) if isinstance(service_type, str) else service_type
    return F.concat(column, F.lit(suffix))


def dim_date(src: DataFrame) -> DataFrame:
    """One row per week; the key is a function of the date.

    Where rows of one week disagree, a flag is set if any row sets it, and the other attributes
    are the smallest; `dim_conflicts` lists such weeks.
    """
    rows = not_null(src, "Week_Date", "Year").withColumns({
        "Date_Key": date_key("Week_Date"),
        "Is_Holiday": flag("Is_Holiday"),
        "Is_Tourism_Peak": flag("Is_Tourism_Peak"),
    })
    rows = conform(rows, DIM_DATE)
    keys = ["Date_Key", "Week_Date"]
    pick = {c: F.max if c.startswith("Is_") else F.min for c in rows.columns if c not in keys}
    return conform(rows.groupBy(*keys).agg(*[f(c).alias(c) for c, f in pick.items()]), DIM_DATE)


def dim_conflicts(src: DataFrame) -> DataFrame:
    """Weeks and carriers whose rows disagree: dimension, member, attribute and number of values."""
    def count(df: DataFrame, name: str, key: str, columns: list[str]) -> DataFrame:
        counted = df.groupBy(F.col(key).cast("string").alias("member")).agg(
            *[F.countDistinct(c).alias(c) for c in columns])
        return counted.select(F.lit(name).alias("dimension"), "member", F.explode(F.array(*[
            F.struct(F.lit(c).alias("attribute"), F.col(c).alias("n_values")) for c in columns])).alias("x")).select(
                "dimension", "member", "x.*").where("n_values > 1")

    weeks = not_null(src, "Week_Date", "Year").withColumns({
        "Is_Holiday": flag("Is_Holiday"), "Is_Tourism_Peak": flag("Is_Tourism_Peak")})
    attributes = [f.name for f in DIM_DATE if f.name not in ("Date_Key", "Week_Date")]
    return count(weeks, "dim_date", "Week_Date", attributes).union(
        count(not_null(src, "Carrier_Name"), "dim_carrier", "Carrier_Name", ["Carrier_Full_Name"]))


def dim_carrier(src: DataFrame) -> DataFrame:
    members = not_null(src, "Carrier_Name").select("Carrier_Name", "Carrier_Full_Name").distinct()
    keyed = dense_key(members, "Carrier_Key", F.col("Carrier_Name"), ["Carrier_Full_Name"])
    return conform(keyed, DIM_CARRIER)


def dim_weather(src: DataFrame) -> DataFrame:
    members = weather_attributes(src).select(*WEATHER_KEY).distinct()
    keyed = dense_key(members, "Weather_Key", F.col("Avg_Temp_F"), WEATHER_KEY)
    return conform(keyed, DIM_WEATHER)


def dim_status(src: DataFrame) -> DataFrame:
    members = status_attributes(not_null(src, "COVID_Period")).select(*STATUS_KEY).distinct()
    keyed = dense_key(members, "COVID_Key", F.col("Days_Since_Pandemic_Start"), STATUS_KEY)
    return conform(keyed, DIM_STATUS)


def dim_event(src: DataFrame) -> DataFrame:
    members = event_attributes(src).select(*EVENT_KEY).distinct()
    keyed = dense_key(members, "Event_Key", F.col("NYC_Event"), ["Is_Holiday", "Is_Tourism_Peak"])
    return conform(keyed, DIM_EVENT)


def dim_service_type(src: DataFrame, suffix: str = SERVICE_SUFFIX) -> DataFrame:
    members = not_null(src, "Service_Type").select("Service_Type").distinct()
    keyed = dense_key(members, "Service_Type_Key", F.col("Service_Type"), [])
    return conform(
        keyed.withColumn("Service_Description", service_description("Service_Type", suffix)),
        DIM_SERVICE_TYPE)


DIMENSIONS = {
    "dim_date": dim_date,
    "dim_carrier": dim_carrier,
    "dim_weather": dim_weather,
    "dim_status": dim_status,
    "dim_event": dim_event,
    "dim_service_type": dim_service_type,
}


def load_dimensions(src: DataFrame) -> dict[str, DataFrame]:
    return {name: build(src) for name, build in DIMENSIONS.items()}
