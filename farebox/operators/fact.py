"""Fact load and star read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.operators.dims import (
    EVENT_KEY, NARROW_WEATHER_KEY, STATUS_KEY, WEATHER_KEY, event_attributes, status_attributes, weather_attributes)
from farebox.operators.keys import dense_key
from farebox.operators.rows import not_null
from farebox.schemas import FACT, conform


def _lookup(rows: DataFrame, dim: DataFrame, key: str, natural: list[str], how: str,
            null_safe: bool = False, one_each: bool = False) -> DataFrame:
    """Attach a dimension's surrogate key by its natural key.

    No hint: Spark broadcasts the dimension when its measured size is under the broadcast
    threshold; otherwise the join shuffles and the runtime splits skewed keys. `one_each`
    takes the lowest key of members that share the natural key but differ elsewhere.
    """
    d = dim.select(F.col(key), *[F.col(c).alias(f"_d_{c}") for c in natural])
    if one_each:
        d = d.groupBy(*[f"_d_{c}" for c in natural]).agg(F.min(key).alias(key))
    pairs = [(F.col(c).eqNullSafe(F.col(f"_d_{c}")) if null_safe else F.col(c) == F.col(f"_d_{c}"))
             for c in natural]
    return rows.join(d, reduce(Column.__and__, pairs), how).drop(*[f"_d_{c}" for c in natural])


def load_fact(src: DataFrame, dims: dict[str, DataFrame],
              narrow_weather_key: bool = False) -> DataFrame:
    """Measures of the staging rows with the keys of all six dimensions.

    Date and carrier are required; the other four are optional. Every optional lookup uses
    the whole natural key of its dimension and the required ones a single member per key, so a
    fact never multiplies. `narrow_weather_key` joins weather on temperature, precipitation and
    condition only and so repeats facts whose weather is told apart by snow.
    """
    rows = event_attributes(status_attributes(weather_attributes(
        not_null(src, "Week_Date", "Carrier_Name"))))
    rows = _lookup(rows, dims["dim_date"], "Date_Key", ["Week_Date"], "inner", one_each=True)
    rows = _lookup(rows, dims["dim_carrier"], "Carrier_Key", ["Carrier_Name"], "inner", one_each=True)
    weather = NARROW_WEATHER_KEY if narrow_weather_key else WEATHER_KEY
    rows = _lookup(rows, dims["dim_weather"], "Weather_Key", weather, "left", null_safe=True)
    rows = _lookup(rows, dims["dim_status"], "COVID_Key", STATUS_KEY, "left", null_safe=True)
    rows = _lookup(rows, dims["dim_event"], "Event_Key", EVENT_KEY, "left")
    rows = _lookup(rows, dims["dim_service_type"], "Service_Type_Key", ["Service_Type"], "left")
    keyed = dense_key(rows, "Fact_Key", F.col("Date_Key"), ["Carrier_Key"], kind="bigint")
    return conform(keyed, FACT)


def with_load_stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("ETL_Load_Date", F.current_timestamp())


def star_read(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Fact with date, carrier and period; rows without a period drop out."""
    return (
        fact.select("Date_Key", "Carrier_Key", "COVID_Key", "Passenger_Departures",
                    "Bus_Departures", "Passengers_Per_Bus")
        .join(dims["dim_date"].select("Date_Key", "Year", "Month", "Quarter"), "Date_Key")
        .join(dims["dim_carrier"].select("Carrier_Key", "Carrier_Name"), "Carrier_Key")
        .join(dims["dim_status"].select("COVID_Key", "COVID_Period"), "COVID_Key")
        .select("Date_Key", "Year", "Month", "Quarter", "Carrier_Name", "COVID_Period",
                "Passenger_Departures", "Bus_Departures", "Passengers_Per_Bus"))
