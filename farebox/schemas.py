"""Declared schemas of the tables.

Counts are BIGINT and two-digit measures DECIMAL(20,2): weekly sums outgrow INT and
DECIMAL(10,2) long before the input reaches cluster size, and Spark's ANSI mode would fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, LONG, STR, DATE, DBL, BOOL = (
    T.IntegerType(), T.LongType(), T.StringType(), T.DateType(), T.DoubleType(), T.BooleanType(),
)
MEASURE = T.DecimalType(20, 2)
WEATHER = T.DecimalType(5, 2)


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


SHEET_GRID = _struct(
    ("sheet", STR), ("year", INT), ("row_idx", INT), ("col_idx", INT), ("value", STR))

CONSOLIDATED = _struct(
    ("Carrier_Name", STR), ("Carrier_Full_Name", STR), ("Service_Type", STR),
    ("Week_Label", STR), ("Week_Date", DATE), ("Year", INT), ("Month", INT),
    ("Month_Name", STR), ("Week_of_Year", INT), ("Quarter", INT), ("Season", STR),
    ("Fiscal_Year", INT), ("Day_of_Week", STR),
    ("Bus_Departures", DBL), ("Passenger_Departures", DBL), ("Passengers_Per_Bus", DBL),
    ("Baseline_2019_Buses", DBL), ("Baseline_2019_Passengers", DBL),
    ("Bus_Recovery_Percent", DBL), ("Passenger_Recovery_Percent", DBL),
    ("Avg_Temp_F", DBL), ("Precipitation_Inches", DBL), ("Snow_Inches", DBL),
    ("Weather_Condition", STR), ("Major_Weather_Event", STR), ("Status", STR),
    ("Is_Holiday", BOOL), ("Is_Summer_Peak", BOOL), ("Is_Holiday_Season", BOOL),
    ("Is_Severe_Weather", BOOL), ("Is_Snow_Week", BOOL), ("Is_Hot_Week", BOOL),
    ("Is_Cold_Week", BOOL), ("Notes", STR))

STAGING = _struct(
    ("Week_Date", DATE), ("Year", INT), ("Quarter", INT), ("Month", INT), ("Month_Name", STR),
    ("Week_of_Year", INT), ("Season", STR),
    ("Carrier_Name", STR), ("Carrier_Full_Name", STR), ("Service_Type", STR),
    ("Bus_Departures", LONG), ("Passenger_Departures", LONG), ("Passengers_Per_Bus", MEASURE),
    ("Baseline_2019_Buses", LONG), ("Baseline_2019_Passengers", LONG),
    ("Bus_Recovery_Percent", MEASURE), ("Passenger_Recovery_Percent", MEASURE),
    ("Bus_WoW_Change", MEASURE), ("Passenger_WoW_Change", MEASURE),
    ("Bus_4wk_MA", MEASURE), ("Passenger_4wk_MA", MEASURE),
    ("Bus_12wk_MA", MEASURE), ("Passenger_12wk_MA", MEASURE),
    ("Avg_Temp_F", WEATHER), ("Precipitation_Inches", WEATHER), ("Snow_Inches", WEATHER),
    ("Weather_Condition", STR), ("Is_Severe_Weather", STR),
    ("COVID_Period", STR), ("Economic_Period", STR), ("Is_COVID_Period", STR),
    ("Is_High_Inflation", STR), ("Days_Since_Pandemic_Start", INT),
    ("Is_Holiday", STR), ("Is_Tourism_Peak", STR), ("NYC_Event", STR))

LOAD_STAMP = T.StructField("ETL_Load_Date", T.TimestampType(), True)

DIM_DATE = _struct(
    ("Date_Key", INT), ("Week_Date", DATE), ("Year", INT), ("Quarter", INT), ("Month", INT),
    ("Month_Name", STR), ("Week_of_Year", INT), ("Season", STR),
    ("Is_Holiday", INT), ("Is_Tourism_Peak", INT))
DIM_CARRIER = _struct(("Carrier_Key", INT), ("Carrier_Name", STR), ("Carrier_Full_Name", STR))
DIM_WEATHER = _struct(
    ("Weather_Key", INT), ("Avg_Temp_F", WEATHER), ("Precipitation_Inches", WEATHER),
    ("Snow_Inches", WEATHER), ("Weather_Condition", STR), ("Is_Severe_Weather", INT))
DIM_STATUS = _struct(
    ("COVID_Key", INT), ("COVID_Period", STR), ("Economic_Period", STR),
    ("Is_COVID_Period", INT), ("Is_High_Inflation", INT), ("Days_Since_Pandemic_Start", INT))
DIM_EVENT = _struct(
    ("Event_Key", INT), ("Is_Holiday", INT), ("NYC_Event", STR), ("Is_Tourism_Peak", INT))
DIM_SERVICE_TYPE = _struct(
    ("Service_Type_Key", INT), ("Service_Type", STR), ("Service_Description", STR))

FACT_MEASURES = [
    "Bus_Departures", "Passenger_Departures", "Passengers_Per_Bus",
    "Baseline_2019_Buses", "Baseline_2019_Passengers",
    "Bus_Recovery_Percent", "Passenger_Recovery_Percent",
    "Bus_WoW_Change", "Passenger_WoW_Change",
    "Bus_4wk_MA", "Passenger_4wk_MA", "Bus_12wk_MA", "Passenger_12wk_MA",
]
FACT = T.StructType(
    [T.StructField("Fact_Key", LONG, True)]
    + [T.StructField(k, INT, True) for k in (
        "Date_Key", "Carrier_Key", "Weather_Key", "COVID_Key", "Event_Key", "Service_Type_Key")]
    + [STAGING[m] for m in FACT_MEASURES])

MONTHLY_SUMMARY = _struct(
    ("Year", INT), ("Month", INT), ("Carrier_Name", STR), ("Total_Passengers", LONG),
    ("Total_Buses", LONG), ("Avg_Passengers_Per_Bus", MEASURE))
QUARTERLY_SUMMARY = _struct(
    ("Year", INT), ("Quarter", INT), ("Total_Passengers", LONG), ("Total_Buses", LONG),
    ("Avg_Passengers_Per_Bus", MEASURE), ("Unique_Carriers", LONG))
PERIOD_SUMMARY = _struct(
    ("COVID_Period", STR), ("Total_Passengers", LONG), ("Avg_Weekly_Passengers", MEASURE),
    ("Total_Weeks", LONG))
CARRIER_PERFORMANCE = _struct(
    ("Carrier_Name", STR), ("Total_Passengers", LONG), ("Total_Buses", LONG),
    ("Avg_Passengers_Per_Bus", MEASURE))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns, in order and cast; extra columns are dropped."""
    return df.selectExpr(*[
        f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema])


def ensure_column(df: DataFrame, name: str, kind: T.DataType | str) -> DataFrame:
    """Add a NULL column unless the frame already has it."""
    present = {c.lower() for c in df.columns}
    return df if name.lower() in present else df.withColumn(name, F.lit(None).cast(kind))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Column mapping of a sink: source name -> target name; the rest stays."""
    return df.select([F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def as_text_flag(condition: Column) -> Column:
    """'True' / 'False' text, as the flat file carries its flags; NULL counts as false."""
    return F.when(condition, "True").otherwise("False")
