"""Baseline, recovery and trend columns over the weekly series of each carrier.

Every function expects one row per week and carrier, so a window partition holds at most
one row per week whatever the size of the raw feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from farebox.constants import BASELINE_YEAR
from farebox.functions.measures import mean_of_whole, passengers_per_bus, percent_of, ratio

MEASURES = {"Bus": "Bus_Departures", "Passenger": "Passenger_Departures"}


def weekly_grain(df: DataFrame) -> DataFrame:
    """Sum a raw feed to one row per week, carrier and service type (partial sums first)."""
    return (
        df.groupBy("Week_Date", "Carrier_Name", "Carrier_Full_Name", "Service_Type")
        .agg(F.sum("Bus_Departures").alias("Bus_Departures"),
             F.sum("Passenger_Departures").alias("Passenger_Departures")))


def one_row_per_week(df: DataFrame) -> DataFrame:
    """Rows of one week and carrier as one: measures summed, the largest of every other column.

    The trend columns need this grain. Sums of decimals do not depend on the order of the rows; a week without
    a known value stays unknown. Rows without date or carrier belong to no series and stay as they are.
    """
    keys, measures = ["Week_Date", "Carrier_Name"], list(MEASURES.values())
    known = F.col("Week_Date").isNotNull() & F.col("Carrier_Name").isNotNull()
    kinds = dict(df.dtypes)
    summed = [F.sum(F.col(c).cast("decimal(30,6)")).cast(kinds[c]).alias(c) for c in measures]
    rest = [F.max(f"`{c}`").alias(c) for c in df.columns if c not in keys + measures]
    grouped = df.where(known).groupBy(*keys).agg(*summed, *rest).select(*[F.col(f"`{c}`") for c in df.columns])
    return grouped.unionByName(df.where(~known))


def series_window(carrier: str = "Carrier_Name") -> WindowSpec:
    return Window.partitionBy(carrier).orderBy("Week_Date")


def baseline_attach(df: DataFrame, baseline_year: int = BASELINE_YEAR) -> DataFrame:
    """Baseline-year buses and passengers of the same carrier and ISO week; NULL where absent.

    A window over (carrier, ISO week) replaces the self-join, so the input is read once.
    """
    same_week = Window.partitionBy("Carrier_Name", "Week_of_Year")

    def base(column: str) -> Column:
        return F.sum(F.when(F.col("Year") == baseline_year, F.col(column))).over(same_week)

    return df.withColumns({
        "Baseline_2019_Buses": base("Bus_Departures").cast("bigint"),
        "Baseline_2019_Passengers": base("Passenger_Departures").cast("bigint"),
    })


def recovery_percent(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "Bus_Recovery_Percent": percent_of("Bus_Departures", "Baseline_2019_Buses"),
        "Passenger_Recovery_Percent": percent_of("Passenger_Departures", "Baseline_2019_Passengers"),
    })


def wow_change(df: DataFrame) -> DataFrame:
    """Change against the carrier's previous row: difference, and percent of that row."""
    w = series_window()
    columns = {}
    for short, name in MEASURES.items():
        change = F.col(name) - F.lag(name).over(w)
        columns[f"{short}_WoW_Change"] = change.cast("decimal(20,2)")
        columns[f"{short}_WoW_Percent"] = ratio(
            change.cast("decimal(20,0)") * 100, F.lag(name).over(w).cast("decimal(20,0)"))
    return df.withColumns(columns)


def moving_average(df: DataFrame, weeks: int, calendar: bool = False) -> DataFrame:
    """Mean of the last `weeks` rows of the carrier, or of the last `weeks` calendar weeks."""
    if calendar:
        w = (Window.partitionBy("Carrier_Name").orderBy(F.unix_date("Week_Date"))
             .rangeBetween(-7 * (weeks - 1), 0))
    else:
        w = series_window().rowsBetween(-(weeks - 1), 0)
    return df.withColumns({
        f"{short}_{weeks}wk_MA": mean_of_whole(F.sum(name).over(w), F.count(name).over(w))
        for short, name in MEASURES.items()})


def with_trends(df: DataFrame, baseline_year: int = BASELINE_YEAR, calendar: bool = False) -> DataFrame:
    """All derived measures of the staging table."""
    df = df.withColumn("Passengers_Per_Bus", passengers_per_bus("Passenger_Departures", "Bus_Departures"))
    df = recovery_percent(baseline_attach(df, baseline_year))
    df = moving_average(moving_average(wow_change(df), 4, calendar), 12, calendar)
    return df.drop("Bus_WoW_Percent", "Passenger_WoW_Percent")
