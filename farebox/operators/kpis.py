"""Headline indicators computed from the data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.functions.measures import mean_of_whole, percent_of, ratio
from farebox.operators.keys import dense_key
from farebox.operators.rows import members_only


def recovery_status(src: DataFrame, baseline_year: int, include_rollup_rows: bool = False) -> DataFrame:
    """Baseline year and latest year side by side, in one pass over two years' rows.

    `*_Weekly_Avg` is the mean per carrier-week and `*_True_Weekly_Avg` per calendar week.
    `Recovery_Percent` sets the latest year to date against the whole baseline year,
    `Recovery_Percent_Same_Weeks` against the ISO weeks the latest year has reached.
    """
    rows = members_only(src, include_rollup_rows)
    latest_year = rows.select(F.max("Year")).scalar()
    rows = rows.withColumn("latest_year", latest_year)
    base, latest = F.col("Year") == baseline_year, F.col("Year") == F.col("latest_year")
    weekly = (
        rows.where(base | latest).groupBy("Year", "latest_year", "Week_of_Year", "Week_Date")
        .agg(F.sum("Passenger_Departures").alias("passengers"),
             F.count("Passenger_Departures").alias("known")))
    same_week = Window.partitionBy("Week_of_Year")
    weekly = weekly.withColumn("reached", F.max(latest.cast("int")).over(same_week) == 1)

    def figures(condition: Column, name: str) -> list[Column]:
        total = F.sum(F.when(condition, F.col("passengers")))
        return [
            F.coalesce(total, F.lit(0)).cast("bigint").alias(f"{name}_Total"),
            mean_of_whole(total, F.sum(F.when(condition, F.col("known")))).alias(f"{name}_Weekly_Avg"),
            mean_of_whole(total, F.count(F.when(condition, F.col("Week_Date")))).alias(
                f"{name}_True_Weekly_Avg")]

    one_row = weekly.agg(
        F.max("latest_year").alias("Latest_Year"), *figures(base, "Baseline"), *figures(latest, "Latest"),
        F.sum(F.when(base & F.col("reached"), F.col("passengers"))).alias("_same"))
    carriers = rows.where(base).select(F.countDistinct("Carrier_Name")).scalar()
    return one_row.withColumns({
        "Baseline_Carriers": carriers,
        "Recovery_Percent": percent_of("Latest_Total", "Baseline_Total"),
        "Recovery_Percent_Same_Weeks": percent_of("Latest_Total", "_same"),
    }).drop("_same")


def period_decline(src: DataFrame, before: str, after: str, include_rollup_rows: bool = False) -> DataFrame:
    """Percent change of mean weekly passengers from one period to another."""
    rows = members_only(src, include_rollup_rows)

    def weekly_mean(period: str) -> Column:
        inside = F.col("COVID_Period") == period
        return mean_of_whole(F.sum(F.when(inside, F.col("Passenger_Departures"))),
                             F.countDistinct(F.when(inside, F.col("Week_Date"))))

    means = rows.where(F.col("COVID_Period").isin(before, after)).agg(
        weekly_mean(before).alias("Before_Weekly_Avg"), weekly_mean(after).alias("After_Weekly_Avg"))
    change = (F.col("After_Weekly_Avg") - F.col("Before_Weekly_Avg")) * 100
    return means.select(
        F.lit(before).alias("Before_Period"), F.lit(after).alias("After_Period"), "*",
        ratio(change, F.col("Before_Weekly_Avg")).alias("Change_Percent"))


def _quarterly(src: DataFrame, keys: list[str]) -> DataFrame:
    return src.groupBy(*keys, "Year", "Quarter").agg(
        F.sum("Passenger_Departures").cast("bigint").alias("Passengers"))


def _recovered(quarters: DataFrame, keys: list[str], baseline_year: int, since: date) -> DataFrame:
    """First quarter from `since` on whose passengers reach the mean baseline quarter."""
    per_series = Window.partitionBy(*keys)
    base = F.col("Year") == baseline_year
    level = mean_of_whole(F.sum(F.when(base, F.col("Passengers"))).over(per_series),
                          F.count(F.when(base, 1)).over(per_series))
    number = F.col("Year") * 4 + F.col("Quarter") - 1
    start = since.year * 4 + (since.month - 1) // 3
    reached = (number >= start) & (F.col("Passengers") >= F.col("Baseline_Quarter"))
    return (
        quarters.withColumn("Baseline_Quarter", level)
        .groupBy(*keys, "Baseline_Quarter")
        .agg(F.min(F.when(reached, number)).alias("_q"),
             F.min_by("Passengers", F.when(reached, number)).alias("Passengers"))
        .withColumns({
            "Recovery_Year": F.floor(F.col("_q") / 4).cast("int"),
            "Recovery_Quarter": (F.col("_q") % 4 + 1).cast("int")}))


def recovery_quarter(src: DataFrame, baseline_year: int, since: date,
                     include_rollup_rows: bool = False) -> DataFrame:
    """First quarter at or above the mean quarter of the baseline year; NULL if none is."""
    quarters = _quarterly(members_only(src, include_rollup_rows), []).withColumn("_all", F.lit(1))
    return _recovered(quarters, ["_all"], baseline_year, since).drop("_all", "_q")


def carrier_recovery_speed(src: DataFrame, baseline_year: int, since: date,
                           include_rollup_rows: bool = False) -> DataFrame:
    """Carriers by the quarter in which they regained their own baseline, then by name;
    carriers that have not come last."""
    quarters = _quarterly(members_only(src, include_rollup_rows), ["Carrier_Name"])
    speed = _recovered(quarters, ["Carrier_Name"], baseline_year, since)
    ranked = dense_key(speed, "Speed_Rank", F.coalesce("_q", F.lit(2147483647)), ["Carrier_Name"])
    return ranked.drop("_q")


def carrier_leaders(performance: DataFrame) -> DataFrame:
    """The carrier with the highest mean load and the one with the most passengers; equal
    values go to the first name, carriers without a value to nobody."""
    def lead(column: str) -> Column:
        order = F.when(F.col(column).isNotNull(), F.struct(-F.col(column), F.col("Carrier_Name")))
        return F.min_by(F.struct("Carrier_Name", F.col(column).alias("v")), order)

    top = performance.agg(lead("Avg_Passengers_Per_Bus").alias("e"), lead("Total_Passengers").alias("t"))
    return top.select(
        F.col("e.Carrier_Name").alias("Most_Efficient"),
        F.col("e.v").alias("Avg_Passengers_Per_Bus"),
        F.col("t.Carrier_Name").alias("Largest"),
        F.col("t.v").alias("Total_Passengers"))


def carrier_yoy(src: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    """Passengers per carrier and year, with growth over the calendar year before."""
    w = Window.partitionBy("Carrier_Name").orderBy("Year")
    yearly = (members_only(src, include_rollup_rows).groupBy("Carrier_Name", "Year")
              .agg(F.sum("Passenger_Departures").cast("bigint").alias("Passengers")))
    previous = F.when(F.lag("Year").over(w) == F.col("Year") - 1, F.lag("Passengers").over(w))
    return (
        yearly.withColumn("Previous_Passengers", previous)
        .withColumn("Growth_Percent", ratio(
            (F.col("Passengers") - F.col("Previous_Passengers")).cast("decimal(20,0)") * 100,
            F.col("Previous_Passengers").cast("decimal(20,0)"))))
