"""The four summary tables, carrier ranking and carrier-by-year pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.functions.measures import mean_of_measure, mean_of_whole, ratio
from farebox.operators.keys import dense_key
from farebox.operators.rows import members_only


def _totals() -> list[Column]:
    return [F.sum("Passenger_Departures").cast("bigint").alias("Total_Passengers"),
            F.sum("Bus_Departures").cast("bigint").alias("Total_Buses")]


def _mean_ratio() -> Column:
    return mean_of_measure(F.sum("Passengers_Per_Bus"), F.count("Passengers_Per_Bus")).alias(
        "Avg_Passengers_Per_Bus")


def _ratio_of_sums() -> Column:
    return ratio(F.sum("Passenger_Departures").cast("decimal(20,0)"),
                 F.sum("Bus_Departures").cast("decimal(20,0)")).alias("Weighted_Passengers_Per_Bus")


def monthly_carrier_summary(star: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    return (members_only(star, include_rollup_rows)
            .groupBy("Year", "Month", "Carrier_Name")
            .agg(*_totals(), _mean_ratio(), _ratio_of_sums()))


def quarterly_summary(star: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    return (members_only(star, include_rollup_rows)
            .groupBy("Year", "Quarter")
            .agg(*_totals(), _mean_ratio(), _ratio_of_sums(),
                 F.countDistinct("Carrier_Name").alias("Unique_Carriers")))


def carriers_by_sketch(star: DataFrame, size: int = 14, include_rollup_rows: bool = False) -> DataFrame:
    """Distinct carriers per quarter twice: from sketches of the months, merged, and exactly.

    A month's sketch has at most 2^size counters however many carriers it saw, and sketches that are kept can be merged
    to any longer stretch without the rows. Its relative error is about 1.04 / sqrt(2^size), 0.8 % by default.
    """
    rows = members_only(star, include_rollup_rows)
    months = rows.groupBy("Year", "Quarter", "Month").agg(F.hll_sketch_agg("Carrier_Name", size).alias("sketch"))
    merged = months.groupBy("Year", "Quarter").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("Carriers_Estimate"))
    exact = (rows.where(F.col("Carrier_Name").isNotNull()).select("Year", "Quarter", "Carrier_Name").distinct()
             .groupBy("Year", "Quarter").agg(F.count(F.lit(1)).alias("Unique_Carriers")))
    return merged.join(exact, ["Year", "Quarter"])


def period_impact_summary(star: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    """`Total_Weeks` counts carrier-weeks and `Avg_Weekly_Passengers` is the mean of one;
    `Distinct_Weeks` and `Avg_Passengers_Per_Week` speak of calendar weeks."""
    total, count = F.sum("Passenger_Departures"), F.count("Passenger_Departures")
    weeks = F.countDistinct("Date_Key")
    return (members_only(star, include_rollup_rows)
            .groupBy("COVID_Period")
            .agg(total.cast("bigint").alias("Total_Passengers"),
                 mean_of_whole(total, count).alias("Avg_Weekly_Passengers"),
                 count.alias("Total_Weeks"),
                 weeks.alias("Distinct_Weeks"),
                 mean_of_whole(total, weeks).alias("Avg_Passengers_Per_Week")))


def carrier_performance(star: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    return (members_only(star, include_rollup_rows)
            .groupBy("Carrier_Name")
            .agg(*_totals(), _mean_ratio(), _ratio_of_sums()))


def rank_performance(performance: DataFrame) -> DataFrame:
    """Rank by mean passengers per bus, highest first; equal means rank by name."""
    ranked = dense_key(performance, "Performance_Rank", F.col("Avg_Passengers_Per_Bus"),
                       ["Carrier_Name"], descending=True)
    return ranked.select(*performance.columns, "Performance_Rank")


def top_performers(ranked: DataFrame, n: int = 5) -> DataFrame:
    return (ranked.select("Performance_Rank", "Carrier_Name", "Total_Passengers",
                          "Avg_Passengers_Per_Bus")
            .orderBy("Performance_Rank").limit(n))


_SETS = {
    "monthly": ["Year", "Month", "Carrier_Name"],
    "quarterly": ["Year", "Quarter"],
    "period": ["COVID_Period"],
    "carrier": ["Carrier_Name"],
}
_SET_KEYS = ["Year", "Month", "Quarter", "COVID_Period", "Carrier_Name"]


def summary_grouping_sets(star: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    """All four summaries in one pass over the star, told apart by `Summary`."""
    present = F.lit(0)
    for position, name in enumerate(_SET_KEYS):
        present = present + (1 - F.grouping(name).cast("int")) * (2 ** position)
    codes = {name: sum(2 ** _SET_KEYS.index(c) for c in columns) for name, columns in _SETS.items()}
    summary = F
    for name, code in codes.items():
        summary = summary.when(F.col("_code") == code, name)
    total, count = F.sum("Passenger_Departures"), F.count("Passenger_Departures")
    return (
        members_only(star, include_rollup_rows)
        .groupingSets([[F.col(c) for c in columns] for columns in _SETS.values()],
                      *[F.col(c) for c in _SET_KEYS])
        .agg(present.alias("_code"), *_totals(), _mean_ratio(),
             mean_of_whole(total, count).alias("Avg_Weekly_Passengers"),
             count.alias("Total_Weeks"),
             F.countDistinct("Carrier_Name").alias("Unique_Carriers"))
        .withColumn("Summary", summary)
        .drop("_code"))


def carrier_year_pivot(df: DataFrame, carriers: list[str], value: str = "Projected_Passengers",
                       carrier: str = "Carrier") -> DataFrame:
    """Years down, carriers across. The carrier list is given, so no extra job looks it up."""
    return df.groupBy("Year").pivot(carrier, carriers).agg(F.sum(value))
