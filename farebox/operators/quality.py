"""Data-quality checks. Each reads its table once, however many conditions it tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.constants import ROLLUP_CARRIER
from farebox.functions.calendar import date_key, date_key_from_parts
from farebox.functions.measures import mean_of_whole
from farebox.operators.dims import NARROW_WEATHER_KEY, weather_attributes
from farebox.operators.rows import union_frames

# Outcome texts of the checks.
PASS, FAIL, WARNING = "✓ PASS", "✗ FAIL", "⚠ WARNING"

TABLE_KINDS = {
    "dim_date": "Dimension", "dim_carrier": "Dimension", "dim_weather": "Dimension",
    "dim_status": "Dimension", "dim_event": "Dimension", "dim_service_type": "Dimension",
    "fact": "Fact",
}


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _as_rows(one_row: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    """One row per check of a one-row aggregate: (check name, column, status on failure)."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("Check_Type"), F.col(column).alias("Issue_Count"),
                 F.when(F.col(column) == 0, PASS).otherwise(bad).alias("Status"))
        for name, column, bad in checks])
    return one_row.select(F.inline(rows))


def row_count(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.agg(F.lit(name).alias("Table_Name"), F.count(F.lit(1)).alias("Row_Count"),
                  F.lit(kind).alias("Table_Type"))


def row_count_summary(source: DataFrame, dims: dict[str, DataFrame], fact: DataFrame,
                      summaries: dict[str, DataFrame] | None = None) -> DataFrame:
    counts = [row_count(source, "source", "Source")]
    counts += [row_count(df, name, TABLE_KINDS[name]) for name, df in dims.items()]
    counts.append(row_count(fact, "fact", TABLE_KINDS["fact"]))
    counts += [row_count(df, name, "Summary") for name, df in (summaries or {}).items()]
    return union_frames(*counts).orderBy("Table_Type", "Table_Name")


def staging_quality(staging: DataFrame) -> DataFrame:
    """Total rows, rows without date and without carrier, and the verdict."""
    counts = staging.agg(
        F.count(F.lit(1)).alias("Total_Rows"),
        _count_if(F.col("Week_Date").isNull()).alias("Null_Dates"),
        _count_if(F.col("Carrier_Name").isNull()).alias("Null_Carriers"))
    clean = (F.col("Null_Dates") == 0) & (F.col("Null_Carriers") == 0)
    return counts.withColumn("Status", F.when(clean, PASS).otherwise(WARNING))


def check_integrity(fact: DataFrame) -> DataFrame:
    one_row = fact.agg(
        _count_if(F.col("Date_Key").isNull() | F.col("Carrier_Key").isNull()).alias("no_key"),
        _count_if(F.col("Passenger_Departures") < 0).alias("passengers"),
        _count_if(F.col("Bus_Departures") < 0).alias("buses"))
    return _as_rows(one_row, [
        ("NULL Foreign Keys", "no_key", FAIL),
        ("Negative Passenger Counts", "passengers", WARNING),
        ("Negative Bus Counts", "buses", WARNING)])


def check_date_range(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    day = F.col("Week_Date")
    return (fact.select("Date_Key").join(dim_date.select("Date_Key", "Week_Date"), "Date_Key")
            .agg(F.min(day).alias("Earliest_Date"), F.max(day).alias("Latest_Date"),
                 F.datediff(F.max(day), F.min(day)).alias("Days_Covered"))
            .select(F.lit("Date Range").alias("Check_Type"), "*"))


def latest_records(fact: DataFrame, dims: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """The n most recent facts; equal dates order by carrier name."""
    return (
        fact.join(dims["dim_date"].select("Date_Key", "Week_Date", "Year"), "Date_Key")
        .join(dims["dim_carrier"].select("Carrier_Key", "Carrier_Name"), "Carrier_Key")
        .select("Week_Date", "Year", "Carrier_Name", "Bus_Departures", "Passenger_Departures",
                "Passengers_Per_Bus",
                F.col("Passenger_Recovery_Percent").try_cast("decimal(5,1)").alias("Recovery_Pct"))
        .orderBy(F.desc("Week_Date"), "Carrier_Name").limit(n))


def summary_statistics(fact: DataFrame) -> DataFrame:
    """Total, mean, least and greatest of both counts. `Average_Int` truncates as integer
    division does; `Average` keeps two digits."""
    measures = {"Passenger Departures": "Passenger_Departures", "Bus Departures": "Bus_Departures"}
    one_row = fact.agg(*[
        F.struct(F.sum(c).cast("bigint").alias("Total"),
                 mean_of_whole(F.sum(c), F.count(c)).alias("Average"),
                 F.try_divide(F.sum(c).cast("decimal(20,0)"), F.count(c).cast("decimal(20,0)"))
                 .cast("bigint").alias("Average_Int"),
                 F.min(c).alias("Minimum"), F.max(c).alias("Maximum")).alias(c)
        for c in measures.values()])
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("Metric"),
                 *[F.col(c)[f].alias(f) for f in ("Total", "Average", "Average_Int", "Minimum", "Maximum")])
        for label, c in measures.items()])))


FOREIGN_KEYS = {
    "Date_Key": "dim_date", "Carrier_Key": "dim_carrier", "Weather_Key": "dim_weather",
    "COVID_Key": "dim_status", "Event_Key": "dim_event", "Service_Type_Key": "dim_service_type",
}


def check_referential(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Fact keys without a dimension row. One pass: each dimension's distinct keys join left,
    then one aggregate counts the misses."""
    rows = fact.select(*FOREIGN_KEYS)
    for key, name in FOREIGN_KEYS.items():
        known = dims[name].select(F.col(key).alias(f"_k_{key}")).distinct()
        rows = rows.join(known, F.col(key) == F.col(f"_k_{key}"), "left")
    one_row = rows.agg(*[
        _count_if(F.col(key).isNotNull() & F.col(f"_k_{key}").isNull()).alias(key)
        for key in FOREIGN_KEYS])
    return _as_rows(one_row, [(f"{key} in {name}", key, FAIL) for key, name in FOREIGN_KEYS.items()])


UNIQUE_KEYS = {
    "dim_date": [["Date_Key"], ["Week_Date"]],
    "dim_carrier": [["Carrier_Key"], ["Carrier_Name"]],
    "dim_weather": [["Weather_Key"]],
    "dim_status": [["COVID_Key"]],
    "dim_event": [["Event_Key"]],
    "dim_service_type": [["Service_Type_Key"], ["Service_Type"]],
    "fact": [["Fact_Key"], ["Date_Key", "Carrier_Key"]],
    "monthly": [["Year", "Month", "Carrier_Name"]],
    "quarterly": [["Year", "Quarter"]],
    "period": [["COVID_Period"]],
    "performance": [["Carrier_Name"]],
}


def check_unique_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Repeated primary and natural keys of every given table.

    Each table is read once, its rows stacked as (check, key) for all its keys; one grouping counts them all,
    partial counts first. A key is its columns by name, so a missing value is a value of its own.
    """
    checks = [(name, keys) for name in tables for keys in UNIQUE_KEYS[name]]
    stacked = [
        df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("check"), F.to_json(F.struct(*keys)).alias("key"))
            for i, (table, keys) in enumerate(checks) if table == name])))
        for name, df in tables.items()]
    repeated = (union_frames(*stacked).groupBy("check", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .groupBy("check").agg(F.count(F.lit(1)).alias("found")))
    spark = next(iter(tables.values())).sparkSession
    every = spark.createDataFrame([(i, f"{name} ({', '.join(keys)})") for i, (name, keys) in enumerate(checks)],
                                  "check int, Check_Type string")
    count = F.coalesce("found", F.lit(0)).cast("bigint")
    return every.join(repeated, "check", "left").select(
        "Check_Type", count.alias("Issue_Count"), F.when(count == 0, PASS).otherwise(FAIL).alias("Status"))


def fact_fanout_check(src: DataFrame, dim_weather: DataFrame) -> DataFrame:
    """Rows a fact load would give when weather joins on temperature, precipitation and
    condition only. The dimension is counted per such key first, so nothing multiplies."""
    narrow = NARROW_WEATHER_KEY
    matches = (dim_weather.groupBy(*[F.col(c).alias(f"_d_{c}") for c in narrow])
               .agg(F.count(F.lit(1)).alias("Matches")))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in narrow])
    counted = (weather_attributes(src).select(*narrow).join(matches, on, "left")
               .agg(F.count(F.lit(1)).alias("Source_Rows"),
                    F.sum(F.coalesce("Matches", F.lit(1))).cast("bigint").alias("Joined_Rows")))
    return counted.withColumns({
        "Extra_Rows": F.col("Joined_Rows") - F.col("Source_Rows"),
        "Status": F.when(F.col("Joined_Rows") == F.col("Source_Rows"), PASS).otherwise(WARNING)})


def period_loss_check(fact: DataFrame, dim_status: DataFrame) -> DataFrame:
    """Facts that every summary loses because they have no period."""
    known = dim_status.select(F.col("COVID_Key").alias("_known")).distinct()
    lost = F.col("_known").isNull()
    return (
        fact.select("COVID_Key", "Passenger_Departures")
        .join(known, F.col("COVID_Key") == F.col("_known"), "left")
        .agg(F.count(F.lit(1)).alias("Fact_Rows"), _count_if(lost).alias("Lost_Rows"),
             F.coalesce(F.sum(F.when(lost, F.col("Passenger_Departures"))), F.lit(0))
             .cast("bigint").alias("Lost_Passengers"))
        .withColumn("Status", F.when(F.col("Lost_Rows") == 0, PASS).otherwise(WARNING)))


def date_key_conflicts(src: DataFrame) -> DataFrame:
    """Rows whose key from the date differs from the key from the stored year and month."""
    whole = date_key("Week_Date")
    parts = date_key_from_parts("Year", "Month", "Week_Date")
    return (src.agg(F.count(F.lit(1)).alias("Total_Rows"),
                    _count_if(F.col("Week_Date").isNull()).alias("Null_Keys"),
                    _count_if(~whole.eqNullSafe(parts)).alias("Conflicts"))
            .withColumn("Status", F.when(F.col("Conflicts") == 0, PASS).otherwise(FAIL)))


def rollup_reconciliation(rows: DataFrame) -> DataFrame:
    """Per week: the roll-up row beside the sum of its members."""
    rollup = F.col("Carrier_Name").eqNullSafe(F.lit(ROLLUP_CARRIER))

    def total(column: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("bigint")

    return (
        rows.groupBy("Week_Date")
        .agg(total("Passenger_Departures", rollup).alias("Rollup_Passengers"),
             total("Passenger_Departures", ~rollup).alias("Member_Passengers"),
             total("Bus_Departures", rollup).alias("Rollup_Buses"),
             total("Bus_Departures", ~rollup).alias("Member_Buses"))
        .withColumn("Status", F.when(
            (F.col("Rollup_Passengers") == F.col("Member_Passengers"))
            & (F.col("Rollup_Buses") == F.col("Member_Buses")), PASS).otherwise(FAIL)))
