"""Weekly rows derived from the order-line tables (FIXTURES.md section 5).

The supplier's nation plays the carrier, the order lines its departures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.constants import (
    FIXTURE_BASELINE_YEAR, FIXTURE_REFERENCE_DATE, ROLLUP_CARRIER, ROLLUP_SERVICE_TYPE)
from farebox.functions.calendar import (
    days_since, label_year, week_friday, week_label, with_date_parts)
from farebox.functions.measures import classify
from farebox.operators.trends import with_trends
from farebox.schemas import STAGING, as_text_flag, conform

PERIOD_STARTS = [("1997-01-01", "During"), ("1998-07-01", "Recovery"), ("2000-01-01", "Post"),
                 ("2001-10-01", None)]
PERIOD_BEFORE = "Pre"
ECONOMIC_STARTS = [("2000-01-01", "High")]
ECONOMIC_BEFORE = "Stable"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def weekly_departures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per week and nation: distinct orders as buses, quantity as passengers.

    Only four columns of the order lines are read. Lines meet the supplier table alone, on
    its key; Spark broadcasts suppliers if their measured size allows and otherwise shuffles
    with runtime splitting of skewed suppliers. Lines then aggregate by (week, nation, order)
    before (week, nation), so neither a hot nation nor a hot order gathers in one task.
    Names come in after the aggregation.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_quantity", week_friday("l_shipdate").alias("Week_Date"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, folder, "region").select("r_regionkey", "r_name")
    weekly = (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .groupBy("Week_Date", "s_nationkey")
        .agg(F.countDistinct("l_orderkey").alias("Bus_Departures"),
             F.round(F.sum("l_quantity")).cast("bigint").alias("Passenger_Departures")))
    return (
        weekly.join(nations, weekly.s_nationkey == nations.n_nationkey)
        .join(regions, nations.n_regionkey == regions.r_regionkey)
        .select("Week_Date", F.col("n_name").alias("Carrier_Name"),
                F.concat("n_name", F.lit(" Lines")).alias("Carrier_Full_Name"),
                F.col("r_name").alias("Service_Type"), "Bus_Departures", "Passenger_Departures"))


def with_context(weekly: DataFrame) -> DataFrame:
    """Calendar, weather, period and event columns of the week."""
    df = with_date_parts(weekly)
    week, month, day = F.col("Week_of_Year"), F.col("Month"), F.col("Week_Date")
    wet = (week * 7) % 10
    snow = F.when(month.isin(12, 1, 2), week % 3 + 1).otherwise(0)
    period = classify(day, PERIOD_STARTS, PERIOD_BEFORE)
    economic = classify(day, ECONOMIC_STARTS, ECONOMIC_BEFORE)
    return df.withColumns({
        "Avg_Temp_F": (30 + (week * 13) % 61).cast("decimal(5,2)"),
        "Precipitation_Inches": (wet.cast("decimal(5,2)") / 10).cast("decimal(5,2)"),
        "Snow_Inches": snow.cast("decimal(5,2)"),
        "Weather_Condition": F.when(week % 11 == 0, None).when(wet >= 7, "Rain").otherwise("Normal"),
        "Is_Severe_Weather": as_text_flag(snow >= 3),
        "COVID_Period": period,
        "Economic_Period": economic,
        "Is_COVID_Period": as_text_flag(period == "During"),
        "Is_High_Inflation": as_text_flag(economic == "High"),
        "Days_Since_Pandemic_Start": days_since(day, FIXTURE_REFERENCE_DATE),
        "Is_Holiday": as_text_flag(week.isin(1, 27, 47, 52)),
        "Is_Tourism_Peak": as_text_flag(month.isin(7, 8, 12)),
        "NYC_Event": F.when(week == 47, "Parade").when(week == 1, "New Year"),
    })


def staging_rows(weekly: DataFrame, baseline_year: int = FIXTURE_BASELINE_YEAR) -> DataFrame:
    """The 36 staging columns of weekly departures."""
    return conform(with_trends(with_context(weekly), baseline_year), STAGING)


# ---- inputs rendered from the staging rows -------------------------------------------

def with_rollup_rows(staging: DataFrame) -> DataFrame:
    """Staging rows plus one row per week that sums its members."""
    rows = staging.select("Week_Date", "Carrier_Name", "Service_Type",
                          "Bus_Departures", "Passenger_Departures")
    totals = rows.groupBy("Week_Date").agg(
        F.lit(ROLLUP_CARRIER).alias("Carrier_Name"),
        F.lit(ROLLUP_SERVICE_TYPE).alias("Service_Type"),
        F.sum("Bus_Departures").alias("Bus_Departures"),
        F.sum("Passenger_Departures").alias("Passenger_Departures"))
    return rows.unionByName(totals)


def with_week_label(staging: DataFrame) -> DataFrame:
    return staging.withColumns({
        "Week_Label": week_label("Week_Date"), "Label_Year": label_year("Week_Date")})


def sheet_grid(staging: DataFrame) -> DataFrame:
    """The staging rows as one sheet per week: a title, a heading row, one row per carrier."""
    labelled = with_week_label(staging).select(
        F.col("Week_Label").alias("sheet"), F.col("Label_Year").alias("year"),
        "Week_Date", "Carrier_Name", "Bus_Departures", "Passenger_Departures")
    by_carrier = Window.partitionBy("sheet", "year").orderBy("Carrier_Name")
    rows = labelled.withColumn("row_idx", F.row_number().over(by_carrier) + 2)

    def cell(row: Column, position: int, value: Column) -> Column:
        return F.struct(row.cast("int").alias("row_idx"), F.lit(position).alias("col_idx"),
                        value.cast("string").alias("value"))

    data = F.array(cell(F.col("row_idx"), 0, F.col("Carrier_Name")),
                   cell(F.col("row_idx"), 1, F.col("Bus_Departures")),
                   cell(F.col("row_idx"), 2, F.col("Passenger_Departures")))
    top = F.array(cell(F.lit(0), 0, F.lit("Weekly departures")),
                  cell(F.lit(2), 0, F.lit("Carrier")),
                  cell(F.lit(2), 1, F.lit("Total Bus Departures")),
                  cell(F.lit(2), 2, F.lit("Total Passenger Departures")))
    first = F.col("row_idx") == 3
    cells = F.when(first, F.concat(top, data)).otherwise(data)
    return rows.select("sheet", "year", F.inline(cells))


#: Of nine sheets in a row, which is faulty in what way.
FAULTS = {"no header": 0, "no carrier column": 1, "no measure column": 2, "label": 3, "number": 4}


def faulty_grid(staging: DataFrame) -> DataFrame:
    """`sheet_grid` with faults in five of nine sheets: only a title, no names, a heading renamed, a label
    that cannot be parsed, a number that is none."""
    kinds = with_week_label(staging).select(
        F.col("Week_Label").alias("sheet"), F.col("Label_Year").alias("year"),
        F.pmod(F.floor(F.unix_date("Week_Date") / 7), F.lit(9)).alias("kind")).distinct()
    row, col = F.col("row_idx"), F.col("col_idx")

    def has(fault: str) -> Column:
        return F.col("kind") == FAULTS[fault]

    return (
        sheet_grid(staging).join(kinds, ["sheet", "year"])
        .where(~(has("no header") & (row >= 2)) & ~(has("no carrier column") & (row > 2) & (col == 0)))
        .withColumn("value", F.when(has("no measure column") & (row == 2) & (col == 2), "People")
                    .when(has("number") & (row == 3) & (col == 1), "n/a").otherwise(F.col("value")))
        .withColumn("sheet", F.when(has("label"), F.replace("sheet", F.lit("-"), F.lit(" to "))).otherwise(F.col("sheet")))
        .drop("kind"))


def quarter_periods(staging: DataFrame) -> DataFrame:
    """A period per quarter: in even years each runs on into the next, in odd ones there are gaps; the first is open."""
    quarters = staging.select("Year", "Quarter").distinct()
    first = F.make_date("Year", F.col("Quarter") * 3 - 2, F.lit(1))
    begins = F.when(first > staging.select(F.min("Week_Date")).scalar(), first)
    return quarters.select(begins.alias("first"), F.date_add(first, F.when(F.col("Year") % 2 == 0, 100).otherwise(80)).alias("last"),
                           F.concat_ws("-Q", "Year", "Quarter").alias("label"))


def conflicting_staging(staging: DataFrame) -> DataFrame:
    """Staging rows of which some weeks and carriers contradict themselves."""
    odd = (F.col("Year") == 1996) & (F.col("Week_of_Year") % 2 == 1)
    return staging.withColumns({
        "Carrier_Full_Name": F.when(odd & F.col("Carrier_Name").endswith("3"), F.concat("Carrier_Name", F.lit(" Bus")))
        .otherwise(F.col("Carrier_Full_Name")),
        "Is_Holiday": F.when((F.col("Week_of_Year") == 10) & F.col("Carrier_Name").endswith("7"), "True")
        .otherwise(F.col("Is_Holiday"))})


def order_feed(spark: SparkSession, folder: str) -> DataFrame:
    """A second feed without passengers: orders per week and priority."""
    orders = table(spark, folder, "orders")
    return (orders.groupBy(week_friday("o_orderdate").alias("Week_Date"),
                           F.col("o_orderpriority").alias("Carrier_Name"))
            .agg(F.count(F.lit(1)).alias("Bus_Departures"))
            .withColumn("Feed", F.lit("orders")))


def event_feed(spark: SparkSession, folder: str) -> DataFrame:
    """A third feed without buses: events per week and type."""
    events = table(spark, folder, "events")
    return (events.groupBy(week_friday("ts").alias("Week_Date"),
                           F.col("event_type").alias("Carrier_Name"))
            .agg(F.count(F.lit(1)).alias("Passenger_Departures"))
            .withColumn("Feed", F.lit("events")))
