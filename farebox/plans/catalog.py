"""Every query by name: (session, input folder) -> DataFrame.

Inputs are the order-line tables of the folder, or the staging, dimension and fact tables
that Spark derives from them (`landing`). Decimals leave as doubles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.constants import (
    FIXTURE_BASELINE_YEAR, FIXTURE_REFERENCE_DATE, ROLLUP_CARRIER,
    SERVICE_SUFFIX_SHORT)
from farebox.functions import calendar, measures
from farebox.operators import (
    additive, dims, fact, features, forecast, kpis, periods, quality, rows, summaries, trends)
from farebox.plans import landing
from farebox.session import shared_dir
from farebox.sources import readers, sheets, sinks, versions, weekly_feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIES = ["Carrier_Name", "Week_Date"]


def query(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return measures.plain(build(spark, folder))

    QUERIES[build.__name__] = run
    return run


def _src(spark: SparkSession, folder: str) -> DataFrame:
    return landing.staging(spark, folder)


def _star(spark: SparkSession, folder: str) -> DataFrame:
    _, tables, facts = landing.warehouse(spark, folder)
    return fact.star_read(facts, tables)


def _consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """The staging rows as the consolidated table would hold them."""
    labelled = weekly_feed.with_week_label(_src(spark, folder)).select(
        "Carrier_Name", "Carrier_Full_Name", "Service_Type", "Week_Label", "Week_Date",
        F.col("Bus_Departures").cast("double").alias("Bus_Departures"),
        F.col("Passenger_Departures").cast("double").alias("Passenger_Departures"))
    return sheets.project_consolidated(labelled)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written result, so that frames read from an earlier one stay valid."""
    shared = shared_dir(spark)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared}/farebox/{spark.sparkContext.applicationId}/sinks/{name}-{uuid.uuid4().hex[:12]}"


def _names(spark: SparkSession, folder: str) -> list[str]:
    """The carriers' names, one per nation: column names and search words have to be known ahead."""
    listed = weekly_feed.table(spark, folder, "nation").select("n_name").where("n_name is not null").distinct()
    return sorted(r[0] for r in listed.collect())


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    """The landed cells of one sheet per week."""
    return landing.land(spark, folder, "sheet_grid",
                        lambda: weekly_feed.sheet_grid(_src(spark, folder)))


def _overall(spark: SparkSession, folder: str) -> DataFrame:
    return landing.land(spark, folder, "forecast_overall",
                        lambda: forecast.forecast_overall(_src(spark, folder)))


def _by_carrier(spark: SparkSession, folder: str) -> DataFrame:
    return landing.land(spark, folder, "forecast_by_carrier",
                        lambda: forecast.forecast_by_carrier(_src(spark, folder)))


# ---- sources and sinks -----------------------------------------------------------------

@query
def weekly_source(spark, folder):
    """The one pass over the order lines, nothing landed."""
    return weekly_feed.weekly_departures(spark, folder)


@query
def sheet_extract(spark, folder):
    grid = _grid(spark, folder)
    names = [*_names(spark, folder), ROLLUP_CARRIER]
    extracted = sheets.extract_sheets(grid, names, names)
    lookup = _src(spark, folder).select("Carrier_Name", "Carrier_Full_Name", "Service_Type").distinct()
    return sheets.consolidate(extracted, lookup).select(
        "Carrier_Name", "Carrier_Full_Name", "Service_Type", "Week_Label", "Week_Date",
        "Bus_Departures", "Passenger_Departures",
        F.round("Passengers_Per_Bus", 6).alias("Passengers_Per_Bus"))


def _faulty(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    grid = landing.land(spark, folder, "faulty_grid", lambda: weekly_feed.faulty_grid(_src(spark, folder)))
    return grid, [*_names(spark, folder), ROLLUP_CARRIER]


@query
def sheet_rejects(spark, folder):
    grid, names = _faulty(spark, folder)
    return sheets.sheet_rejects(grid, names, names, depth=None, width=None)


@query
def label_quality(spark, folder):
    grid, names = _faulty(spark, folder)
    return sheets.label_quality(sheets.extract_sheets(grid, names, names, depth=None, width=None))


@query
def consolidate_union(spark, folder):
    weekly = _src(spark, folder).select(*SERIES, "Bus_Departures", "Passenger_Departures",
                                        F.lit("departures").alias("Feed"))
    return rows.union_frames(weekly, weekly_feed.order_feed(spark, folder),
                             weekly_feed.event_feed(spark, folder))


@query
def source_load(spark, folder):
    path = _scratch(spark, "source_csv")
    out = _consolidated(spark, folder)
    sinks.write_csv(out, path, "MM/dd/yyyy")
    return readers.read_weekly_csv(spark, path).select(
        *SERIES, "Year", "Bus_Departures", "Passenger_Departures", "Season", "Is_Summer_Peak")


@query
def sink_csv_roundtrip(spark, folder):
    path = _scratch(spark, "totals_csv")
    sinks.write_csv(forecast.weekly_totals(_src(spark, folder)), path)
    return spark.read.schema(
        "Week_Date date, Passenger_Departures bigint, Bus_Departures bigint"
    ).option("header", True).csv(path)


@query
def sink_table_roundtrip(spark, folder):
    path = _scratch(spark, "monthly_table")
    monthly = summaries.monthly_carrier_summary(_star(spark, folder))
    upstream = monthly.select(
        "Year", "Month", "Carrier_Name", F.col("Total_Passengers").alias("Total Passengers"),
        F.col("Total_Buses").alias("Total Buses"),
        F.col("Avg_Passengers_Per_Bus").alias("Passengers_Per_Bus"))
    sinks.write_table(upstream, path, mapping={
        "Total Passengers": "Total_Passengers", "Total Buses": "Total_Buses",
        "Passengers_Per_Bus": "Avg_Passengers_Per_Bus"}, partition_by=["Year"])
    return spark.read.parquet(path)


@query
def table_reload(spark, folder):
    """A published table after its reload: the first load's rows are gone."""
    path = _scratch(spark, "reloaded")
    totals = forecast.weekly_totals(_src(spark, folder))
    first = versions.publish(totals.withColumn("Bus_Departures", -F.col("Bus_Departures")), path)
    versions.publish(first.withColumn("Bus_Departures", -F.col("Bus_Departures")).select(*totals.columns), path)
    return readers.read_table(spark, path)


@query
def stage_source(spark, folder):
    return weekly_feed.staging_rows(weekly_feed.weekly_departures(spark, folder))


# ---- projections and filters -------------------------------------------------------------

@query
def project_consolidated(spark, folder):
    out = _consolidated(spark, folder)
    return out.withColumn("Passengers_Per_Bus", F.round("Passengers_Per_Bus", 6))


@query
def filter_members(spark, folder):
    grown = weekly_feed.with_rollup_rows(_src(spark, folder))
    members = rows.only_names(rows.members_only(grown), _names(spark, folder))
    listed = weekly_feed.table(spark, folder, "nation").select(F.col("n_name").alias("Carrier_Name"))
    return rows.only_names(members, listed)


@query
def filter_not_null(spark, folder):
    return rows.not_null(_src(spark, folder), "COVID_Period", "Weather_Condition").select(
        *SERIES, "COVID_Period", "Weather_Condition", "Passenger_Departures")


@query
def feature_rows_complete(spark, folder):
    return features.feature_rows_complete(_src(spark, folder))


@query
def latest_year_rows(spark, folder):
    return rows.of_latest_year(_src(spark, folder)).select(*SERIES, "Year", "Passenger_Departures")


@query
def check_integrity(spark, folder):
    return quality.check_integrity(landing.warehouse(spark, folder)[2])


@query
def filter_like(spark, folder):
    return rows.name_like(_src(spark, folder), "Carrier_Name", "NATION_1%", "%_7").select(
        *SERIES, "Bus_Departures")


@query
def flag_encode(spark, folder):
    src = _src(spark, folder)
    names = ["Is_Holiday", "Is_Tourism_Peak", "Is_Severe_Weather", "Is_COVID_Period", "Is_High_Inflation"]
    return src.select(*SERIES, *[measures.flag(c).alias(c) for c in names])


# ---- scalar functions ----------------------------------------------------------------------

@query
def week_label_parse(spark, folder):
    labels = weekly_feed.with_week_label(_src(spark, folder)).select(
        F.col("Week_Date").alias("Friday"), "Week_Label", "Label_Year").distinct()
    literal = calendar.with_week_ending(labels, fix_year_rollover=False).select(
        "Friday", "Week_Label", "Label_Year", F.col("Week_Date").alias("Literal_Date"))
    return calendar.with_week_ending(literal)


@query
def date_parts(spark, folder):
    days = _src(spark, folder).select("Week_Date").distinct()
    return calendar.with_date_parts(days)


@query
def season_label(spark, folder):
    return (_src(spark, folder).groupBy(calendar.season("Month").alias("Season"))
            .agg(F.count(F.lit(1)).alias("Row_Count"),
                 F.sum("Passenger_Departures").cast("bigint").alias("Total_Passengers")))


@query
def fiscal_year(spark, folder):
    return (_src(spark, folder).groupBy(calendar.fiscal_year("Week_Date").alias("Fiscal_Year"))
            .agg(F.countDistinct("Week_Date").alias("Weeks"),
                 F.sum("Passenger_Departures").cast("bigint").alias("Total_Passengers")))


@query
def status_label(spark, folder):
    """Status by year; the years move by 25 so that all three labels occur."""
    src = _src(spark, folder)
    return src.select(*SERIES, "Year", measures.status_of_year(F.col("Year") + 25).alias("Status"))


@query
def calendar_flags(spark, folder):
    days = _src(spark, folder).select("Week_Date", "Month").distinct()
    return calendar.with_calendar_flags(days)


@query
def date_key(spark, folder):
    src = _src(spark, folder)
    return src.select(
        "Week_Date", calendar.date_key("Week_Date").alias("Date_Key"),
        calendar.date_key_from_parts("Year", "Month", "Week_Date").alias("Date_Key_From_Parts")
    ).distinct()


@query
def safe_date_cast(spark, folder):
    """Dates as US text, ISO text, and a label that is no date."""
    days = weekly_feed.with_week_label(_src(spark, folder)).select("Week_Date", "Week_Label").distinct()
    return days.select(
        "Week_Date",
        calendar.safe_date(F.date_format("Week_Date", "MM/dd/yyyy")).alias("From_Us_Text"),
        calendar.safe_date(F.col("Week_Date").cast("string")).alias("From_Iso_Text"),
        calendar.safe_date("Week_Label").alias("From_Label"))


@query
def check_date_range(spark, folder):
    _, tables, facts = landing.warehouse(spark, folder)
    return quality.check_date_range(facts, tables["dim_date"])


@query
def days_since(spark, folder):
    return _src(spark, folder).select(
        "Week_Date", calendar.days_since("Week_Date", FIXTURE_REFERENCE_DATE).alias("Days_Since")).distinct()


@query
def passengers_per_bus(spark, folder):
    return _src(spark, folder).select(
        *SERIES, measures.passengers_per_bus("Passenger_Departures", "Bus_Departures").alias("Rounded"),
        F.round(measures.passengers_per_bus_double("Passenger_Departures", "Bus_Departures"), 6).alias("Ratio"))


@query
def recovery_percent(spark, folder):
    return trends.recovery_percent(
        trends.baseline_attach(_src(spark, folder), FIXTURE_BASELINE_YEAR)
    ).select(*SERIES, "Bus_Recovery_Percent", "Passenger_Recovery_Percent")


@query
def period_classify(spark, folder):
    src = _src(spark, folder).select("Week_Date").distinct()
    return src.select(
        "Week_Date",
        measures.classify("Week_Date", weekly_feed.PERIOD_STARTS, weekly_feed.PERIOD_BEFORE).alias("Period"),
        measures.classify("Week_Date", weekly_feed.ECONOMIC_STARTS, weekly_feed.ECONOMIC_BEFORE)
        .alias("Economic_Period"))


@query
def period_table_classify(spark, folder):
    src = _src(spark, folder)
    return periods.classify_by_table(src.select(*SERIES), "Week_Date", weekly_feed.quarter_periods(src), "Period")


@query
def period_overlaps(spark, folder):
    return periods.period_overlaps(weekly_feed.quarter_periods(_src(spark, folder)))


@query
def numeric_coerce(spark, folder):
    """Every grid cell as a number, NULL where it is text; counted per column."""
    grid = _grid(spark, folder)
    number = measures.to_number("value")
    return grid.groupBy("col_idx").agg(
        F.count(F.lit(1)).alias("Cells"), F.count(number).alias("Numbers"),
        F.sum(number).cast("bigint").alias("Total"))


@query
def lookup_enrich(spark, folder):
    nation, region = (weekly_feed.table(spark, folder, t) for t in ("nation", "region"))
    lookup = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("Carrier_Name"), F.col("r_name").alias("Service_Type"),
        F.concat("n_name", F.lit(" Lines")).alias("Carrier_Full_Name"))
    grown = weekly_feed.with_rollup_rows(_src(spark, folder)).select(*SERIES, "Passenger_Departures")
    return sheets.lookup_enrich(grown, lookup)


@query
def event_default(spark, folder):
    return dims.event_attributes(_src(spark, folder)).groupBy("NYC_Event").agg(
        F.count(F.lit(1)).alias("Row_Count"))


@query
def service_description(spark, folder):
    types = _src(spark, folder).select("Service_Type").distinct()
    return types.select(
        "Service_Type", dims.service_description("Service_Type").alias("Description"),
        dims.service_description("Service_Type", SERVICE_SUFFIX_SHORT).alias("Short_Description"),
        dims.service_description(F.nullif("Service_Type", F.lit("ASIA"))).alias("Null_Description"))


@query
def latest_records(spark, folder):
    _, tables, facts = landing.warehouse(spark, folder)
    return quality.latest_records(facts, tables)


@query
def baseline_comparison(spark, folder):
    annual = forecast.forecast_annual(_overall(spark, folder))
    return forecast.baseline_comparison(annual, _src(spark, folder), FIXTURE_BASELINE_YEAR)


# ---- dimensions, fact, star ------------------------------------------------------------------

@query
def dim_date(spark, folder):
    return dims.dim_date(_src(spark, folder))


@query
def dim_carrier(spark, folder):
    return dims.dim_carrier(_src(spark, folder))


@query
def dim_weather(spark, folder):
    return dims.dim_weather(_src(spark, folder))


@query
def dim_status(spark, folder):
    return dims.dim_status(_src(spark, folder))


@query
def dim_event(spark, folder):
    return dims.dim_event(_src(spark, folder))


@query
def dim_service_type(spark, folder):
    return dims.dim_service_type(_src(spark, folder))


@query
def dim_conflicts(spark, folder):
    return dims.dim_conflicts(weekly_feed.conflicting_staging(_src(spark, folder)))


@query
def distinct_values(spark, folder):
    return rows.distinct_values(_src(spark, folder), "Service_Type")


@query
def fact_load(spark, folder):
    return fact.load_fact(_src(spark, folder), landing.dimensions(spark, folder))


@query
def fact_fanout_check(spark, folder):
    return quality.fact_fanout_check(
        _src(spark, folder), landing.dimensions(spark, folder)["dim_weather"])


@query
def star_read(spark, folder):
    return _star(spark, folder)


@query
def baseline_attach(spark, folder):
    return trends.baseline_attach(_src(spark, folder), FIXTURE_BASELINE_YEAR).select(
        *SERIES, "Week_of_Year", "Baseline_2019_Buses", "Baseline_2019_Passengers")


# ---- summaries -----------------------------------------------------------------------------------

@query
def monthly_carrier_summary(spark, folder):
    return summaries.monthly_carrier_summary(_star(spark, folder))


@query
def quarterly_summary(spark, folder):
    return summaries.quarterly_summary(_star(spark, folder))


@query
def quarterly_carriers_by_sketch(spark, folder):
    return summaries.carriers_by_sketch(_star(spark, folder))


@query
def period_impact_summary(spark, folder):
    return summaries.period_impact_summary(_star(spark, folder))


@query
def carrier_performance(spark, folder):
    return summaries.carrier_performance(_star(spark, folder))


@query
def carrier_performance_ranked(spark, folder):
    return summaries.rank_performance(summaries.carrier_performance(_star(spark, folder)))


@query
def top_performers(spark, folder):
    ranked = summaries.rank_performance(summaries.carrier_performance(_star(spark, folder)))
    return summaries.top_performers(ranked)


@query
def summary_grouping_sets(spark, folder):
    return summaries.summary_grouping_sets(_star(spark, folder))


@query
def summary_statistics(spark, folder):
    return quality.summary_statistics(landing.warehouse(spark, folder)[2])


@query
def weekly_totals(spark, folder):
    return forecast.weekly_totals(_src(spark, folder))


@query
def weekly_totals_by_carrier(spark, folder):
    return forecast.weekly_totals_by_carrier(_src(spark, folder))


@query
def recovery_status(spark, folder):
    return kpis.recovery_status(_src(spark, folder), FIXTURE_BASELINE_YEAR)


@query
def carrier_year_pivot(spark, folder):
    annual = forecast.carrier_forecast_annual(_by_carrier(spark, folder))
    return summaries.carrier_year_pivot(annual, _names(spark, folder))


# ---- windows -------------------------------------------------------------------------------------

@query
def wow_change(spark, folder):
    return trends.wow_change(_src(spark, folder)).select(
        *SERIES, "Bus_WoW_Change", "Bus_WoW_Percent", "Passenger_WoW_Change", "Passenger_WoW_Percent")


def _averages(spark, folder, weeks):
    by_rows = trends.moving_average(_src(spark, folder).select(*SERIES, *trends.MEASURES.values()), weeks)
    names = {f"{m}_{weeks}wk_MA": f"{m}_{weeks}wk_Row_MA" for m in trends.MEASURES}
    both = trends.moving_average(by_rows.withColumnsRenamed(names), weeks, calendar=True)
    return both.drop(*trends.MEASURES.values())


@query
def moving_avg_4wk(spark, folder):
    return _averages(spark, folder, 4)


@query
def moving_avg_12wk(spark, folder):
    return _averages(spark, folder, 12)


# ---- sorting and previews --------------------------------------------------------------------------

@query
def sorted_consolidated(spark, folder):
    return rows.sorted_rows(_consolidated(spark, folder).select(
        *SERIES, "Bus_Departures", "Passenger_Departures"))


@query
def table_preview(spark, folder):
    tables = landing.dimensions(spark, folder)
    return rows.table_preview({
        "dim_date": (tables["dim_date"], "Date_Key", F.col("Month_Name")),
        "dim_carrier": (tables["dim_carrier"], "Carrier_Key", F.col("Carrier_Name")),
        "dim_weather": (tables["dim_weather"], "Weather_Key", F.col("Weather_Condition")),
        "dim_status": (tables["dim_status"], "COVID_Key", F.concat_ws(
            "/", "COVID_Period", "Economic_Period")),
        "dim_event": (tables["dim_event"], "Event_Key", F.col("NYC_Event")),
        "dim_service_type": (tables["dim_service_type"], "Service_Type_Key", F.col("Service_Type")),
    })


@query
def preview_dim_date(spark, folder):
    """All columns, newest first; so are the previews below."""
    return rows.first_rows(landing.dimensions(spark, folder)["dim_date"], [F.col("Week_Date").desc()])


@query
def preview_fact(spark, folder):
    return rows.first_rows(landing.warehouse(spark, folder)[2], [F.col("Date_Key").desc(), "Carrier_Key"])


@query
def preview_monthly(spark, folder):
    return rows.first_rows(landing.summary_tables(spark, folder)["monthly"], [
        F.col("Year").desc(), F.col("Month").desc(), "Carrier_Name"])


@query
def preview_quarterly(spark, folder):
    return rows.first_rows(landing.summary_tables(spark, folder)["quarterly"], [
        F.col("Year").desc(), F.col("Quarter").desc()])


@query
def preview_period(spark, folder):
    return rows.first_rows(landing.summary_tables(spark, folder)["period"], ["COVID_Period"])


@query
def preview_performance(spark, folder):
    return rows.first_rows(landing.summary_tables(spark, folder)["performance"], ["Carrier_Name"])


# ---- quality ------------------------------------------------------------------------------------------

@query
def row_count_summary(spark, folder):
    return quality.row_count_summary(
        *landing.warehouse(spark, folder), landing.summary_tables(spark, folder))


@query
def staging_quality(spark, folder):
    return quality.staging_quality(_src(spark, folder))


@query
def check_referential(spark, folder):
    _, tables, facts = landing.warehouse(spark, folder)
    return quality.check_referential(facts, tables)


@query
def check_unique_keys(spark, folder):
    _, tables, facts = landing.warehouse(spark, folder)
    return quality.check_unique_keys(tables | {"fact": facts} | landing.summary_tables(spark, folder))


@query
def repeated_key_findings(spark, folder):
    """The same check over tables in which some rows stand twice."""
    _, tables, facts = landing.warehouse(spark, folder)
    whole = tables | {"fact": facts} | landing.summary_tables(spark, folder)
    twice = {
        "dim_date": F.col("Date_Key") % 3 == 1, "dim_carrier": F.col("Carrier_Key") % 3 == 1,
        "dim_weather": F.col("Weather_Key") % 3 == 1, "dim_status": F.col("COVID_Key") % 3 == 1,
        "dim_event": F.col("Event_Key") % 3 == 1, "dim_service_type": F.col("Service_Type_Key") % 3 == 1,
        "fact": F.col("Fact_Key") % 97 == 1, "monthly": F.col("Month") == 2, "quarterly": F.col("Quarter") == 3,
        "period": F.col("COVID_Period") == "Post", "performance": F.col("Carrier_Name").endswith("1")}
    return quality.check_unique_keys({name: df.union(df.where(twice[name])) for name, df in whole.items()})


@query
def period_loss_check(spark, folder):
    _, tables, facts = landing.warehouse(spark, folder)
    return quality.period_loss_check(facts, tables["dim_status"])


@query
def date_key_conflicts(spark, folder):
    return quality.date_key_conflicts(_src(spark, folder))


@query
def rollup_reconciliation(spark, folder):
    return quality.rollup_reconciliation(weekly_feed.with_rollup_rows(_src(spark, folder)))


# ---- forecasting ----------------------------------------------------------------------------------------

@query
def feature_importance(spark, folder):
    return features.ranked_importance(landing.forest_nodes(spark, folder))


@query
def forest_nodes(spark, folder):
    return landing.forest_nodes(spark, folder)


@query
def forest_fit(spark, folder):
    return features.forest_fit(_src(spark, folder), landing.forest_nodes(spark, folder))


@query
def feature_correlation(spark, folder):
    return features.feature_correlation(_src(spark, folder))


@query
def top_features(spark, folder):
    """The ten features that go most with the target."""
    return features.feature_correlation(_src(spark, folder)).limit(10)


@query
def future_calendar(spark, folder):
    return forecast.future_calendar(forecast.weekly_totals(_src(spark, folder)))


@query
def forecast_overall(spark, folder):
    return forecast.forecast_overall(_src(spark, folder))


@query
def forecast_overall_additive(spark, folder):
    return additive.forecast_overall_additive(_src(spark, folder))


@query
def forecast_by_carrier(spark, folder):
    return forecast.forecast_by_carrier(_src(spark, folder))


@query
def forecast_by_carrier_additive(spark, folder):
    return additive.forecast_by_carrier_additive(_src(spark, folder))


@query
def additive_residuals(spark, folder):
    return additive.additive_residuals(_src(spark, folder))


@query
def forecast_annual(spark, folder):
    return forecast.forecast_annual(_overall(spark, folder))


@query
def busiest_weeks(spark, folder):
    return forecast.busiest_weeks(_overall(spark, folder))


@query
def busiest_months(spark, folder):
    return forecast.busiest_months(_overall(spark, folder))


@query
def top_weeks(spark, folder):
    return forecast.busiest_weeks(_overall(spark, folder), full_years_only=True).limit(10)


@query
def monthly_series(spark, folder):
    return forecast.monthly_series(_src(spark, folder), _overall(spark, folder))


@query
def carrier_forecast_summary(spark, folder):
    annual = forecast.carrier_forecast_annual(_by_carrier(spark, folder))
    return forecast.carrier_forecast_summary(annual)


@query
def top_carriers(spark, folder):
    annual = forecast.carrier_forecast_annual(_by_carrier(spark, folder))
    return forecast.carrier_forecast_summary(annual).limit(3)


@query
def carrier_forecast_annual(spark, folder):
    return forecast.carrier_forecast_annual(_by_carrier(spark, folder))


@query
def forecast_findings(spark, folder):
    weekly = _overall(spark, folder)
    return forecast.forecast_findings(
        forecast.forecast_annual(weekly), forecast.busiest_weeks(weekly, full_years_only=True),
        forecast.busiest_months(weekly, full_years_only=True), _src(spark, folder), FIXTURE_BASELINE_YEAR)


# ---- indicators -----------------------------------------------------------------------------------------

@query
def period_decline(spark, folder):
    return kpis.period_decline(_src(spark, folder), "Pre", "During")


@query
def recovery_quarter(spark, folder):
    return kpis.recovery_quarter(_src(spark, folder), FIXTURE_BASELINE_YEAR, FIXTURE_REFERENCE_DATE)


@query
def carrier_recovery_speed(spark, folder):
    return kpis.carrier_recovery_speed(
        _src(spark, folder), FIXTURE_BASELINE_YEAR, FIXTURE_REFERENCE_DATE)


@query
def carrier_leaders(spark, folder):
    return kpis.carrier_leaders(summaries.carrier_performance(_star(spark, folder)))


@query
def carrier_yoy(spark, folder):
    return kpis.carrier_yoy(_src(spark, folder))


@query
def forecast_cagr(spark, folder):
    return forecast.forecast_cagr(forecast.forecast_annual(_overall(spark, folder)))
