"""The reference flows end to end, from a staging frame to written tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from farebox.constants import BASELINE_YEAR, FORECAST_WEEKS
from farebox.functions.calendar import days_since
from farebox.functions.measures import classify
from farebox.operators import features, forecast, summaries
from farebox.operators.dims import load_dimensions
from farebox.operators.fact import load_fact, star_read, with_load_stamp
from farebox.operators.trends import one_row_per_week, with_trends
from farebox.schemas import STAGING, as_text_flag, conform
from farebox.sources.sheets import consolidate, extract_sheets, label_quality, sheet_rejects
from farebox.sources.sinks import write_csv
from farebox.sources.versions import publish


Periods = list[tuple[str, str | None]]


def stage(rows: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Staging columns in order, stamped with the load time.

    The observation, if given, counts the rows as they are written, without another pass.
    """
    staged = with_load_stamp(conform(rows, STAGING))
    return staged.observe(observation, F.count(F.lit(1)).alias("rows")) if observation else staged


def derive_staging(consolidated: DataFrame, periods: Periods, period_before: str | None,
                   inflation: Periods, inflation_before: str | None, reference_date: date,
                   covid_periods: list[str], high_inflation: list[str],
                   baseline_year: int = BASELINE_YEAR, calendar: bool = False) -> DataFrame:
    """Staging rows of the consolidated table.

    Period, baseline, recovery, trend and tourism columns have no source of their own and are
    derived here: periods by their first days, the tourism peak as July, August and December,
    the rest as in `operators.trends`. A carrier that stands twice in a week, as on two sheets of
    one label, is one row with the sum; parts of a bus or passenger are rounded half away from zero.
    """
    period = classify("Week_Date", periods, period_before)
    economic = classify("Week_Date", inflation, inflation_before)
    rows = one_row_per_week(consolidated).withColumns({
        "COVID_Period": period,
        "Economic_Period": economic,
        "Is_COVID_Period": as_text_flag(period.isin(covid_periods)),
        "Is_High_Inflation": as_text_flag(economic.isin(high_inflation)),
        "Days_Since_Pandemic_Start": days_since("Week_Date", reference_date),
        "Is_Holiday": as_text_flag(F.col("Is_Holiday")),
        "Is_Severe_Weather": as_text_flag(F.col("Is_Severe_Weather")),
        "Is_Tourism_Peak": as_text_flag(F.col("Is_Summer_Peak") | F.col("Is_Holiday_Season")),
        "NYC_Event": F.lit(None).cast("string"),
        "Bus_Departures": F.round("Bus_Departures").cast("bigint"),
        "Passenger_Departures": F.round("Passenger_Departures").cast("bigint"),
    })
    return conform(with_trends(rows, baseline_year, calendar), STAGING)


def consolidate_job(grid: DataFrame, out: str, fix_year_rollover: bool = True) -> DataFrame:
    """Sheets to the consolidated CSV, sorted by date and carrier.

    Beside it, `<out>_rejects` lists the sheets that could not be read and why, `<out>_labels` the date
    of each sheet that was and whether its label had to be defaulted.
    """
    extracted = extract_sheets(grid)
    rows = consolidate(extracted, fix_year_rollover=fix_year_rollover)
    write_csv(rows.orderBy("Week_Date", "Carrier_Name"), out, "MM/dd/yyyy")
    write_csv(sheet_rejects(grid).orderBy("year", "sheet"), f"{out}_rejects")
    write_csv(label_quality(extracted, fix_year_rollover).orderBy("Week_Date", "Week_Label"), f"{out}_labels", "MM/dd/yyyy")
    return rows


def warehouse_job(rows: DataFrame, out: str) -> dict[str, DataFrame]:
    """Staging, six dimensions, fact, four summaries and the ranking, each replaced in `out`.

    Every table is read back from its files before the next is built from it. A rerun publishes new versions
    (`sources.versions`): `readers.read_table` finds whole rows at any time.
    """
    tables = {"staging": publish(stage(rows), f"{out}/staging")}
    src = tables["staging"]
    dims = {name: publish(df, f"{out}/{name}") for name, df in load_dimensions(src).items()}
    fact = publish(with_load_stamp(load_fact(src, dims)), f"{out}/fact")
    star = publish(star_read(fact, dims), f"{out}/star")
    results = {
        "monthly_carrier_summary": summaries.monthly_carrier_summary(star),
        "quarterly_summary": summaries.quarterly_summary(star),
        "period_impact_summary": summaries.period_impact_summary(star),
        "carrier_performance": summaries.rank_performance(summaries.carrier_performance(star)),
    }
    return tables | dims | {"fact": fact} | {
        name: publish(df, f"{out}/{name}") for name, df in results.items()}


def forecast_job(src: DataFrame, out: str, baseline_year: int = BASELINE_YEAR,
                 weeks: int = FORECAST_WEEKS, importance: bool = True) -> None:
    """All forecast outputs as CSV folders; the two forecasts are written once and reused."""
    weekly = publish(forecast.forecast_overall(src, weeks), f"{out}/weekly_forecast_table")
    carriers = publish(forecast.forecast_by_carrier(src, weeks), f"{out}/carrier_forecast_table")
    annual = forecast.forecast_annual(weekly)
    write_csv(weekly.orderBy("ds"), f"{out}/weekly_passenger_forecast")
    write_csv(annual.orderBy("Year"), f"{out}/annual_passenger_forecast")
    write_csv(forecast.carrier_forecast_annual(carriers).orderBy("Carrier", "Year"),
              f"{out}/carrier_forecast")
    write_csv(forecast.busiest_weeks(weekly), f"{out}/busiest_weeks")
    write_csv(forecast.busiest_months(weekly), f"{out}/busiest_months")
    write_csv(forecast.baseline_comparison(annual, src, baseline_year).orderBy(F.col("Year")),
              f"{out}/forecast_vs_baseline")
    if importance:
        write_csv(features.feature_importance(src), f"{out}/feature_importance")
