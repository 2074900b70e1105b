"""Baseline, recovery, week-over-week and moving averages."""

from datetime import date

from farebox.operators import kpis, trends
from pyspark.sql import functions as F
from tests.helpers import staging, week


def series(spark, values, carrier="A", weeks=None):
    weeks = weeks or range(len(values))
    return [{"Week_Date": week(w), "Carrier_Name": carrier, "Passenger_Departures": v,
             "Bus_Departures": None if v is None else v // 10} for w, v in zip(weeks, values)]


def test_wow_change(spark):
    df = trends.wow_change(staging(spark, series(spark, [100, 150, 0, 30])).orderBy("Week_Date"))
    got = [(r.Passenger_WoW_Change, r.Passenger_WoW_Percent) for r in df.orderBy("Week_Date").collect()]
    as_float = [tuple(None if v is None else float(v) for v in pair) for pair in got]
    assert as_float == [(None, None), (50.0, 50.0), (-150.0, -100.0), (30.0, None)]


def test_moving_average_rows_and_calendar(spark):
    src = staging(spark, series(spark, [10, 20, 30, 40, 100], weeks=[0, 1, 2, 3, 8]))
    by_rows = trends.moving_average(src, 4).orderBy("Week_Date").collect()
    assert [float(r.Passenger_4wk_MA) for r in by_rows] == [10.0, 15.0, 20.0, 25.0, 47.5]
    by_calendar = trends.moving_average(src, 4, calendar=True).orderBy("Week_Date").collect()
    assert [float(r.Passenger_4wk_MA) for r in by_calendar] == [10.0, 15.0, 20.0, 25.0, 100.0]


def test_moving_average_rounds_half_up(spark):
    src = staging(spark, series(spark, [1, 0, 0, 0, 0, 0, 0, 0]))
    got = trends.moving_average(src, 8).orderBy("Week_Date").collect()[-1]
    assert float(got.Passenger_8wk_MA) == 0.13


def test_windows_keep_carriers_apart(spark):
    src = staging(spark, series(spark, [10, 20]) + series(spark, [1000, 3000], "B"))
    got = {(r.Carrier_Name, r.Week_Date): r.Passenger_WoW_Change for r in trends.wow_change(src).collect()}
    assert got[("B", week(1))] == 2000 and got[("A", week(0))] is None and got[("B", week(0))] is None


def test_baseline_by_iso_week(spark):
    src = staging(spark, series(spark, [100, 200], weeks=[0, 1]) + series(spark, [50, 70, 80], weeks=[104, 105, 110]))
    got = trends.recovery_percent(trends.baseline_attach(src, 2019)).orderBy("Week_Date").collect()
    # week 0 is 2019-01-04 (ISO 1), week 104 is 2021-01-01 (ISO 53), week 105 is 2021-01-08 (ISO 1)
    assert [r.Baseline_2019_Passengers for r in got] == [100, 200, None, 100, None]
    assert [None if r.Passenger_Recovery_Percent is None else float(r.Passenger_Recovery_Percent) for r in got] == [
        100.0, 100.0, None, 70.0, None]


def test_weekly_grain_sums_a_raw_feed(spark):
    src = staging(spark, series(spark, [10, 20]) + series(spark, [1, 2]))
    grain = trends.weekly_grain(src)
    assert sorted((r.Week_Date, r.Passenger_Departures) for r in grain.collect()) == [(week(0), 11), (week(1), 22)]


def test_recovery_status(spark):
    src = staging(spark, series(spark, [100] * 52) + series(spark, [50] * 52, "B")
                  + series(spark, [120, 120, 120], weeks=[261, 262, 263])
                  + [{"Week_Date": week(0), "Carrier_Name": "Total", "Passenger_Departures": 10 ** 6}])
    got = kpis.recovery_status(src, 2019).first()
    assert (got.Latest_Year, got.Baseline_Total, got.Latest_Total, got.Baseline_Carriers) == (2024, 7800, 360, 2)
    assert (float(got.Baseline_Weekly_Avg), float(got.Baseline_True_Weekly_Avg)) == (75.0, 150.0)
    assert float(got.Recovery_Percent) == 4.62          # three weeks against a whole year
    assert float(got.Recovery_Percent_Same_Weeks) == 80.0


def test_recovery_without_baseline_rows(spark):
    got = kpis.recovery_status(staging(spark, series(spark, [1], weeks=[261])), 2019).first()
    assert (got.Baseline_Total, got.Recovery_Percent, got.Baseline_Carriers) == (0, None, 0)


def test_indicators(spark):
    from datetime import date
    quarters = [0, 13, 26, 39]
    data = series(spark, [100] * 4, weeks=quarters) + series(spark, [60, 90, 100, 120], weeks=[105, 118, 131, 144])
    data += series(spark, [100] * 4, "B", quarters) + series(spark, [10, 10], "B", [105, 118])
    src = staging(spark, [r | {"COVID_Period": "Pre" if r["Week_Date"].year == 2019 else "During"} for r in data])
    speed = {r.Carrier_Name: (r.Speed_Rank, r.Recovery_Year, r.Recovery_Quarter)
             for r in kpis.carrier_recovery_speed(src, 2019, date(2020, 1, 1)).collect()}
    assert speed == {"A": (1, 2021, 3), "B": (2, None, None)}
    overall = kpis.recovery_quarter(src, 2019, date(2020, 1, 1)).first()
    assert (float(overall.Baseline_Quarter), overall.Recovery_Year) == (200.0, None)
    decline = kpis.period_decline(src, "Pre", "During").first()
    assert (float(decline.Before_Weekly_Avg), float(decline.After_Weekly_Avg), float(decline.Change_Percent)) == (
        200.0, 97.5, -51.25)
    yoy = {(r.Carrier_Name, r.Year): r.Growth_Percent for r in kpis.carrier_yoy(src).collect()}
    assert yoy[("A", 2021)] is None  # 2020 is missing


def test_a_carrier_twice_in_a_week_is_one_row_before_trends(spark):
    """Also parts of a bus are rounded, not cut, and rows without a key stay apart."""
    from farebox.plans.jobs import derive_staging
    from farebox.sources.sheets import consolidate
    lines = [("Jan 4-8", 2021, "Academy", "2.9", "100"), ("Jan 4-8", 2021, "Academy", "1", "20"),
             ("Jan 11-15", 2021, "Academy", "n/a", "150"), ("Jan 11-15", 2021, "Martz", "4", "n/a")]
    extracted = spark.createDataFrame(lines, "sheet string, year int, Carrier_Name string, Bus_Text string, Passenger_Text string")
    out = derive_staging(consolidate(extracted), [("2020-03-01", "During")], "Pre", [("2022-01-01", "High")], "Stable",
                         date(2020, 3, 1), ["During"], ["High"], baseline_year=2021)
    got = {(r.Carrier_Name, r.Week_Date): (r.Bus_Departures, r.Passenger_Departures, r.Passenger_WoW_Change) for r in out.collect()}
    assert got == {("Academy", date(2021, 1, 8)): (4, 120, None), ("Academy", date(2021, 1, 15)): (None, 150, 30),
                   ("Martz", date(2021, 1, 15)): (4, None, None)}
    loose = trends.one_row_per_week(consolidate(extracted).withColumn("Carrier_Name", F.lit(None).cast("string")))
    assert loose.count() == 4
