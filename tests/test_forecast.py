"""Forecasts against a plain numpy computation, and the rules around them."""

from datetime import date, timedelta

import numpy as np
import pytest
from farebox.constants import FEATURE_COLUMNS, INTERVAL_Z
from farebox.operators import additive, features, forecast
from pyspark.sql import functions as F
from tests.helpers import staging, week


def history(n=150, slope=2.0, carrier="A", start=0):
    rng = np.random.default_rng(7)
    out = []
    for i in range(start, start + n):
        season = 1 + 0.2 * np.sin(2 * np.pi * i / 52)
        out.append({"Week_Date": week(i), "Carrier_Name": carrier,
                    "Passenger_Departures": int((500 + slope * i) * season + rng.integers(0, 30))})
    return out


def by_hand(data, last, weeks):
    days = np.array([(d["Week_Date"] - date(1970, 1, 1)).days / 7 for d in data])
    y = np.array([float(d["Passenger_Departures"]) for d in data])
    b, a = np.polyfit(days - days.mean(), y, 1)
    trend = a + b * (days - days.mean())
    iso = [d["Week_Date"].isocalendar()[1] for d in data]
    index = {w: np.mean([v / t for v, t, k in zip(y, trend, iso) if k == w]) for w in set(iso)}
    season = np.array([index[w] for w in iso])
    sigma = np.std(y - trend * season, ddof=1)
    years = np.rint((days - days[0]) * 7).astype(int) // 364
    slopes = [np.polyfit(days[years == k] - days.mean(), (y / season)[years == k], 1)[0]
              for k in sorted(set(years)) if (years == k).sum() >= 13]
    changes = np.abs(np.diff(slopes))
    growth = 2 * round(changes.mean(), 6) ** 2 * len(changes) / (3 * (days[-1] - days[0])) if len(changes) else 0
    first = last + timedelta(days=(6 - last.weekday()) or 7)
    out = {}
    for k in range(weeks):
        ds = first + timedelta(weeks=k)
        t = (ds - date(1970, 1, 1)).days / 7 - days.mean()
        factor = index.get(ds.isocalendar()[1], 1.0)
        yhat, ahead = (a + b * t) * factor, (ds - data[-1]["Week_Date"]).days / 7
        width = INTERVAL_Z * np.sqrt(sigma ** 2 + factor ** 2 * growth * ahead ** 3)
        out[ds] = (yhat, yhat - width, yhat + width)
    return out


def check(got, expected):
    assert set(got) == set(expected)
    for day, values in expected.items():
        assert got[day] == pytest.approx(values, abs=1e-3), day


def test_overall_matches_numpy(spark):
    data = history()
    got = {r.ds: (r.yhat, r.yhat_lower, r.yhat_upper)
           for r in forecast.forecast_overall(staging(spark, data), 60).collect()}
    check(got, by_hand(data, week(149), 60))


def test_carriers_share_one_calendar(spark):
    early, late = history(100, carrier="A"), history(150, slope=-1, carrier="B")
    src = staging(spark, early + late)
    out = forecast.forecast_by_carrier(src, 60).collect()
    for name, data in (("A", early), ("B", late)):
        check({r.ds: (r.yhat, r.yhat_lower, r.yhat_upper) for r in out if r.Carrier == name},
              by_hand(data, week(149), 60))
    own = forecast.forecast_by_carrier(src, 60, own_horizon=True).collect()
    per = {name: sorted(r.ds for r in own if r.Carrier == name) for name in "AB"}
    assert len(per["B"]) == 60 and len(per["A"]) == 60 - 50 and per["A"][0] == per["B"][0]


def test_bounds_widen_with_the_horizon(spark):
    bent = history(120) + [d | {"Passenger_Departures": d["Passenger_Departures"] + 4 * i}
                           for i, d in enumerate(history(160, start=120))]
    out = forecast_rows(forecast.forecast_overall(staging(spark, bent), 200))
    width = np.array([r.yhat_upper - r.yhat_lower for r in out])
    index = np.array([r.yhat for r in out])
    assert all(width[k + 52] > width[k] for k in range(len(width) - 52)) and width[-1] > 3 * width[0]
    assert np.allclose([r.yhat_upper - r.yhat for r in out], [r.yhat - r.yhat_lower for r in out], atol=2e-4) and len(index) == 200


def test_a_history_of_one_year_has_one_width_per_season(spark):
    out = forecast_rows(forecast.forecast_overall(staging(spark, history(52)), 20))
    assert np.ptp([r.yhat_upper - r.yhat_lower for r in out]) < 1e-3


def test_rollup_row_is_left_out(spark):
    data = history(60)
    doubled = data + [d | {"Carrier_Name": "Total"} for d in data]
    plain = forecast_rows(forecast.forecast_overall(staging(spark, data), 4))
    assert forecast_rows(forecast.forecast_overall(staging(spark, doubled), 4)) == plain
    both = forecast.weekly_totals(staging(spark, doubled), include_rollup_rows=True)
    assert both.where(F.col("Week_Date") == F.lit(week(0))).first().Passenger_Departures == 2 * data[0]["Passenger_Departures"]


def test_calendar_starts_after_a_sunday(spark):
    df = spark.createDataFrame([(date(2021, 3, 7),)], "Week_Date date")  # a Sunday
    days = [r.ds for r in forecast.future_calendar(df, 3).orderBy("ds").collect()]
    assert days == [date(2021, 3, 14), date(2021, 3, 21), date(2021, 3, 28)]


def test_week_without_known_values_counts_zero(spark):
    src = staging(spark, [{"Week_Date": week(0), "Passenger_Departures": None}, {"Week_Date": None}])
    got = forecast.weekly_totals(src).collect()
    assert [(r.Week_Date, r.Passenger_Departures) for r in got] == [(week(0), 0)]


def test_single_observation(spark):
    got = forecast.forecast_by_carrier(staging(spark, [{"Week_Date": week(0), "Passenger_Departures": 42}]), 2)
    assert [r.yhat for r in got.collect()] == [42.0, 42.0]


def weekly(spark, start, n, value=10.0):
    df = spark.createDataFrame([(start + timedelta(weeks=i), value, value - 3, value + 4) for i in range(n)],
                               "ds date, yhat double, yhat_lower double, yhat_upper double")
    return forecast.with_forecast_parts(df)


def test_annual_rollup(spark):
    annual = {r.Year: r for r in forecast.forecast_annual(weekly(spark, date(2025, 11, 2), 120)).collect()}
    assert [annual[y].Is_Full_Year for y in (2025, 2026, 2027, 2028)] == [False, True, True, False]
    full = annual[2026]
    assert (full.Projected_Passengers, full.Lower_Bound, full.Upper_Bound) == (520.0, 364.0, 728.0)
    assert full.Lower_Bound_RSS == pytest.approx(520 - 3 * 52 ** 0.5, abs=1e-3)
    assert full.Upper_Bound_RSS == pytest.approx(520 + 4 * 52 ** 0.5, abs=1e-3)


def partial_years(spark):
    """The last two weeks of 2025, all of 2026 and the first five of 2027, each year at a volume of its own."""
    volume = {2025: 40.0, 2026: 10.0, 2027: 70.0}
    df = weekly(spark, date(2025, 12, 21), 59)
    return df.withColumn("yhat", F.create_map(*[F.lit(v) for kv in volume.items() for v in kv])[F.col("Year")])


def test_busiest_weeks_take_every_week_of_the_forecast(spark):
    got = {r.Week_of_Year: r.Avg_Passengers for r in forecast.busiest_weeks(partial_years(spark)).collect()}
    assert (got[51], got[52], got[53], got[1], got[4], got[30]) == (25.0, 25.0, 70.0, 40.0, 40.0, 10.0)
    full = {r.Avg_Passengers for r in forecast.busiest_weeks(partial_years(spark), full_years_only=True).collect()}
    assert full == {10.0}


def test_busiest_months_take_every_week_of_the_forecast(spark):
    got = {r.Month_Name: r.Avg_Passengers for r in forecast.busiest_months(partial_years(spark)).collect()}
    # December: two weeks of 2025, four of 2026; January: four of 2026, five of 2027
    assert len(got) == 12 and (got["December"], got["June"]) == (20.0, 10.0)
    assert got["January"] == pytest.approx((4 * 10 + 5 * 70) / 9, abs=1e-4)
    full = {r.Avg_Passengers for r in forecast.busiest_months(partial_years(spark), full_years_only=True).collect()}
    assert full == {10.0}


def test_zero_baseline_gives_null_not_error(spark):
    src = staging(spark, [{"Week_Date": date(2024, 1, 5)}])
    annual = forecast.forecast_annual(weekly(spark, date(2025, 1, 5), 60))
    got = forecast.baseline_comparison(annual, src, 2019).first()
    assert got.Baseline_2019 == 0.0 and got.Percent_Change is None
    assert got.Difference == got.Projected_Passengers - got.Baseline_2019
    found = forecast.forecast_findings(annual, forecast.busiest_weeks(weekly(spark, date(2025, 1, 5), 60)),
                                       forecast.busiest_months(weekly(spark, date(2025, 1, 5), 60)), src, 2019).first()
    assert found.Change_Percent is None and found.Peak_Year == 2025


def test_averages_take_full_years(spark):
    annual = spark.createDataFrame([("A", 2025, 1.0, False), ("A", 2026, 100.0, True), ("A", 2027, 121.0, True)],
                                   "Carrier string, Year int, Projected_Passengers double, Is_Full_Year boolean")
    assert forecast.carrier_forecast_summary(annual).first().Avg_Annual_Passengers == 110.5
    assert forecast.carrier_forecast_summary(annual, full_years_only=False).first().Avg_Annual_Passengers == 74.0
    assert forecast.forecast_cagr(annual).first().Cagr_Percent == 21.0


def test_cagr_of_one_year_is_null(spark):
    annual = spark.createDataFrame([(2026, 100.0, True)], "Year int, Projected_Passengers double, Is_Full_Year boolean")
    assert forecast.forecast_cagr(annual).first().Cagr_Percent is None


# ---- additive model ---------------------------------------------------------------------------------

def test_additive_overall(spark):
    out = forecast_rows(additive.forecast_overall_additive(staging(spark, history(200)), 52))
    assert len(out) == 52 and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)
    expected = [(500 + 2 * (200 + i)) * (1 + 0.2 * np.sin(2 * np.pi * (200 + i) / 52)) for i in range(52)]
    assert np.mean([r.yhat for r in out]) == pytest.approx(np.mean(expected), rel=0.25)


def test_additive_by_carrier_equals_each_alone(spark):
    a, b = history(120, carrier="A"), history(120, slope=-1, carrier="B")
    both = additive.forecast_by_carrier_additive(staging(spark, a + b), 20).collect()
    alone = additive.forecast_by_carrier_additive(staging(spark, b), 20).collect()
    assert len(both) == 40 and all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in both)
    assert {r.ds: r.yhat for r in both if r.Carrier == "B"} == pytest.approx({r.ds: r.yhat for r in alone})


def test_additive_overall_equals_the_only_carrier(spark):
    src = staging(spark, history(120))
    overall = {r.ds: r.yhat for r in additive.forecast_overall_additive(src, 20).collect()}
    assert overall == pytest.approx({r.ds: r.yhat for r in additive.forecast_by_carrier_additive(src, 20).collect()})


def ridge_by_hand(data, last, weeks):
    """The additive model of one series in numpy: yhat and half width by day."""
    day = np.array([(d["Week_Date"] - date(1970, 1, 1)).days for d in data], dtype=float)
    y = np.array([float(d["Passenger_Departures"]) for d in data])
    first, end = day.min(), day.max()

    def x(days):
        t = (days - first) / max(end - first, 1)
        waves = [f(days * 2 * np.pi / additive.YEAR_DAYS * k) for k in range(1, additive.FOURIER_ORDER + 1) for f in (np.sin, np.cos)]
        return np.column_stack([np.ones_like(t), t, *[np.maximum(t - k, 0) for k in additive.KNOTS], *waves])

    penalty = np.eye(additive.WIDTH) * additive.RIDGE * len(y)
    penalty[0, 0] = 0
    beta = np.linalg.solve(x(day).T @ x(day) + penalty, x(day).T @ y)
    size = np.abs(beta[2:2 + additive.CHANGEPOINTS]).mean()
    start = last + timedelta(days=(6 - last.weekday()) or 7)
    out = {}
    for k in range(weeks):
        ds = start + timedelta(weeks=k)
        d = np.array([(ds - date(1970, 1, 1)).days], dtype=float)
        ahead = (d[0] - first) / max(end - first, 1) - 1
        width = INTERVAL_Z * np.sqrt(np.mean((y - x(day) @ beta) ** 2) + 2 * size ** 2 * additive.CHANGEPOINTS / 3 * ahead ** 3)
        out[ds] = ((x(d) @ beta)[0], width)
    return out


def test_additive_matches_numpy_and_widens(spark):
    early, late = history(100, carrier="A"), history(150, slope=-1, carrier="B")
    out = additive.forecast_by_carrier_additive(staging(spark, early + late), 60).collect()
    for name, data in (("A", early), ("B", late)):
        hand = ridge_by_hand(data, week(149), 60)
        mine = sorted((r for r in out if r.Carrier == name), key=lambda r: r.ds)
        assert {r.ds for r in mine} == set(hand)
        for r in mine:
            assert (r.yhat, r.yhat_upper - r.yhat, r.yhat - r.yhat_lower) == pytest.approx((hand[r.ds][0], *[hand[r.ds][1]] * 2), abs=0.02)
        widths = [r.yhat_upper - r.yhat_lower for r in mine]
        assert all(b > a - 0.03 for a, b in zip(widths, widths[1:])) and widths[-1] > widths[0]  # of two digits


def test_additive_own_horizon_gives_fewer_weeks_to_series_that_stopped(spark):
    src = staging(spark, history(100, carrier="A") + history(120, slope=-1, carrier="B"))
    plain = {(r.Carrier, r.ds): r.yhat for r in additive.forecast_by_carrier_additive(src, 40).collect()}
    own = {(r.Carrier, r.ds): r.yhat for r in additive.forecast_by_carrier_additive(src, 40, own_horizon=True).collect()}
    assert sum(k[0] == "A" for k in own) == 20 and sum(k[0] == "B" for k in own) == 40
    assert all(plain[k] == v for k, v in own.items())


def test_additive_fits_short_and_constant_series(spark):
    one = additive.forecast_overall_additive(staging(spark, [{"Week_Date": week(0), "Passenger_Departures": 42}]), 2).collect()
    assert [r.yhat for r in one] == [42, 42]
    flat = [{"Week_Date": week(i), "Passenger_Departures": 70} for i in range(60)]
    assert {r.yhat for r in additive.forecast_overall_additive(staging(spark, flat), 30).collect()} == {70}
    assert additive.forecast_overall_additive(staging(spark, flat).where("false"), 3).collect() == []


def test_additive_leaves_no_residual_and_needs_no_python(spark):
    src = staging(spark, history(100, carrier="A") + history(120, slope=-1, carrier="B"))
    assert [tuple(r) for r in additive.additive_residuals(src).orderBy("Carrier").collect()] == [("A", True), ("B", True)]
    plan = additive.forecast_by_carrier_additive(src, 5)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def forecast_rows(df):
    return df.orderBy("ds").collect()


# ---- features ---------------------------------------------------------------------------------------

def feature_data():
    rng = np.random.default_rng(3)
    out = []
    for i in range(300):
        base = int(rng.integers(100, 1000))
        out.append({"Week_Date": week(i % 150), "Carrier_Name": "AB"[i // 150], "Baseline_2019_Passengers": base,
                    "Passenger_Departures": 2 * base + int(rng.integers(0, 20)),
                    "Avg_Temp_F": float(rng.integers(20, 90))})
    return out


def test_importance_finds_the_driver(spark):
    got = features.feature_importance(staging(spark, feature_data()), trees=10, depth=5).collect()
    assert got[0].Feature == "Baseline_2019_Passengers" and got[0].Importance > 0.9
    assert sum(r.Importance for r in got) == pytest.approx(1.0) and len(got) == 15
    assert [r.Importance for r in got] == sorted((r.Importance for r in got), reverse=True)


def test_correlation_matches_numpy(spark):
    data = feature_data()
    got = {r.Feature: r.Correlation for r in features.feature_correlation(staging(spark, data)).collect()}
    y = [d["Passenger_Departures"] for d in data]
    assert got["Baseline_2019_Passengers"] == pytest.approx(
        np.corrcoef([d["Baseline_2019_Passengers"] for d in data], y)[0, 1], abs=1e-6)
    assert got["Is_Holiday"] is None  # constant column


def test_incomplete_rows_are_dropped(spark):
    src = staging(spark, [{"Week_Date": week(0), "Baseline_2019_Passengers": 1},
                          {"Week_Date": week(1)},
                          {"Week_Date": week(2), "Baseline_2019_Passengers": 1, "Is_Holiday": None},
                          {"Week_Date": week(3), "Baseline_2019_Passengers": 1, "Carrier_Name": "Total"}])
    kept = features.feature_rows_complete(src)
    assert [r.Week_Date for r in kept.collect()] == [week(0)]
    assert set(FEATURE_COLUMNS) <= set(kept.columns)
