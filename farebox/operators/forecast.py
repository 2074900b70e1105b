"""Weekly forecasts: linear trend times an ISO-week index, overall and per carrier.

For a series y over weeks t:  trend = a + b t  (least squares),
index(w) = mean of y / trend over ISO week w,  yhat = trend * index.

Bounds widen with the horizon. The history is cut into years; the slopes of y / index within them
change by delta from one to the next. Future changes are taken to come as often and to be as large:
independent, with Laplace scale lambda = mean |delta| and so variance 2 lambda^2 each. A change at time u moves the trend at
u + s by s delta, so h weeks after the last date its variance is  2 lambda^2 r h^3 / 3  with r changes a week. The bounds are
yhat +- z sqrt(sigma^2 + index^2 times that), with sigma the sample deviation of y - yhat over the history.

All carriers are fitted at once: the carrier is a grouping key, never a loop. The input is
one row per week and series, so no group outgrows the number of weeks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.constants import FORECAST_WEEKS, INTERVAL_Z
from farebox.functions.measures import percent_change, ratio
from farebox.operators.rows import members_only, not_null

DIGITS = 4
#: Days between two slopes of the history, and the least number of weeks with a value behind one.
SLOPE_DAYS, SLOPE_WEEKS = 364, 13


def weekly_totals(src: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    """Passengers and buses per week; a week with no known value counts 0."""
    return (
        not_null(members_only(src, include_rollup_rows), "Week_Date").groupBy("Week_Date")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
               for c in ("Passenger_Departures", "Bus_Departures")]))


def weekly_totals_by_carrier(src: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    return (
        not_null(members_only(src, include_rollup_rows), "Week_Date", "Carrier_Name")
        .groupBy(F.col("Carrier_Name").alias("Carrier"), "Week_Date")
        .agg(F.coalesce(F.sum("Passenger_Departures"), F.lit(0)).cast("bigint")
             .alias("Passenger_Departures")))


def sundays_after(last: Column, weeks: int = FORECAST_WEEKS) -> Column:
    """The given number of Sundays strictly after a date."""
    first = F.next_day(last, "SUN")
    return F.sequence(first, F.date_add(first, 7 * (weeks - 1)), F.expr("interval 7 days"))


def with_forecast_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "Year": F.year("ds"), "Month": F.month("ds"), "Week": F.weekofyear("ds")})


def future_calendar(series: DataFrame, weeks: int = FORECAST_WEEKS) -> DataFrame:
    last = series.agg(F.max("Week_Date").alias("last"))
    return with_forecast_parts(last.select(F.explode(sundays_after(F.col("last"), weeks)).alias("ds")))


def attach(df: DataFrame, values: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per-series values beside each row: a join on the keys, or scalars for a single series."""
    if keys:
        return df.join(values.select(*keys, *names), keys)
    return df.withColumns({n: values.select(n).scalar() for n in names})


def _week_number(day: str) -> Column:
    return F.unix_date(F.col(day)) / 7.0


def _trend(day: str) -> Column:
    return F.col("intercept") + F.col("slope") * _week_number(day)


def trend_growth(adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: the trend's variance h weeks ahead as a multiple `growth` of h^3, from the slopes of its years.

    `adjusted` has the keys, Week_Date, first (the series' first date), t and the value `y` without its season.
    """
    year = F.floor(F.datediff("Week_Date", "first") / SLOPE_DAYS)
    slopes = (adjusted.groupBy(*keys, year.alias("_year"))
              .agg(F.regr_slope("y", "t").alias("slope"), F.regr_count("y", "t").alias("n"))
              .where((F.col("n") >= SLOPE_WEEKS) & F.col("slope").isNotNull()))
    # one element per year of the history
    ordered = slopes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_year", "slope"))).alias("_slopes"))
    changes = ordered.withColumn("_changes", F.expr(
        "transform(slice(_slopes, 2, size(_slopes)), (s, i) -> abs(s.slope - _slopes[i].slope))"))
    mean = F.expr("aggregate(_changes, 0D, (a, x) -> a + x)") / F.nullif(F.size("_changes"), F.lit(0))
    # rounded, so that the order in which a slope was summed cannot show
    return changes.select(*keys, F.round(mean, 6).alias("lambda"), F.size("_changes").alias("changes"))


def forecast_series(series: DataFrame, keys: list[str], weeks: int = FORECAST_WEEKS,
                    own_horizon: bool = False) -> DataFrame:
    """Forecast every series told apart by `keys` (none: one series).

    All series share one calendar that starts after the last date of all. `own_horizon`
    starts each at its own last date and keeps what lies past the common one, so a series
    that stopped early gets fewer weeks.
    """
    y, t = F.col("y"), F.col("t")
    history = series.select(
        *keys, "Week_Date", F.col("Passenger_Departures").cast("double").alias("y"),
        _week_number("Week_Date").alias("t"), F.weekofyear("Week_Date").alias("Week"))
    slope = F.coalesce(F.regr_slope(y, t), F.lit(0.0))
    params = history.groupBy(*keys).agg(
        slope.alias("slope"), (F.avg(y) - slope * F.avg(t)).alias("intercept"),
        F.min("Week_Date").alias("first"), F.max("Week_Date").alias("last"))
    fitted = attach(history, params, keys, ["slope", "intercept", "first"]).withColumn("trend", _trend("Week_Date"))
    index = fitted.groupBy(*keys, "Week").agg(
        F.avg(F.try_divide(y, F.col("trend"))).alias("week_index"))
    seasonal = F.coalesce("week_index", F.lit(1.0))
    indexed = fitted.join(index, [*keys, "Week"])
    sigma = indexed.groupBy(*keys).agg(
        F.coalesce(F.stddev_samp(y - F.col("trend") * seasonal), F.lit(0.0)).alias("sigma"),
        F.min("t").alias("_from"), F.max("t").alias("_to"))
    growth = trend_growth(indexed.withColumn("y", F.try_divide(y, F.col("week_index"))), keys)
    spread = sigma.join(growth, keys, "left") if keys else attach(sigma, growth, keys, ["lambda", "changes"])
    spread = spread.select(*keys, "sigma", "_to", F.coalesce(F.try_divide(
        2 * F.col("lambda") * F.col("lambda") * F.col("changes"), 3 * (F.col("_to") - F.col("_from"))), F.lit(0.0)).alias("growth"))

    common_last = series.agg(F.max("Week_Date").alias("last"))
    if keys:
        start = F.col("last") if own_horizon else common_last.scalar()
        future = params.select(*keys, "slope", "intercept",
                               F.explode(sundays_after(start, weeks)).alias("ds"))
        if own_horizon:
            future = future.where(F.col("ds") > common_last.scalar())
    else:
        future = attach(
            common_last.select(F.explode(sundays_after(F.col("last"), weeks)).alias("ds")),
            params, keys, ["slope", "intercept"])
    future = with_forecast_parts(future).withColumn("trend", _trend("ds"))
    future = attach(future.join(index, [*keys, "Week"], "left"), spread, keys, ["sigma", "_to", "growth"])
    ahead = _week_number("ds") - F.col("_to")
    yhat = F.col("trend") * seasonal
    band = INTERVAL_Z * F.sqrt(F.col("sigma") * F.col("sigma") + seasonal * seasonal * F.col("growth") * ahead * ahead * ahead)
    return future.select(
        *keys, "ds", F.round(yhat, DIGITS).alias("yhat"),
        F.round(yhat - band, DIGITS).alias("yhat_lower"),
        F.round(yhat + band, DIGITS).alias("yhat_upper"), "Year", "Month", "Week")


def forecast_overall(src: DataFrame, weeks: int = FORECAST_WEEKS,
                     include_rollup_rows: bool = False) -> DataFrame:
    return forecast_series(weekly_totals(src, include_rollup_rows), [], weeks)


def forecast_by_carrier(src: DataFrame, weeks: int = FORECAST_WEEKS, own_horizon: bool = False,
                        include_rollup_rows: bool = False) -> DataFrame:
    return forecast_series(
        weekly_totals_by_carrier(src, include_rollup_rows), ["Carrier"], weeks, own_horizon)


# ---- roll-ups --------------------------------------------------------------------------
# Rounded values add up as decimals: sums and means are exact whatever the order of arrival.

def _exact(column: str) -> Column:
    return F.col(column).cast(f"decimal(18,{DIGITS})")


def _sum(column: str) -> Column:
    return F.sum(_exact(column)).cast("double")


def _mean(column: str) -> Column:
    return ratio(F.sum(_exact(column)), F.count(column).cast("decimal(10,0)"), DIGITS).cast("double")


def _is_full_year() -> Column:
    """The year holds its first and its last Sunday."""
    year = F.col("Year")
    return ((F.min("ds") <= F.make_date(year, F.lit(1), F.lit(7)))
            & (F.max("ds") >= F.make_date(year, F.lit(12), F.lit(25))))


def forecast_annual(forecast: DataFrame) -> DataFrame:
    """Yearly sums. `Lower_Bound` and `Upper_Bound` add the weekly bounds up; the RSS pair
    treats weekly errors as independent."""
    total = _sum("yhat")
    low = F.sqrt(F.sum((F.col("yhat") - F.col("yhat_lower")) ** 2))
    high = F.sqrt(F.sum((F.col("yhat_upper") - F.col("yhat")) ** 2))
    return forecast.groupBy("Year").agg(
        total.alias("Projected_Passengers"),
        _sum("yhat_lower").alias("Lower_Bound"),
        _sum("yhat_upper").alias("Upper_Bound"),
        F.round(total - low, DIGITS).alias("Lower_Bound_RSS"),
        F.round(total + high, DIGITS).alias("Upper_Bound_RSS"),
        _is_full_year().alias("Is_Full_Year"))


def carrier_forecast_annual(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("Carrier", "Year").agg(
        _sum("yhat").alias("Projected_Passengers"),
        _is_full_year().alias("Is_Full_Year"))


def full_years(annual: DataFrame, only: bool = True) -> DataFrame:
    return annual.where("Is_Full_Year") if only else annual


def carrier_forecast_summary(annual: DataFrame, full_years_only: bool = True) -> DataFrame:
    """Mean yearly volume per carrier, highest first."""
    return (full_years(annual, full_years_only).groupBy("Carrier")
            .agg(_mean("Projected_Passengers").alias("Avg_Annual_Passengers"))
            .orderBy(F.desc("Avg_Annual_Passengers"), "Carrier"))


def _in_full_years(forecast: DataFrame, only: bool) -> DataFrame:
    """Weeks of the years that the forecast covers from the first to the last Sunday."""
    if not only:
        return forecast
    years = forecast.groupBy("Year").agg(_is_full_year().alias("full")).where("full").select("Year")
    return forecast.join(years, "Year", "left_semi")


def busiest_weeks(forecast: DataFrame, full_years_only: bool = False) -> DataFrame:
    """Mean volume per ISO week over the whole forecast, partial years included unless left out."""
    return (_in_full_years(forecast, full_years_only).groupBy(F.col("Week").alias("Week_of_Year"))
            .agg(_mean("yhat").alias("Avg_Passengers"))
            .orderBy(F.desc("Avg_Passengers"), "Week_of_Year"))


def busiest_months(forecast: DataFrame, full_years_only: bool = False) -> DataFrame:
    """Mean weekly volume per month over the whole forecast, partial years included unless left out."""
    return (_in_full_years(forecast, full_years_only).groupBy("Month")
            .agg(_mean("yhat").alias("Avg_Passengers"))
            .withColumn("Month_Name", F.date_format(
                F.make_date(F.lit(2000), F.col("Month"), F.lit(1)), "MMMM"))
            .orderBy(F.desc("Avg_Passengers"), "Month"))


def monthly_series(src: DataFrame, forecast: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    """Monthly history and forecast as one series, told apart by `Series`."""
    history = (
        not_null(members_only(src, include_rollup_rows), "Week_Date")
        .groupBy(F.trunc("Week_Date", "month").alias("Month_Start"))
        .agg(F.coalesce(F.sum("Passenger_Departures"), F.lit(0)).cast("double").alias("Passengers"))
        .withColumn("Series", F.lit("Historical")))
    future = (
        forecast.groupBy(F.trunc("ds", "month").alias("Month_Start"))
        .agg(_sum("yhat").alias("Passengers"))
        .withColumn("Series", F.lit("Forecast")))
    return history.unionByName(future).orderBy("Month_Start", "Series")


# ---- comparison with the baseline year --------------------------------------------------

def baseline_total(src: DataFrame, baseline_year: int, include_rollup_rows: bool = False) -> DataFrame:
    """One row: passengers of the baseline year, 0 when it has no rows."""
    in_year = F.col("Year") == baseline_year
    return members_only(src, include_rollup_rows).agg(
        F.coalesce(F.sum(F.when(in_year, F.col("Passenger_Departures"))), F.lit(0))
        .cast("bigint").alias("baseline"))


def baseline_comparison(annual: DataFrame, src: DataFrame, baseline_year: int,
                        include_rollup_rows: bool = False) -> DataFrame:
    """Forecast years against the baseline total; the percentage is NULL on a zero baseline."""
    base = baseline_total(src, baseline_year, include_rollup_rows).scalar().cast("double")
    return annual.select(
        "Year", "Projected_Passengers", "Lower_Bound", "Upper_Bound", "Is_Full_Year",
        base.alias("Baseline_2019"),
    ).withColumns({
        "Difference": F.round(F.col("Projected_Passengers") - F.col("Baseline_2019"), DIGITS),
        "Percent_Change": F.round(percent_change("Projected_Passengers", "Baseline_2019"), DIGITS)})


def forecast_cagr(annual: DataFrame) -> DataFrame:
    """Compound yearly growth between the first and the last full year."""
    value, year = F.col("Projected_Passengers"), F.col("Year")
    ends = full_years(annual).agg(
        F.min(year).alias("First_Year"), F.max(year).alias("Last_Year"),
        F.min_by(value, year).alias("First_Volume"), F.max_by(value, year).alias("Last_Volume"))
    span = F.col("Last_Year") - F.col("First_Year")
    growth = F.pow(F.try_divide(F.col("Last_Volume"), F.col("First_Volume")),
                   F.try_divide(F.lit(1.0), span.cast("double"))) - 1
    return ends.withColumn("Cagr_Percent", F.round(
        F.when((F.col("First_Volume") > 0) & (F.col("Last_Volume") > 0), growth * 100), DIGITS))


def forecast_findings(annual: DataFrame, weeks: DataFrame, months: DataFrame, src: DataFrame,
                      baseline_year: int, full_years_only: bool = True,
                      include_rollup_rows: bool = False) -> DataFrame:
    """One row of headline figures."""
    value, year = F.col("Projected_Passengers"), F.col("Year")
    top = full_years(annual, full_years_only).agg(
        _mean("Projected_Passengers").alias("Avg_Annual_Passengers"),
        F.min_by(year, F.struct(-value, year)).alias("Peak_Year"),
        F.max(value).alias("Peak_Volume"))
    load = F.col("Avg_Passengers")
    week, month = F.col("Week_of_Year"), F.col("Month")
    return top.withColumns({
        "Busiest_Week": weeks.select(F.min_by(week, F.struct(-load, week))).scalar(),
        "Busiest_Month": months.select(F.min_by(F.col("Month_Name"), F.struct(-load, month))).scalar(),
        "Baseline_2019": baseline_total(src, baseline_year, include_rollup_rows).scalar(),
    }).withColumn("Change_Percent", F.round(
        percent_change("Avg_Annual_Passengers", "Baseline_2019"), DIGITS))
