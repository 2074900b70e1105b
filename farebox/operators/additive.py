"""Additive forecast: piecewise-linear trend with changepoints plus yearly Fourier terms.

A ridge regression for every series at once. The normal equations X'X and X'y are sums over the weeks: a
row of the design enters them by one grouped aggregate with partial sums, so neither a long history nor many series
meet in one task. What is left per series is a matrix of 27 x 27 numbers, solved by array functions: the
penalty makes it positive definite, so elimination needs no pivots.

Bounds: the hinge coefficients are the changes of slope of the history. Future changes are taken to come as often and
to be as large (Laplace scale lambda = their mean size), which gives the trend the variance 2 lambda^2 C h^3 / 3 at h histories
behind the last date, with C changes a history; it is added to the mean squared residual.

Values differ from other fitters of the same model family; columns and bounds have the same meaning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.constants import FORECAST_WEEKS, INTERVAL_Z
from farebox.operators.forecast import (
    attach, sundays_after, weekly_totals, weekly_totals_by_carrier, with_forecast_parts)

CHANGEPOINTS = 12
CHANGEPOINT_RANGE = 0.8
FOURIER_ORDER = 6
YEAR_DAYS = 365.25
RIDGE = 0.05
#: Digits of the forecast; sums of doubles differ beyond them by the order of their rows.
DIGITS = 2

KNOTS = [CHANGEPOINT_RANGE * (i + 1) / (CHANGEPOINTS + 1) for i in range(CHANGEPOINTS)]
#: Columns of the design: constant, time, hinges, sines and cosines.
WIDTH = 2 + CHANGEPOINTS + 2 * FOURIER_ORDER


def scaled_time(day: str) -> Column:
    """0 at the first and 1 at the last day of the history."""
    return (F.col(day) - F.col("first")) / F.greatest(F.col("last") - F.col("first"), F.lit(1)).cast("double")


def design(day: str) -> Column:
    t = scaled_time(day)
    hinges = [F.greatest(t - knot, F.lit(0.0)) for knot in KNOTS]
    turn = F.col(day) * (2 * math.pi / YEAR_DAYS)
    waves = [f(turn * k) for k in range(1, FOURIER_ORDER + 1) for f in (F.sin, F.cos)]
    return F.array(F.lit(1.0), t, *hinges, *waves)


def normal_equations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, `m`: the rows of (X'X + penalty | X'y), from rows with the design `x` and the value `y`."""
    extended = rows.select(*keys, F.concat("x", F.array("y")).alias("z"))
    sums = (extended.select(*keys, "z", F.posexplode(F.slice("z", 1, WIDTH)).alias("i", "xi"))
            .groupBy(*keys, "i").agg(F.array(*[F.sum(F.col("xi") * F.col("z")[j]) for j in range(WIDTH + 1)]).alias("row")))
    # one row per column of the design
    held = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("held"))
    # the constant is not penalised; its own sum is the number of weeks
    return held.select(*keys, F.expr(f"""transform(held, r -> transform(r.row, (v, j) ->
        if(j = r.i and j > 0, v + {RIDGE!r}D * held[0].row[0], v)))""").alias("m"))


def solved(equations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, `beta`: the coefficients."""
    reduced = F.expr(f"""aggregate(sequence(0, {WIDTH - 1}), m, (a, k) -> transform(a, (row, i) ->
        if(i = k, row, zip_with(row, a[k], (v, p) -> v - row[k] / a[k][k] * p))))""")
    return (equations.select(*keys, reduced.alias("reduced"))
            .select(*keys, F.expr(f"transform(reduced, (row, i) -> row[{WIDTH}] / row[i])").alias("beta")))


def _value(x: str = "x") -> Column:
    return F.expr(f"aggregate(zip_with({x}, beta, (a, b) -> a * b), 0D, (s, v) -> s + v)")


def fitted(series: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with design and value, and per series: first, last, beta, the mean squared residual and the trend's growth."""
    days = series.select(*keys, F.unix_date("Week_Date").alias("day"), F.col("Passenger_Departures").cast("double").alias("y"))
    span = days.groupBy(*keys).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    rows = attach(days, span, keys, ["first", "last"]).select(*keys, "y", "first", "last", design("day").alias("x"))
    beta = solved(normal_equations(rows, keys), keys)
    miss = attach(rows, beta, keys, ["beta"]).groupBy(*keys).agg(F.avg(F.pow(F.col("y") - _value(), 2)).alias("miss"))
    size = F.expr(f"aggregate(slice(beta, 3, {CHANGEPOINTS}), 0D, (s, v) -> s + abs(v)) / {CHANGEPOINTS}")
    model = (attach(attach(span, beta, keys, ["beta"]), miss, keys, ["miss"])
             .withColumn("growth", 2 * size * size * CHANGEPOINTS / 3))
    return rows, model


def residual(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: the largest entry of X'(y - X beta) - penalty beta, against the largest of X'y. 0 up to rounding."""
    left = attach(rows, model, keys, ["beta"]).withColumn("miss", F.col("y") - _value())
    parts = (left.select(*keys, "y", "miss", "beta", F.posexplode("x").alias("i", "xi")).groupBy(*keys, "i")
             .agg(F.sum(F.col("xi") * F.col("miss")).alias("r"), F.sum(F.col("xi") * F.col("y")).alias("q"),
                  F.count("*").alias("n"), F.first(F.col("beta")[F.col("i")]).alias("b")))
    penalty = F.when(F.col("i") > 0, RIDGE * F.col("n") * F.col("b")).otherwise(0.0)
    return parts.groupBy(*keys).agg(F.max(F.abs(F.col("r") - penalty)).alias("residual"), F.max(F.abs("q")).alias("scale"))


def _fit_each(series: DataFrame, keys: list[str], weeks: int, own_horizon: bool = False) -> DataFrame:
    """A forecast per series, on the Sundays after the last date of all; `own_horizon` as in `forecast_series`."""
    _, model = fitted(series, keys)
    common = series.select(F.max("Week_Date")).scalar()
    start = F.date_from_unix_date("last") if own_horizon else common
    future = model.withColumn("ds", F.explode(sundays_after(start, weeks)))
    if own_horizon:
        future = future.where(F.col("ds") > common)
    future = future.withColumn("day", F.unix_date("ds")).withColumn("x", design("day")).withColumn("ahead", scaled_time("day") - 1)
    yhat = _value()
    band = INTERVAL_Z * F.sqrt(F.col("miss") + F.col("growth") * F.col("ahead") * F.col("ahead") * F.col("ahead"))
    return future.select(*keys, "ds", F.round(yhat, DIGITS).alias("yhat"), F.round(yhat - band, DIGITS).alias("yhat_lower"),
                         F.round(yhat + band, DIGITS).alias("yhat_upper"))


def forecast_overall_additive(src: DataFrame, weeks: int = FORECAST_WEEKS,
                              include_rollup_rows: bool = False) -> DataFrame:
    """The totals of all carriers as one series, one row per week."""
    return with_forecast_parts(_fit_each(weekly_totals(src, include_rollup_rows), [], weeks))


def forecast_by_carrier_additive(src: DataFrame, weeks: int = FORECAST_WEEKS, own_horizon: bool = False,
                                 include_rollup_rows: bool = False) -> DataFrame:
    """Every carrier on the calendar that starts after the last date of all."""
    return with_forecast_parts(_fit_each(weekly_totals_by_carrier(src, include_rollup_rows), ["Carrier"], weeks, own_horizon))


def additive_residuals(src: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    """Carriers whose fit leaves a residual of the normal equations beyond rounding; none should."""
    series = weekly_totals_by_carrier(src, include_rollup_rows)
    rows, model = fitted(series, ["Carrier"])
    left = residual(rows, model, ["Carrier"])
    return left.select("Carrier", (F.col("residual") <= 1e-9 * F.greatest("scale", F.lit(1.0))).alias("Solved"))
