"""Classification by a table of periods, overlaps, and sketches of distinct carriers."""

from datetime import date, timedelta

import random

from farebox.operators import periods, summaries

PERIODS = "first date, last date, label string"


def by_hand(day, table):
    held = [(f is not None, f or date.min, label) for f, last, label in table
            if (f is None or f <= day) and (last is None or day <= last) and (f is None or last is None or f <= last)]
    return max(held)[2] if held else None


def classified(spark, days, table):
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "d date, day int")
    out = periods.classify_by_table(df, "d", spark.createDataFrame(table, PERIODS), "p")
    assert out.columns == ["d", "day", "p"]
    return {r.day: r.p for r in out.collect()}


def test_open_ends_gaps_overlaps_and_missing_days(spark):
    table = [(None, date(2020, 2, 10), "before"), (date(2020, 2, 1), date(2020, 2, 5), "inner"), (date(2020, 3, 1), None, "after"),
             (date(2020, 3, 1), date(2020, 3, 2), "b"), (date(2020, 6, 1), date(2020, 5, 1), "backwards")]
    days = [date(2020, 1, 1) + timedelta(days=k) for k in range(0, 200, 1)] + [None]
    got = classified(spark, days, table)
    assert got == {i: None if d is None else by_hand(d, table) for i, d in enumerate(days)}
    assert classified(spark, [None], table) == {0: None}
    assert classified(spark, days[:2], []) == {0: None, 1: None}


def test_ten_thousand_periods_need_no_chain_of_conditions(spark):
    rng = random.Random(1)
    table = []
    for k in range(10_000):
        first = date(1990, 1, 1) + timedelta(days=rng.randrange(12_000))
        table.append((first, first + timedelta(days=rng.randrange(40)), f"p{k}"))
    days = [date(1990, 1, 1) + timedelta(days=rng.randrange(12_100)) for _ in range(60)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    out = periods.classify_by_table(df, "d", spark.createDataFrame(table, PERIODS), "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("CASE WHEN") < 20
    assert sorted((r.d, r.p) for r in out.collect() if r.p) == sorted((d, by_hand(d, table)) for d in days if by_hand(d, table))


def test_overlaps_are_listed(spark):
    table = [(date(2020, 1, 1), date(2020, 1, 31), "a"), (date(2020, 1, 31), date(2020, 2, 9), "b"),
             (date(2020, 2, 10), None, "c"), (date(2020, 2, 12), date(2020, 2, 12), "d"), (date(2020, 2, 12), date(2020, 2, 12), "d"),
             (None, date(2019, 1, 1), "e")]
    out = {(r.label, r.others) for r in periods.period_overlaps(spark.createDataFrame(table, PERIODS)).collect()}
    assert out == {("b", 1), ("d", 2)}


def test_sketches_of_months_merge_to_quarters(spark):
    star = spark.range(60_000).selectExpr(
        "cast(2020 as int) as Year", "cast(1 + id % 3 as int) as Month", "cast(1 as int) as Quarter",
        "concat('carrier ', id % 20000) as Carrier_Name")
    row = summaries.carriers_by_sketch(star).first()
    assert row.Unique_Carriers == 20_000 and abs(row.Carriers_Estimate - 20_000) < 0.02 * 20_000
    assert summaries.carriers_by_sketch(star.where("false")).collect() == []
