"""Dates, labels, ratios, flags."""

from datetime import date, datetime

import pytest
from farebox.functions import calendar, measures
from pyspark.sql import functions as F

# All sheet labels by year.
LABELS = {
    2020: ["Dec 7-11", "Dec. 14-18", "Dec. 21-25", "Dec. 28-Jan 1"],
    2021: [
        "Jan 4-8", "Jan. 11-15", "Jan. 18-22", "Jan. 25-29", "Feb. 1-5", "Feb. 8-12", "Feb 15-19",
        "Feb 22-26", "March 1-5", "March 8-12", "March 15-19", "March 22-26", "March 29-April 2",
        "April 5-9", "April 12-16", "April 19-23", "April 26-30", "May 3-7", "May 10-14", "May 17-21",
        "May 24-28", "May 31-June 4", "June 7-11", "June 14-18", "June 21-25", "June 28-July 2",
        "July 5-9", "July 12-16", "July 19-23", "July 26-30", "Aug 2-6", "Aug 9-13", "Aug 16-20",
        "Aug 23-27", "Aug 30-Sept 3", "Sept 7-10", "Sept 13-17", "Sept 20-24", "Sept 27-Oct 1",
        "Oct 4-8", "Oct 11-15", "Oct 18-22", "Oct 25-29", "Nov 1-5", "Nov 8-12", "Nov 15-19",
        "Nov 22-26", "Nov 29-Dec 3", "Dec 6-10", "Dec 13-17", "Dec 20-24", "Dec 27-31"],
    2023: [
        "Mar 27-31", "April 10-14", "April 24-28", "May 8-12", "May 22-26", "June 5-9", "June 19-23",
        "July 3-7", "July 17-21", "July 31 - Aug 4", "August 14-18", "Aug 28 - Sept 1", "Sept 11-15",
        "Sept 25-29", "Oct 9-13", "Oct 23-27", "Nov 6-10", "Nov 13-17", "Dec 4-8", "Dec. 18-22"],
    2024: [
        "Jan 2-5", "Jan 15-19", "Jan 29 - Feb 2", "Feb 12-16", "Feb 26 - March 1", "March 11-15",
        "March 25-29", "April 8-12", "April 22-26", "May 6-10", "May 20-24", "June 3-7", "June 17-21",
        "July 1-5", "July 15-19", "July 29 - Aug 2", "Aug 12-16", "Aug 26-30", "Sept 9-13", "Sept 23-27",
        "Oct 7-11", "Oct 21-25", "Nov 4-8", "Nov 18-22", "Dec 2-6", "Dec 16-20"],
    2025: [
        "Jan 6-10, 2025", "Jan 20-24, 2025", "Feb 3-7, 2025", "Feb 17-21, 2025", "March 3-7, 2025",
        "March 17-21, 2025", "March 31-April 4, 2025", "April 14-18, 2025", "April 28-May 2, 2025",
        "May 12-16, 2025", "May 26-30, 2025", "June 9-13, 2025", "June 23-27, 2025", "July 7-11, 2025",
        "July 21-25, 2025"],
}


def parse(spark, labels, **options):
    df = spark.createDataFrame(labels, "Week_Label string, Label_Year int")
    out = calendar.with_week_ending(df, **options).collect()
    return {(r.Week_Label, r.Label_Year): (r.Week_Date, r.Week_Date_Defaulted) for r in out}


def test_every_label_ends_on_a_friday(spark):
    pairs = [(label, year) for year, labels in LABELS.items() for label in labels]
    assert len(pairs) == 117
    parsed = parse(spark, pairs)
    assert len(parsed) == 117
    assert not any(defaulted for _, defaulted in parsed.values())
    # one label of each year-end crosses into the next year; every sheet covers a working week
    for (label, year), (day, _) in parsed.items():
        assert day.weekday() == 4, label
        assert day.year == (2021 if label == "Dec. 28-Jan 1" else year), label
        tail = label.split("-")[-1].split(",")[0].split()[-1]
        assert day.day == int(tail), label


@pytest.mark.parametrize("label, year, expected, defaulted", [
    ("March 31-April 4, 2025", 2025, date(2025, 4, 4), False),
    ("Jan 6-10, 2025", 2025, date(2025, 1, 10), False),
    ("Feb 15-19", 2021, date(2021, 2, 19), False),
    ("Sept 7-10", 2021, date(2021, 9, 10), False),
    ("July 31 - Aug 4", 2023, date(2023, 8, 4), False),
    ("  Dec. 21-25  ", 2020, date(2020, 12, 25), False),
    ("junk", 2021, date(2021, 1, 1), True),
    ("Feb 25-31", 2021, date(2021, 1, 1), True),
    ("Foo 5-9", 2021, date(2021, 1, 9), False),
    ("Aug. 2-6", 2021, date(2021, 1, 1), True),
    ("Jan 4-x", 2021, date(2021, 1, 1), True),
])
def test_label_cases(spark, label, year, expected, defaulted):
    assert parse(spark, [(label, year)])[(label, year)] == (expected, defaulted)


def test_year_rollover_both_ways(spark):
    key = ("Dec. 28-Jan 1", 2020)
    assert parse(spark, [key])[key][0] == date(2021, 1, 1)
    assert parse(spark, [key], fix_year_rollover=False)[key][0] == date(2020, 1, 1)


def one(spark, schema, values, *columns):
    return tuple(spark.createDataFrame([values], schema).select(*columns).first())


def test_safe_date(spark):
    df = spark.createDataFrame([("12/11/2020",), ("2020-12-11",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(calendar.safe_date("t")).collect()] == [
        date(2020, 12, 11), date(2020, 12, 11), None, None]


def test_date_keys(spark):
    assert one(spark, "d date, y int, m int", (date(2021, 3, 5), 2021, 4),
               calendar.date_key("d"), calendar.date_key_from_parts("y", "m", "d")) == (20210305, 20210405)


def test_week_friday_of_every_weekday(spark):
    df = spark.createDataFrame([(datetime(2021, 3, d, 23, 59),) for d in range(1, 8)], "t timestamp")
    assert {r[0] for r in df.select(calendar.week_friday("t")).collect()} == {date(2021, 3, 5)}


def test_date_parts(spark):
    df = spark.createDataFrame([(date(2021, 1, 1),), (date(2021, 7, 2),)], "Week_Date date")
    got = calendar.with_date_parts(df).collect()
    assert (got[0].Week_of_Year, got[0].Season, got[0].Fiscal_Year, got[0].Day_of_Week) == (
        53, "Winter", 2020, "Friday")
    assert (got[1].Quarter, got[1].Month_Name, got[1].Season, got[1].Fiscal_Year) == (3, "July", "Summer", 2021)


@pytest.mark.parametrize("passengers, buses, expected", [
    (100, 3, 33.33), (201, 200, 1.01), (5, 0, None), (5, None, None), (None, 5, None), (5, -1, None)])
def test_passengers_per_bus(spark, passengers, buses, expected):
    got, = one(spark, "p bigint, b bigint", (passengers, buses), measures.passengers_per_bus("p", "b"))
    assert (None if got is None else float(got)) == expected


def test_to_number(spark):
    df = spark.createDataFrame([("12",), (" 1.5 ",), ("n/a",), ("nan",), (None,), ("1,234",)], "t string")
    assert [r[0] for r in df.select(measures.to_number("t")).collect()] == [12.0, 1.5, None, None, None, None]


def test_flag(spark):
    df = spark.createDataFrame([("True",), ("true",), (" TRUE ",), ("False",), ("1",), (None,)], "t string")
    assert [r[0] for r in df.select(measures.flag("t")).collect()] == [1, 1, 1, 0, 0, 0]


def test_percentages_survive_zero(spark):
    got = one(spark, "a bigint, b bigint", (5, 0), measures.percent_of("a", "b"), measures.percent_change("a", "b"))
    assert got == (None, None)


def test_classify(spark):
    df = spark.createDataFrame([(date(2019, 1, 1),), (date(2020, 3, 1),), (date(2022, 1, 1),),
                                (date(2024, 1, 1),), (None,)], "d date")
    label = measures.classify("d", [("2020-03-01", "During"), ("2022-01-01", "Post"), ("2024-01-01", None)], "Pre")
    assert [r[0] for r in df.select(label).collect()] == ["Pre", "During", "Post", None, None]


def test_status_of_year(spark):
    df = spark.createDataFrame([(y,) for y in (2019, 2020, 2021, 2023, 2024)], "y int")
    assert [r[0] for r in df.select(measures.status_of_year("y")).collect()] == [
        "Normal", "Lockdown", "Recovery", "Recovery", "Normal"]


def test_big_counts_do_not_overflow(spark):
    got = one(spark, "p bigint, b bigint", (9_000_000_000_000, 7), measures.passengers_per_bus("p", "b"),
              measures.percent_of("p", "b"), F.lit(1))
    assert float(got[0]) == pytest.approx(9e12 / 7, abs=0.01) and got[1] is not None


def test_ratio_equals_decimal_arithmetic(spark):
    """Random whole numbers against Python's decimals, rounded half up."""
    import random
    from decimal import ROUND_HALF_UP, Decimal, localcontext
    draw = random.Random(5)
    pairs = [(draw.randint(-10 ** draw.randint(1, 12), 10 ** draw.randint(1, 12)), draw.randint(0, 10 ** draw.randint(1, 9)))
             for _ in range(2000)] + [(1, 8), (-1, 8), (201, 200), (5, 1000), (15, 1000)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = df.select("n", "d", measures.mean_of_whole(F.col("n"), F.col("d")).alias("q")).collect()
    with localcontext() as context:
        context.prec = 60
        for n, d, q in got:
            expected = None if d == 0 else (Decimal(n) / Decimal(d)).quantize(Decimal("0.01"), ROUND_HALF_UP)
            assert q == expected, (n, d)


def test_labels_built_from_parts(spark):
    """Random labels in all spellings; the end day and month are known from how they were built."""
    import random
    from datetime import timedelta
    draw = random.Random(11)
    expected = {}
    for _ in range(400):
        monday = date(2015, 1, 5) + timedelta(weeks=draw.randint(0, 800))
        friday = monday + timedelta(days=4)

        def month(day):
            return draw.choice([day.strftime("%b"), day.strftime("%B")] + (
                [day.strftime("%b") + "."] if day.month in (1, 2, 3, 4, 10, 11, 12) else []))
        dash = draw.choice(["-", " - "])
        tail = f"{friday.day}" if monday.month == friday.month else f"{month(friday)} {friday.day}"
        label = f"{month(monday)} {monday.day}{dash}{tail}" + draw.choice(["", f", {friday.year}"])
        expected[(label, monday.year)] = (friday, False)
    assert parse(spark, list(expected)) == expected
