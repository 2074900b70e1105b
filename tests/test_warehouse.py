"""Dimensions, fact, summaries, ranking and checks on literal rows."""

from datetime import date

import pytest
from farebox.operators import dims, fact, quality, rows as R, summaries
from farebox.operators.keys import dense_key, prefix
from farebox.schemas import MONTHLY_SUMMARY, conform, ensure_column
from pyspark.sql import functions as F
from tests.helpers import rows, staging, week


def load(spark, data):
    src = staging(spark, data)
    tables = {name: df.cache() for name, df in dims.load_dimensions(src).items()}
    return src, tables, fact.load_fact(src, tables).cache()


def test_dense_key_equals_global_row_number(spark):
    names = [f"{chr(97 + i % 5)}{i:03d}" for i in range(200)] + [None]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    got = {r.name: r.k for r in dense_key(df, "k", prefix("name", 1), ["name"]).collect()}
    expected = {n: i + 1 for i, n in enumerate([None, *sorted(n for n in names if n)])}
    assert got == expected


def test_numbering_spreads_equal_beginnings_over_ranges(spark, tmp_path):
    """Names with one long common beginning are dealt over all ranges, and numbers stay those of a global order."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 20_000, 1, 5).select(F.format_string("the same beginning %06d", F.expr("id * 7919 % 20000")).alias("name"))
        numbered = dense_key(df, "k", F.col("name"), [], descending=True, kind="bigint")
        out = numbered.select("k", "name", F.spark_partition_id().alias("p")).collect()
        files = {f.rsplit("/", 1)[1] for f in numbered.inputFiles()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(files) == 6
    assert [r.name for r in sorted(out, key=lambda r: r.k)] == sorted((r.name for r in out), reverse=True)
    assert sorted(r.k for r in out) == list(range(1, 20_001))


def test_numbering_of_no_and_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [(None, 2)], "name string, x int")
    assert sorted(r.k for r in dense_key(df, "k", F.col("name"), ["x"]).collect()) == [1, 2, 3, 4]
    assert dense_key(df.where("false"), "k", F.col("name"), []).collect() == []


def test_members_are_distinct_before_numbering(spark):
    src, tables, _ = load(spark, [{"Week_Date": week(i), "Carrier_Name": c} for i in range(3) for c in "BA"])
    assert rows(tables["dim_carrier"]) == [(1, "A", "Long"), (2, "B", "Long")]
    assert tables["dim_date"].count() == 3


def test_null_members(spark):
    data = [{"Week_Date": week(0), "Avg_Temp_F": None, "Weather_Condition": None},
            {"Week_Date": week(1), "COVID_Period": None}, {"Week_Date": None, "Carrier_Name": "B"},
            {"Week_Date": week(2), "Carrier_Name": None, "Service_Type": None}]
    src, tables, facts = load(spark, data)
    assert (None, "Unknown") in {(r.Avg_Temp_F, r.Weather_Condition) for r in tables["dim_weather"].collect()}
    assert tables["dim_date"].count() == 3
    assert facts.count() == 2  # rows without date or carrier have no fact
    assert facts.where("Weather_Key IS NULL").count() == 0
    assert facts.where("COVID_Key IS NULL").count() == 1


def test_flags_in_any_case(spark):
    _, tables, _ = load(spark, [{"Week_Date": week(0), "Is_Holiday": "true"}, {"Week_Date": week(1), "Is_Holiday": None}])
    assert sorted(r.Is_Holiday for r in tables["dim_date"].collect()) == [0, 1]
    assert {(r.Is_Holiday, r.NYC_Event) for r in tables["dim_event"].collect()} == {(0, "None"), (1, "None")}


def test_no_fan_out_where_the_narrow_weather_key_has_one(spark):
    data = [{"Week_Date": week(0), "Snow_Inches": 0.0}, {"Week_Date": week(1), "Snow_Inches": 2.0}]
    src, tables, facts = load(spark, data)
    assert facts.count() == 2
    check = quality.fact_fanout_check(src, tables["dim_weather"]).first()
    assert (check.Source_Rows, check.Joined_Rows, check.Extra_Rows) == (2, 4, 2)
    literal = fact.load_fact(src, tables, narrow_weather_key=True)
    assert sorted(r.Fact_Key for r in literal.collect()) == [1, 2, 3, 4]


def test_conflicting_attributes_do_not_multiply_facts(spark):
    data = [{"Week_Date": week(0), "Carrier_Full_Name": n, "Is_Holiday": h} for n, h in (("x", "True"), ("y", "False"))]
    _, tables, facts = load(spark, data)
    assert [r.Is_Holiday for r in tables["dim_date"].collect()] == [1]  # one row per date, or the star would multiply
    assert tables["dim_carrier"].count() == 2
    assert facts.count() == 2 and {r.Carrier_Key for r in facts.collect()} == {1}
    from farebox.operators.fact import star_read
    assert star_read(facts, tables).count() == 2
    found = {tuple(r) for r in dims.dim_conflicts(staging(spark, data)).collect()}
    assert found == {("dim_date", str(week(0)), "Is_Holiday", 2), ("dim_carrier", "A", "Carrier_Full_Name", 2)}


def test_leaders_skip_carriers_without_a_value(spark):
    from farebox.operators.kpis import carrier_leaders
    perf = spark.createDataFrame([("A", None, 5), ("C", 2.0, 5), ("B", 2.0, 4)],
                                 "Carrier_Name string, Avg_Passengers_Per_Bus double, Total_Passengers bigint")
    assert tuple(carrier_leaders(perf).first()) == ("B", 2.0, "A", 5)


def test_service_description_suffixes(spark):
    src = staging(spark, [{"Week_Date": week(0)}])
    assert dims.dim_service_type(src).first().Service_Description == "Regional transportation service"
    assert dims.dim_service_type(src, " service").first().Service_Description == "Regional service"


def summary_rows(spark):
    ppb = [(0, "A", 10, 100), (1, "A", 20, 500), (0, "B", 5, 100), (1, "B", 10, 250), (0, "Total", 15, 200)]
    data = [{"Week_Date": week(w), "Carrier_Name": c, "Bus_Departures": b, "Passenger_Departures": p,
             "Passengers_Per_Bus": p / b, "Service_Type": "Aggregate" if c == "Total" else "Regional"}
            for w, c, b, p in ppb]
    _, tables, facts = load(spark, data)
    return fact.star_read(facts, tables)


def test_summaries_leave_the_rollup_row_out(spark):
    star = summary_rows(spark)
    quarter = summaries.quarterly_summary(star).first()
    assert (quarter.Total_Passengers, quarter.Total_Buses, quarter.Unique_Carriers) == (950, 45, 2)
    assert float(quarter.Avg_Passengers_Per_Bus) == 20.0  # mean of 10, 25, 20, 25
    assert float(quarter.Weighted_Passengers_Per_Bus) == 21.11
    literal = summaries.quarterly_summary(star, include_rollup_rows=True).first()
    assert (literal.Total_Passengers, literal.Unique_Carriers) == (1150, 3)


def test_period_summary_counts(spark):
    period = summaries.period_impact_summary(summary_rows(spark)).first()
    assert (period.Total_Weeks, period.Distinct_Weeks) == (4, 2)
    assert float(period.Avg_Weekly_Passengers) == 237.5 and float(period.Avg_Passengers_Per_Week) == 475.0


def test_equal_means_rank_by_name(spark):
    perf = spark.createDataFrame([("C", 20.0), ("B", 21.0), ("A", 20.0), ("D", None)],
                                 "Carrier_Name string, Avg_Passengers_Per_Bus double")
    ranked = {r.Carrier_Name: r.Performance_Rank for r in summaries.rank_performance(perf).collect()}
    assert ranked == {"B": 1, "A": 2, "C": 3, "D": 4}


def test_grouping_sets_equal_the_single_summaries(spark):
    star = summary_rows(spark)
    combined = summaries.summary_grouping_sets(star)
    for name, single in (("monthly", summaries.monthly_carrier_summary(star)),
                         ("quarterly", summaries.quarterly_summary(star)),
                         ("carrier", summaries.carrier_performance(star))):
        shared = [c for c in single.columns if c in combined.columns]
        assert rows(combined.where(F.col("Summary") == name).select(shared)) == rows(single.select(shared))


def test_metamorphic_sums(spark, small):
    from farebox.plans import landing
    src, tables, facts = landing.warehouse(spark, small)
    assert facts.count() == src.count() == 8729
    star = fact.star_read(facts, tables)
    total = lambda df: df.agg(F.sum("Total_Passengers")).first()[0]
    sums = {total(f(star)) for f in (summaries.monthly_carrier_summary, summaries.quarterly_summary,
                                     summaries.carrier_performance, summaries.period_impact_summary)}
    assert len(sums) == 1


def test_fixture_counts(spark, small):
    from farebox.plans import landing
    src, tables, _ = landing.warehouse(spark, small)
    counts = {name: df.count() for name, df in tables.items()}
    assert counts == {"dim_date": 357, "dim_carrier": 25, "dim_weather": 55, "dim_status": 352,
                      "dim_event": 5, "dim_service_type": 5}
    narrow = tables["dim_weather"].select("Avg_Temp_F", "Precipitation_Inches", "Weather_Condition")
    assert narrow.distinct().count() == 53
    assert src.where("COVID_Period IS NULL").count() == 122
    assert quality.fact_fanout_check(src, tables["dim_weather"]).first().Joined_Rows == 9045
    assert src.select("Year", "Quarter").distinct().count() == 28
    assert src.select("Week_of_Year").distinct().count() == 53


# ---- checks that find something ----------------------------------------------------------------

def test_checks_report_faults(spark):
    src = staging(spark, [{"Week_Date": None}, {"Week_Date": week(0), "Carrier_Name": None},
                          {"Week_Date": week(1), "Month": 7}])
    got = quality.staging_quality(src).first()
    assert (got.Total_Rows, got.Null_Dates, got.Null_Carriers, got.Status) == (3, 1, 1, quality.WARNING)
    conflicts = quality.date_key_conflicts(src).first()
    assert (conflicts.Null_Keys, conflicts.Conflicts, conflicts.Status) == (1, 1, quality.FAIL)


def test_integrity_and_references(spark):
    _, tables, facts = load(spark, [{"Week_Date": week(0)}, {"Week_Date": week(1), "Bus_Departures": -1}])
    broken = facts.withColumn("Carrier_Key", F.when(F.col("Fact_Key") == 1, 99)).withColumn(
        "Event_Key", F.lit(77))
    integrity = {r.Check_Type: (r.Issue_Count, r.Status) for r in quality.check_integrity(broken).collect()}
    assert integrity == {"NULL Foreign Keys": (1, quality.FAIL), "Negative Passenger Counts": (0, quality.PASS),
                         "Negative Bus Counts": (1, quality.WARNING)}
    orphans = {r.Check_Type: r.Issue_Count for r in quality.check_referential(broken, tables).collect()}
    assert orphans["Carrier_Key in dim_carrier"] == 1 and orphans["Event_Key in dim_event"] == 2
    assert orphans["Date_Key in dim_date"] == 0


def test_unique_key_check_finds_duplicates(spark):
    _, tables, facts = load(spark, [{"Week_Date": week(0), "Carrier_Full_Name": n} for n in ("x", "y")])
    found = {r.Check_Type: r.Issue_Count for r in quality.check_unique_keys(tables | {"fact": facts}).collect()}
    assert found["dim_carrier (Carrier_Name)"] == 1 and found["dim_carrier (Carrier_Key)"] == 0


def test_period_loss(spark):
    _, tables, facts = load(spark, [{"Week_Date": week(0)}, {"Week_Date": week(1), "COVID_Period": None}])
    got = quality.period_loss_check(facts, tables["dim_status"]).first()
    assert (got.Fact_Rows, got.Lost_Rows, got.Lost_Passengers) == (2, 1, 100)
    assert fact.star_read(facts, tables).count() == 1


def test_rollup_reconciliation(spark):
    src = staging(spark, [{"Week_Date": week(w), "Carrier_Name": c, "Passenger_Departures": p}
                          for w, c, p in ((0, "A", 1), (0, "B", 2), (0, "Total", 3), (1, "A", 1), (1, "Total", 9))])
    src = src.withColumn("Bus_Departures", F.lit(0).cast("bigint"))
    got = {r.Week_Date: r.Status for r in quality.rollup_reconciliation(src).collect()}
    assert got == {week(0): quality.PASS, week(1): quality.FAIL}


def test_summary_statistics_truncates_like_integers(spark):
    _, _, facts = load(spark, [{"Week_Date": week(i), "Passenger_Departures": p} for i, p in enumerate((1, 2, 2))])
    got = {r.Metric: r for r in quality.summary_statistics(facts).collect()}["Passenger Departures"]
    assert (got.Total, got.Average_Int, float(got.Average), got.Minimum, got.Maximum) == (5, 1, 1.67, 1, 2)


def test_latest_records_overflowing_percent_is_null(spark):
    _, tables, facts = load(spark, [{"Week_Date": week(0), "Passenger_Recovery_Percent": 123456.7},
                                    {"Week_Date": week(1), "Passenger_Recovery_Percent": 98.76}])
    got = quality.latest_records(facts, tables).collect()
    assert [r.Week_Date for r in got] == [week(1), week(0)]
    assert float(got[0].Recovery_Pct) == 98.8 and got[1].Recovery_Pct is None


def test_row_helpers(spark):
    src = staging(spark, [{"Week_Date": date(2024, 1, 5)}, {"Week_Date": date(2025, 1, 3), "Carrier_Name": "tbl_x"}])
    assert R.of_latest_year(src).count() == 1 and R.of_year(src, 2024).count() == 1
    assert R.name_like(src, "Carrier_Name", "tbl%").count() == 1
    assert R.first_rows(src, [F.desc("Week_Date")], 1).first().Year == 2025
    stacked = R.union_frames(src.select("Year"), src.select("Year", "Month"))
    assert stacked.columns == ["Year", "Month"] and stacked.where("Month IS NULL").count() == 2


def test_ensure_column_and_conform(spark):
    df = spark.createDataFrame([(1, "x")], "year int, note string")
    assert ensure_column(df, "Rank", "int").columns == ["year", "note", "Rank"]
    assert ensure_column(df, "Year", "int").columns == ["year", "note"]
    with pytest.raises(Exception):
        conform(df, MONTHLY_SUMMARY).schema
