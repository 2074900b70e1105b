"""Sheet grids with the quirks the search rules have to cope with."""

from datetime import date

import pytest
from farebox.schemas import SHEET_GRID
from farebox.sources.sheets import consolidate, extract_sheets, label_quality, sheet_rejects


def grid(spark, *sheets):
    cells = []
    for name, year, lines in sheets:
        for r, line in enumerate(lines):
            for c, value in enumerate(line):
                if value is not None:
                    cells.append((name, year, r, c, str(value)))
    return spark.createDataFrame(cells, SHEET_GRID)


def extracted(df):
    return sorted((r.sheet, r.year, r.Carrier_Name, r.Bus_Text, r.Passenger_Text)
                  for r in extract_sheets(df).collect())


HEAD = ["Carrier", "Total Bus Departures", "Total Passengers"]


def test_plain_sheet(spark):
    df = grid(spark, ("Jan 4-8", 2021, [["Weekly report"], [], HEAD, ["Academy", 10, 200],
                                        ["Martz", 5, "n/a"], ["Unknown Bus", 1, 1], ["Total", 15, 200]]))
    assert extracted(df) == [("Jan 4-8", 2021, "Academy", "10", "200"), ("Jan 4-8", 2021, "Martz", "5", "n/a"),
                             ("Jan 4-8", 2021, "Total", "15", "200")]


def test_moved_columns_first_match_wins(spark):
    head = ["#", "Total", "Passengers in", "Buses in", "Bus out", "Passenger out"]
    df = grid(spark, ("Jan 4-8", 2021, [head, [1, "Academy", 7, 3, 9, 9]]))
    assert extracted(df) == [("Jan 4-8", 2021, "Academy", "3", "7")]


def test_heading_of_the_carrier_column_is_no_measure(spark):
    head = ["Total by Bus company", "Bus", "Passenger"]
    df = grid(spark, ("Jan 4-8", 2021, [head, ["Academy", 3, 7]]))
    assert extracted(df) == [("Jan 4-8", 2021, "Academy", "3", "7")]


def test_name_spread_over_two_heading_cells(spark):
    head = ["NJ", "Transit", "Bus", "Passenger"]
    df = grid(spark, ("Jan 4-8", 2021, [head, ["Academy", None, 3, 7]]))
    assert extracted(df) == [("Jan 4-8", 2021, "Academy", "3", "7")]


@pytest.mark.parametrize("lines", [
    [["Carrier", "Bus", "Passenger"], ["Academy", 3, 7]],                # the data row reads as header
    [["nothing"], ["here"]],                                            # no name at all
    [["x"]] * 40 + [HEAD, ["Academy", 3, 7]],                           # header too deep
    [["Total"] + [None] * 10 + ["Bus", "Passenger", "Name"],
     ["x"] + [None] * 10 + [3, 7, "Academy"]],                          # carrier column too far right
    [["Total", "Coaches", "Passenger"], ["Academy", 3, 7]],             # no bus heading
])
def test_unusable_sheets_yield_nothing(spark, lines):
    good = ("Feb 1-5", 2021, [HEAD, ["Academy", 1, 2]])
    assert extracted(grid(spark, ("Jan 4-8", 2021, lines), good)) == [("Feb 1-5", 2021, "Academy", "1", "2")]


def test_row_with_a_missing_measure(spark):
    df = grid(spark, ("Jan 4-8", 2021, [HEAD, ["Academy", None, 7]]))
    assert extracted(df) == [("Jan 4-8", 2021, "Academy", None, "7")]


def test_same_label_in_two_years_stays_apart(spark):
    df = grid(spark, ("Jan 4-8", 2021, [HEAD, ["Academy", 1, 2]]), ("Jan 4-8", 2027, [HEAD, ["Academy", 3, 4]]))
    assert extracted(df) == [("Jan 4-8", 2021, "Academy", "1", "2"), ("Jan 4-8", 2027, "Academy", "3", "4")]


def test_consolidated_columns(spark):
    df = grid(spark, ("Dec. 28-Jan 1", 2020, [HEAD, ["Academy", 4, 10], ["Martz", 0, 10], ["Lakeland", 1, "n/a"]]))
    out = consolidate(extract_sheets(df))
    assert len(out.columns) == 34
    by = {r.Carrier_Name: r for r in out.collect()}
    a = by["Academy"]
    assert (a.Carrier_Full_Name, a.Service_Type, a.Week_Date, a.Year, a.Passengers_Per_Bus) == (
        "Academy Bus", "Regional", date(2021, 1, 1), 2021, 2.5)
    assert (a.Status, a.Is_Snow_Week, a.Is_Hot_Week, a.Fiscal_Year, a.Weather_Condition) == (
        "Recovery", True, False, 2020, "Normal")
    assert by["Martz"].Passengers_Per_Bus is None
    assert by["Lakeland"].Passenger_Departures is None
    literal = consolidate(extract_sheets(df), fix_year_rollover=False).first()
    assert (literal.Week_Date, literal.Year, literal.Status) == (date(2020, 1, 1), 2020, "Lockdown")


def test_one_sheet_holding_most_cells(spark):
    """A third and more of all cells in one sheet: everything is still extracted."""
    big = [HEAD] + [["Academy", i, i] for i in range(2000)]
    small = [(f"Feb {d}-{d + 4}", 2021, [HEAD, ["Martz", d, d]]) for d in range(1, 20)]
    got = extracted(grid(spark, ("Jan 4-8", 2021, big), *small))
    assert len(got) == 2019


def test_rejects_tell_why_and_limits_can_be_moved(spark):
    deep = [["x"]] * 40 + [HEAD, ["Academy", 3, 7]]
    far = [["Total"] + [None] * 10 + ["Bus", "Passenger", "Name"], ["x"] + [None] * 10 + [3, 7, "Academy"]]
    df = grid(spark, ("Jan 4-8", 2021, [HEAD, ["Academy", 3, 7]]), ("a", 2021, [["nothing"], ["here"]]), ("b", 2021, deep),
              ("c", 2021, far), ("d", 2021, [["Total", "Coaches", "Passenger"], ["Academy", 3, 7]]))
    found = lambda **k: {(r.sheet, r.reason, r.header_row) for r in sheet_rejects(df, **k).collect()}
    d = ("d", "no measure column", 0)
    assert found() == {("a", "no header", None), ("b", "no header", None), ("c", "no carrier column", 0), d}
    assert found(depth=None) == {("a", "no header", None), ("c", "no carrier column", 0), d}
    assert found(depth=41, width=None) == {("a", "no header", None), d}
    read = {r.sheet for r in extract_sheets(df, depth=None, width=None).collect()}
    assert read == {"Jan 4-8", "b", "c"} and {r.sheet for r in extract_sheets(df).collect()} == {"Jan 4-8"}


def test_labels_that_default_and_rows_without_number_are_counted(spark):
    df = grid(spark, ("Jan 4-8", 2021, [HEAD, ["Academy", 3, 7], ["Martz", "n/a", 1]]), ("Week 9", 2021, [HEAD, ["Academy", 3, 7]]))
    out = {r.Week_Label: tuple(r)[1:] for r in label_quality(extract_sheets(df)).collect()}
    assert out == {"Jan 4-8": (2021, date(2021, 1, 8), False, 2, 1), "Week 9": (2021, date(2021, 1, 1), True, 1, 0)}
    assert label_quality(extract_sheets(df.where("false"))).collect() == []
