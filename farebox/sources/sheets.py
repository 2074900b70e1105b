"""Weekly sheets to consolidated rows: one job over all sheets.

Input is the landed grid `(sheet, year, row_idx, col_idx, value)`, one row per non-empty
cell. A sheet with no recognisable header, carrier column or measure column yields no rows.
Cells are grouped by sheet only through partial aggregates of numbers, and by (sheet, row)
for the few columns of interest, so one huge sheet spreads over many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.constants import (
    CARRIER_COLUMN_MARKERS, CARRIER_COLUMNS, CARRIER_NAMES, CARRIERS, HEADER_ROWS,
    WEATHER_PLACEHOLDERS)
from farebox.functions.calendar import with_calendar_flags, with_date_parts, with_week_ending
from farebox.functions.measures import passengers_per_bus_double, status_of_year, to_number
from farebox.schemas import CONSOLIDATED, conform

SHEET = ["sheet", "year"]


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def header_rows(grid: DataFrame, names: list[str], depth: int | None = HEADER_ROWS) -> DataFrame:
    """First row of each sheet, within the search depth (None: the whole sheet), whose joined text holds a name.

    A name inside a longer heading counts, and so does one spread over neighbouring cells.
    """
    line = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda cell: cell["value"]), " ")
    within = F.col("value").isNotNull() if depth is None else (F.col("row_idx") < depth) & F.col("value").isNotNull()
    return (
        grid.where(within)
        .groupBy(*SHEET, "row_idx").agg(line.alias("line"))
        .where(contains_any(F.col("line"), names))
        .groupBy(*SHEET).agg(F.min("row_idx").alias("header_row")))


def sheet_layouts(grid: DataFrame, names: list[str] | None = None, markers: list[str] | None = None,
                  depth: int | None = HEADER_ROWS, width: int | None = CARRIER_COLUMNS) -> DataFrame:
    """Every sheet with its header row, the positions of its three columns, and why it cannot be read.

    `reason` is null for sheets that can; else the first that holds of: no header, no carrier column, no measure
    column. `depth` and `width` bound the search for the header row and the carrier column; None searches the whole sheet.
    """
    cell = F.lower("value")
    in_header = F.col("row_idx") == F.col("header_row")
    is_carrier = (F.col("row_idx") > F.col("header_row")) & contains_any(F.col("value"), markers or CARRIER_COLUMN_MARKERS)
    if width is not None:
        is_carrier = is_carrier & (F.col("col_idx") < width)

    def first_other(positions: str) -> Column:
        return F.array_min(F.filter(F.col(positions), lambda c: c != F.col("carrier_col")))

    return (
        grid.join(header_rows(grid, names or CARRIER_NAMES, depth), SHEET, "left")
        .groupBy(*SHEET, "header_row")
        .agg(F.min(F.when(is_carrier, F.col("col_idx"))).alias("carrier_col"),
             F.collect_set(F.when(in_header & cell.contains("bus"), F.col("col_idx"))).alias("bus"),
             F.collect_set(F.when(in_header & cell.contains("passenger"), F.col("col_idx"))).alias("pax"))
        .select(*SHEET, "header_row", "carrier_col",
                first_other("bus").alias("bus_col"), first_other("pax").alias("pax_col"))
        .withColumn("reason", F.when(F.col("header_row").isNull(), "no header")
                    .when(F.col("carrier_col").isNull(), "no carrier column")
                    .when(F.col("bus_col").isNull() | F.col("pax_col").isNull(), "no measure column")))


def sheet_rejects(grid: DataFrame, names: list[str] | None = None, markers: list[str] | None = None,
                  depth: int | None = HEADER_ROWS, width: int | None = CARRIER_COLUMNS) -> DataFrame:
    """The sheets that `extract_sheets` leaves out under the same arguments: sheet, year, reason and header row."""
    return (sheet_layouts(grid, names, markers, depth, width).where(F.col("reason").isNotNull())
            .select(*SHEET, "reason", "header_row"))


def extract_sheets(grid: DataFrame, names: list[str] | None = None, markers: list[str] | None = None,
                   depth: int | None = HEADER_ROWS, width: int | None = CARRIER_COLUMNS) -> DataFrame:
    """Carrier, bus and passenger text of every data row: sheet, year, row and three values."""
    names = names or CARRIER_NAMES
    layout = sheet_layouts(grid, names, markers, depth, width).where(F.col("reason").isNull()).drop("reason")

    def value_of(position: str) -> Column:
        return F.max(F.when(F.col("col_idx") == F.col(position), F.col("value")))

    return (
        grid.join(layout, SHEET)
        .where((F.col("row_idx") > F.col("header_row"))
               & F.col("col_idx").isin(F.col("carrier_col"), F.col("bus_col"), F.col("pax_col")))
        .groupBy(*SHEET, "row_idx")
        .agg(value_of("carrier_col").alias("Carrier_Name"),
             value_of("bus_col").alias("Bus_Text"),
             value_of("pax_col").alias("Passenger_Text"))
        .where(F.col("Carrier_Name").isin(names)))


def label_quality(extracted: DataFrame, fix_year_rollover: bool = True) -> DataFrame:
    """One row per sheet that was read: its date, whether that is only the default of a label that cannot
    be parsed, and its rows, those without a number among them."""
    rows = with_week_ending(extracted.withColumnsRenamed({"sheet": "Week_Label", "year": "Label_Year"}),
                            fix_year_rollover=fix_year_rollover)
    missing = to_number("Bus_Text").isNull() | to_number("Passenger_Text").isNull()
    return rows.groupBy("Week_Label", "Label_Year", "Week_Date", "Week_Date_Defaulted").agg(
        F.count(F.lit(1)).alias("Rows"), F.count_if(missing).alias("Rows_Without_Number"))


def carrier_lookup(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        CARRIERS, "Carrier_Name string, Carrier_Full_Name string, Service_Type string")


def lookup_enrich(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Long name and service type by carrier name; NULL for names the lookup lacks."""
    return df.join(lookup, "Carrier_Name", "left")


def consolidate(extracted: DataFrame, lookup: DataFrame | None = None,
                fix_year_rollover: bool = True) -> DataFrame:
    """The 34-column table of extracted sheet rows."""
    rows = extracted.withColumnsRenamed({"sheet": "Week_Label", "year": "Label_Year"})
    rows = lookup_enrich(rows, lookup if lookup is not None else carrier_lookup(rows))
    rows = with_week_ending(rows, fix_year_rollover=fix_year_rollover)
    rows = rows.withColumns({
        "Bus_Departures": to_number("Bus_Text"),
        "Passenger_Departures": to_number("Passenger_Text"),
    })
    return project_consolidated(rows)


def project_consolidated(rows: DataFrame) -> DataFrame:
    """Derived and constant columns of the consolidated table, in its column order."""
    rows = with_calendar_flags(with_date_parts(rows))
    rows = rows.withColumns({
        "Passengers_Per_Bus": passengers_per_bus_double("Passenger_Departures", "Bus_Departures"),
        "Status": status_of_year("Year"),
        "Is_Holiday": F.lit(False),
        "Is_Severe_Weather": F.lit(False),
        **{c: F.lit(v) for c, v in WEATHER_PLACEHOLDERS.items()},
        **{c: F.lit(None) for c in (
            "Baseline_2019_Buses", "Baseline_2019_Passengers", "Bus_Recovery_Percent",
            "Passenger_Recovery_Percent", "Major_Weather_Event", "Notes")},
    })
    return conform(rows, CONSOLIDATED)
