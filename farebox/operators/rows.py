"""Row filters, previews and listings shared by the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.constants import ROLLUP_CARRIER


def members_only(df: DataFrame, include_rollup_rows: bool = False,
                 carrier: str = "Carrier_Name") -> DataFrame:
    """Drop the row that sums all members, which would count everything twice."""
    return df if include_rollup_rows else df.where(~F.col(carrier).eqNullSafe(F.lit(ROLLUP_CARRIER)))


def only_names(df: DataFrame, names: list[str] | DataFrame, carrier: str = "Carrier_Name") -> DataFrame:
    """Rows whose carrier is listed exactly: a short list in place, a long one as a frame."""
    if isinstance(names, DataFrame):
        return df.join(names.select(carrier), carrier, "left_semi")
    return df.where(F.col(carrier).isin(names))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def of_year(df: DataFrame, year: int) -> DataFrame:
    return df.where(F.col("Year") == year)


def of_latest_year(df: DataFrame) -> DataFrame:
    return df.where(F.col("Year") == df.select(F.max("Year")).scalar())


def name_like(df: DataFrame, column: str, *patterns: str) -> DataFrame:
    """Rows whose column matches any LIKE pattern."""
    return df.where(reduce(Column.__or__, [F.col(column).like(p) for p in patterns]))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return not_null(df.select(column), column).distinct()


def union_frames(*frames: DataFrame) -> DataFrame:
    """Stack feeds by column name; a column one feed lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sorted_rows(df: DataFrame) -> DataFrame:
    return df.orderBy("Week_Date", "Carrier_Name")


def first_rows(df: DataFrame, order_by: list[str | Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def table_preview(tables: dict[str, tuple[DataFrame, str, Column]], n: int = 5) -> DataFrame:
    """First n rows of each table by its key: table, key and a one-line rendering."""
    return union_frames(*[
        first_rows(
            df.select(F.lit(name).alias("Table_Name"), F.col(key).cast("bigint").alias("Row_Key"),
                      text.alias("Row_Text")), ["Row_Key"], n)
        for name, (df, key, text) in tables.items()])
