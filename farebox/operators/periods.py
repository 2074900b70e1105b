"""Classification of days by a table of periods, however many there are.

A period has a first and a last day, either of them open (NULL), and a label. Only the distinct days are looked up:
periods are laid out by the months they cover within the range of the days, joined on the month and then compared,
so neither a chain of conditions nor a comparison of every day with every period is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _month(day: Column) -> Column:
    return F.trunc(day, "month")


def _hits(days: DataFrame, periods: DataFrame) -> DataFrame:
    """(day, first, last, label) of every period that holds the day; `days` has the distinct days."""
    lowest, highest = days.select(F.min("day")).scalar(), days.select(F.max("day")).scalar()
    begin, end = F.greatest(F.coalesce("first", lowest), lowest), F.least(F.coalesce("last", highest), highest)
    laid = (periods.where((begin <= end) & F.coalesce(F.col("first") <= F.col("last"), F.lit(True)))
            .withColumn("month", F.explode(F.sequence(_month(begin), _month(end), F.expr("interval 1 month")))))
    inside = (F.coalesce(F.col("first") <= F.col("day"), F.lit(True)) & F.coalesce(F.col("day") <= F.col("last"), F.lit(True)))
    return days.withColumn("month", _month(F.col("day"))).join(laid, "month").where(inside).drop("month")


def _order() -> Column:
    """The period that starts last wins, an open start comes first; equal starts go by label."""
    return F.struct(F.col("first").isNotNull(), "first", "label")


def classify_by_table(df: DataFrame, day: str, periods: DataFrame, name: str) -> DataFrame:
    """`df` with the label of the period that holds `day` as column `name`; NULL where none does.

    `periods` has first, last (both days belong to the period) and label. Of several, the one that starts last counts.
    """
    days = df.select(F.col(day).alias("day")).where("day is not null").distinct()
    found = _hits(days, periods.select("first", "last", "label")).groupBy("day").agg(F.max_by("label", _order()).alias("_label"))
    found = found.withColumnRenamed("day", "_day")
    return (df.join(found, df[f"`{day}`"] == F.col("_day"), "left")
            .select(*[df[f"`{c}`"] for c in df.columns], F.col("_label").alias(name)))


def period_overlaps(periods: DataFrame) -> DataFrame:
    """Periods that begin inside others: first, last, label and how many hold their first day. Equal rows count as others."""
    every = (periods.groupBy("first", "last", "label").agg(F.count(F.lit(1)).alias("times")))
    days = every.select(F.col("first").alias("day")).where("day is not null").distinct()
    held = _hits(days, every).groupBy("day").agg(F.sum("times").alias("holding"))
    return (every.join(held, every["first"] == held["day"])
            .select("first", "last", "label", (F.col("holding") - 1).alias("others")).where("others > 0"))
