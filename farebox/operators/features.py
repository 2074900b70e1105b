"""Feature rows, feature importance by random forest, and exact correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.constants import FEATURE_COLUMNS, FEATURE_TARGET, FOREST_DEPTH, FOREST_SEED, FOREST_TREES
from farebox.functions.measures import flag
from farebox.operators import forest
from farebox.operators.rows import complete_rows, members_only


def _known_flag(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), flag(column))


def feature_rows(src: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    """Fifteen features and the target per carrier-week, missing values kept."""
    rows = members_only(src, include_rollup_rows)
    return rows.select(
        "Carrier_Name", "Week_Date",
        F.col("Year").alias("Year_Num"), "Quarter",
        F.month("Week_Date").alias("Month_Num"), F.col("Week_of_Year").alias("Week_Num"),
        F.col("Avg_Temp_F").cast("double").alias("Avg_Temp_F"),
        F.col("Precipitation_Inches").cast("double").alias("Precipitation_Inches"),
        *[_known_flag(c).alias(c) for c in ("Is_Severe_Weather", "Is_Holiday", "Is_Tourism_Peak")],
        "Days_Since_Pandemic_Start",
        *[_known_flag(c).alias(c) for c in ("Is_COVID_Period", "Is_High_Inflation")],
        F.coalesce(F.col("Season") == "Summer", F.lit(False)).cast("int").alias("Is_Summer"),
        F.coalesce(F.col("Season") == "Winter", F.lit(False)).cast("int").alias("Is_Winter"),
        "Baseline_2019_Passengers", FEATURE_TARGET)


def feature_rows_complete(src: DataFrame, include_rollup_rows: bool = False) -> DataFrame:
    """Feature rows without a missing value in any feature or the target."""
    return complete_rows(feature_rows(src, include_rollup_rows), [*FEATURE_COLUMNS, FEATURE_TARGET])


def forest_nodes(src: DataFrame, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH,
                 seed: int = FOREST_SEED) -> DataFrame:
    """Nodes of the forest over all features at every split."""
    return forest.grow_forest(feature_rows_complete(src), FEATURE_COLUMNS, FEATURE_TARGET,
                              ["Carrier_Name", "Week_Date"], trees, depth, seed)


def ranked_importance(nodes: DataFrame) -> DataFrame:
    """Features by importance, highest first, from the nodes of a forest; importances sum to 1."""
    return forest.importance(nodes, FEATURE_COLUMNS).orderBy(F.desc("Importance"), "Feature")


def feature_importance(src: DataFrame, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH,
                       seed: int = FOREST_SEED) -> DataFrame:
    """Features by importance, highest first; importances sum to 1."""
    return ranked_importance(forest_nodes(src, trees, depth, seed))


def forest_fit(src: DataFrame, nodes: DataFrame, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> DataFrame:
    """What a forest predicts for each of the rows it was grown from."""
    return forest.predict(feature_rows_complete(src), nodes, FEATURE_COLUMNS, ["Carrier_Name", "Week_Date"], trees, depth)


def _correlation(column: str) -> Column:
    """Pearson correlation with the target; NULL for a constant column, on which ANSI mode
    would fail in `corr`."""
    x, y = F.col(column).cast("double"), F.col(FEATURE_TARGET).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def feature_correlation(src: DataFrame) -> DataFrame:
    """Correlation of every feature with the target, in one pass, strongest first."""
    one_row = feature_rows_complete(src).agg(
        *[F.round(_correlation(c), 6).alias(c) for c in FEATURE_COLUMNS])
    rows = one_row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("Feature"), F.col(c).alias("Correlation")) for c in FEATURE_COLUMNS])))
    return rows.orderBy(F.abs("Correlation").desc_nulls_last(), "Feature")
