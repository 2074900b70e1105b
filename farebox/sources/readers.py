"""Readers: flat file, columnar table, and a query against a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.functions.calendar import safe_date
from farebox.schemas import CONSOLIDATED, conform
from farebox.sources.versions import current


def read_weekly_csv(spark: SparkSession, path: str, schema: T.StructType = CONSOLIDATED,
                    corrupt: str | None = None) -> DataFrame:
    """Weekly rows from CSV, columns matched by the header's names; dates may be ISO or MM/dd/yyyy text.

    Only the header is read to learn the order; a missing name is an error, further columns are
    left out. `corrupt` names an extra column that keeps the values that do not fit their type,
    as name=value, null where all fit.
    """
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in schema if f.name not in rows.columns]
    if missing:
        raise ValueError(f"the file lacks the columns {', '.join(missing)}")
    typed = {f.name: safe_date(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name).try_cast(f.dataType)
             for f in schema}
    kept = [typed[f.name].alias(f.name) for f in schema]
    if corrupt:
        bad = [F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.concat(F.lit(f"{f.name}="), F.col(f.name)))
               for f in schema]
        kept.append(F.nullif(F.concat_ws("; ", *bad), F.lit("")).alias(corrupt))
    out = rows.select(*kept)
    return out if corrupt else conform(out, schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a table: those that were published last, or all files of a plain folder."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(current(spark, path) or path)


def read_query(spark: SparkSession, url: str, query: str, partition_column: str | None = None,
               bounds: tuple[int, int] | None = None, partitions: int = 1,
               **options: str) -> DataFrame:
    """A SQL command against a JDBC database, read in parallel when a numeric column is given."""
    settings = {"url": url} | options
    if partition_column and bounds:
        settings |= {
            "dbtable": f"({query}) q", "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
            "numPartitions": str(partitions)}
    else:
        settings["query"] = query
    return spark.read.format("jdbc").options(**settings).load()
