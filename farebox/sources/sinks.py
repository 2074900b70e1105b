"""Writers: CSV with a header, and tables replaced on every load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.schemas import conform, rename

#: Files that a partition folder gets at most from one load.
FILES_PER_FOLDER = 8


def write_csv(df: DataFrame, path: str, date_format: str = "yyyy-MM-dd") -> None:
    """Header row, no index; dates stay dates until they are formatted here."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", date_format).csv(path)


def prepared(df: DataFrame, mapping: dict[str, str] | None = None, schema: T.StructType | None = None,
             partition_by: list[str] | None = None) -> DataFrame:
    """The rows as a sink writes them: columns renamed, in order and typed, dealt by partition folder."""
    out = rename(df, mapping) if mapping else df
    out = conform(out, schema) if schema else out
    if partition_by:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in out.columns]), F.lit(FILES_PER_FOLDER))
        out = out.repartition(*[F.col(f"`{c}`") for c in partition_by], salt)
    return out


def write_table(df: DataFrame, path: str, mapping: dict[str, str] | None = None,
                schema: T.StructType | None = None, partition_by: list[str] | None = None) -> None:
    """Replace the table at `path` once its new rows are written.

    They go to a folder beside it first, so a failed load leaves the old table as it was, and
    `df` may read the very table it replaces. `mapping` renames columns on the way out; `schema`
    fixes their order and types. With `partition_by` rows are dealt by those columns and a
    salt, so that each folder gets few files and a large one is not written by one task.
    """
    out = prepared(df, mapping, schema, partition_by)
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:12]}"
    out.write.partitionBy(*(partition_by or [])).parquet(new)
    _swap(df.sparkSession, new, path.rstrip("/"))


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """`new` takes the place of `path`; if that fails, the old folder comes back."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    here, come, old = paths(path), paths(new), paths(f"{new}.old")
    store = here.getFileSystem(spark._jsc.hadoopConfiguration())
    had = store.exists(here)
    if had and not store.rename(here, old):
        raise OSError(f"{path} cannot be moved")
    if not store.rename(come, here):
        if had:
            store.rename(old, here)
        raise OSError(f"{new} cannot be moved to {path}")
    if had:
        store.delete(old, True)


def write_and_read(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write the table and continue from the files, with their measured size and short lineage."""
    spark: SparkSession = df.sparkSession
    write_table(df, path, partition_by=partition_by)
    return spark.read.schema(df.schema).parquet(path)
