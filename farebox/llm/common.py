"""Helpers shared by the operators: fresh column names, tables cut off from their lineage, row loading."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.session import shared_dir

#: A word, the same in Java, Python and DuckDB: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of two or three columns that the driver may hold for a broadcast.
MERGE_FROM = 1 << 17


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not use, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame, name: str, **options: int) -> DataFrame:
    """`df` written to the folder that all executors share, with the writer's `options`, and read back.

    The plan behind ends here: a lost executor costs a re-read of files, and their measured
    size is known to the plans that follow.
    """
    spark = df.sparkSession
    shared = shared_dir(spark)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{shared}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(side: DataFrame, rows: int | None = None) -> DataFrame:
    """`side` of a join whose both sides grow with the input: sorted and merged, never broadcast.

    Spark sizes a side by the bytes of its files and the types of its columns. After an explode, or from columns
    that files keep in far less than rows take, that is many times too low, and the driver would collect all of it.
    Where at most `rows` are counted and these are few, Spark may choose.
    """
    return side if rows is not None and rows <= MERGE_FROM else side.hint("merge")


def hash_share(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on `key` and `seed` alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key.cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
