"""Tables that are reloaded without a moment in which they lack rows.

A load writes its rows to a folder of their own and then one small pointer file; readers take the folder that
the highest pointer names. Nothing is renamed or overwritten, so it holds on object stores too: whatever fails
between two steps, the pointer before still names whole rows. Folders of older loads and of loads that
failed are reclaimed by the next load, but for the last `keep` published ones, whose readers may still be at work.

    table/_pointers/000000000007            "000000000007-1f3a..."
    table/_versions/000000000007-1f3a.../   the rows of load 7

Two loads at once: the pointer is created, never replaced, so the second to come fails and leaves the first one's rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from farebox.sources.sinks import prepared

KEEP = 2


def _store(spark: SparkSession, path: str):
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    return here, here.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    here, store = _store(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(here)) if store.exists(here) else []


def _read_pointer(spark: SparkSession, path: str, name: str) -> str | None:
    """The folder a pointer names; None for one that was not written to its end."""
    here, store = _store(spark, f"{path}/_pointers/{name}")
    stream = store.open(here)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text[:-1] if text.endswith("\n") else None


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder of every published load, the last one first."""
    names = [n for n in _children(spark, f"{path}/_pointers") if n.isdigit()]
    found = [(int(n), _read_pointer(spark, path, n)) for n in reversed(names)]
    return [(n, folder) for n, folder in found if folder]


def _point(spark: SparkSession, path: str, number: int, folder: str) -> None:
    here, store = _store(spark, f"{path}/_pointers/{number:012d}")
    stream = store.create(here, False)
    stream.write(bytearray(f"{folder}\n".encode()))
    stream.close()


def _reclaim(spark: SparkSession, path: str, keep: int) -> None:
    published = _pointers(spark, path)
    last = published[0][0]
    for number, _ in published[keep:]:  # a pointer goes before its rows
        here, store = _store(spark, f"{path}/_pointers/{number:012d}")
        store.delete(here, False)
    wanted = {folder for _, folder in published[:keep]}
    for folder in _children(spark, f"{path}/_versions"):
        if folder not in wanted and int(folder.split("-")[0]) <= last:
            here, store = _store(spark, f"{path}/_versions/{folder}")
            store.delete(here, True)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder with the rows of the table, None where nothing was published."""
    found = _pointers(spark, path.rstrip("/"))
    return f"{path.rstrip('/')}/_versions/{found[0][1]}" if found else None


def publish(df: DataFrame, path: str, mapping: dict[str, str] | None = None, schema: T.StructType | None = None,
            partition_by: list[str] | None = None, keep: int = KEEP) -> DataFrame:
    """Replace the rows of the table at `path` and continue from the new files.

    `df` may read the table it replaces. The other arguments are those of `sinks.write_table`.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    out = prepared(df, mapping, schema, partition_by)
    tried = [int(n.split("-")[0]) for n in (*_children(spark, f"{path}/_versions"), *_children(spark, f"{path}/_pointers"))
             if n.split("-")[0].isdigit()]
    number = max(tried, default=0) + 1
    folder = f"{number:012d}-{uuid.uuid4().hex[:12]}"
    out.write.partitionBy(*(partition_by or [])).parquet(f"{path}/_versions/{folder}")
    _point(spark, path, number, folder)
    _reclaim(spark, path, keep)
    return spark.read.schema(out.schema).parquet(f"{path}/_versions/{folder}")
