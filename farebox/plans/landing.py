"""Tables written once per application into the shared folder.

The order lines are the only large input. They are read once, reduced to the staging table
and written; dimensions and fact follow from that table. Later queries start from these
files: their size is measured, so Spark can choose broadcasts by it, their lineage is short,
and a lost executor costs a re-read, not a re-scan of the order lines.
"""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.operators import features, summaries
from farebox.operators.dims import DIMENSIONS
from farebox.operators.fact import load_fact, star_read
from farebox.schemas import CARRIER_PERFORMANCE, MONTHLY_SUMMARY, PERIOD_SUMMARY, QUARTERLY_SUMMARY, conform
from farebox.session import shared_dir
from farebox.sources.sinks import write_and_read
from farebox.sources.weekly_feed import staging_rows, weekly_departures

Key = tuple[str, str, str, str]
_landed: dict[Key, tuple[str, T.StructType]] = {}
_locks: dict[Key, threading.Lock] = defaultdict(threading.Lock)
_drop = threading.Lock()

#: The tables that all landed ones derive from.
INPUTS = ["lineitem", "orders", "supplier", "nation", "region", "events"]

#: Stored summaries: the grouping set that holds each, and its declared schema.
SUMMARIES = {
    "monthly": ("monthly", MONTHLY_SUMMARY),
    "quarterly": ("quarterly", QUARTERLY_SUMMARY),
    "period": ("period", PERIOD_SUMMARY),
    "performance": ("carrier", CARRIER_PERFORMANCE),
}


#: Fingerprints of the input, by application, folder and what the roots of the tables show.
_states: dict[tuple, str] = {}


def _roots(spark: SparkSession, folder: str) -> tuple:
    """Kind, size and time of the root of each input table: one look-up a table, no listing."""
    found = []
    for name in INPUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(path):
            status = store.getFileStatus(path)
            found.append((path.toString(), status.isDirectory(), status.getLen(), status.getModificationTime()))
    return tuple(found)


def fingerprint(spark: SparkSession, folders: list[str]) -> tuple:
    """Number, bytes and a hash of name, size and time of all files below the folders, however deep.

    One job over file metadata: no content is read, and the driver gets one row.
    """
    if not folders:
        return ()
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
             .select("path", "length", "modificationTime"))
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(str(v) for v in files.agg(F.count(F.lit(1)), F.sum("length"), F.sum(mark)).first())


def input_state(spark: SparkSession, folder: str, refresh: bool = False) -> str:
    """A fingerprint of the input: landed tables of an earlier state are not used again.

    Files are looked at once per session, when the root of a table changes, and on `refresh`. A file changed
    deep in a folder, without a change of the folder itself, is seen on `refresh`.
    """
    roots = _roots(spark, folder)
    key = (spark.sparkContext.applicationId, folder, roots)
    if refresh or key not in _states:
        _states[key] = repr((roots, fingerprint(spark, [r[0] for r in roots if r[1]])))
    return _states[key]


def land(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame],
         refresh: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """The table `name` of this input folder, built and written on first use.

    Without a shared folder the plan itself is returned and nothing is written.
    A change of the input (see `input_state`) rebuilds every table on its next use. `refresh` forces that.
    """
    app = spark.sparkContext.applicationId
    key = (app, folder, input_state(spark, folder, refresh), name)
    with _locks[key]:
        if key in _landed and not refresh:
            path, schema = _landed[key]
            try:
                return spark.read.schema(schema).parquet(path)
            except AnalysisException:
                pass  # the shared folder was cleaned; build the table again
        shared = shared_dir(spark)
        if shared is None:
            return build()
        # a new folder per build: frames read from an earlier one stay valid
        path = f"{shared}/farebox/{app}/{name}-{uuid.uuid4().hex[:12]}"
        df = write_and_read(build(), path, partition_by)
        _landed[key] = (path, df.schema)
        return df


def staging(spark: SparkSession, folder: str, refresh: bool = False) -> DataFrame:
    """The staging table. All others derive from it, so its refresh drops them all."""
    if refresh:
        with _drop:
            for key in [k for k in _landed if k[:2] == (spark.sparkContext.applicationId, folder)]:
                del _landed[key]
    return land(spark, folder, "staging",
                lambda: staging_rows(weekly_departures(spark, folder)), refresh)


def dimensions(spark: SparkSession, folder: str, refresh: bool = False) -> dict[str, DataFrame]:
    """The six dimensions, built side by side: they depend on the staging table alone."""
    src = staging(spark, folder, refresh)
    run = inheritable_thread_target(spark)(land)
    with ThreadPoolExecutor(len(DIMENSIONS)) as pool:
        jobs = {name: pool.submit(run, spark, folder, name, lambda build=build: build(src), refresh)
                for name, build in DIMENSIONS.items()}
        return {name: job.result() for name, job in jobs.items()}


def warehouse(spark: SparkSession, folder: str,
              refresh: bool = False) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Staging, dimensions and fact of the input folder."""
    dims = dimensions(spark, folder, refresh)
    src = staging(spark, folder)
    return src, dims, land(spark, folder, "fact", lambda: load_fact(src, dims), refresh)


def forest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The forest behind the feature importances."""
    src = staging(spark, folder)
    return land(spark, folder, "forest", lambda: features.forest_nodes(src))


def summary_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four summaries as stored, each under its declared schema.

    One pass over the star makes them all, as grouping sets in one table partitioned by summary: reading one
    reads its folder only.
    """
    _, dims, facts = warehouse(spark, folder)
    sets = land(spark, folder, "summaries", lambda: summaries.summary_grouping_sets(star_read(facts, dims)),
                partition_by=["Summary"])
    return {name: conform(sets.where(F.col("Summary") == label), schema) for name, (label, schema) in SUMMARIES.items()}
