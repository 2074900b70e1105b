"""Session defaults and the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hash instead of sort-merge join once all shuffled partitions measure below this size.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Few of the columns are read, so a split may span more of the file.
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, name: str = "farebox", **conf: str) -> SparkSession:
    """A session with the package's defaults; keyword settings use `__` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """The folder all executors share, as the session names it.

    A scratch folder, one per application, stands in only on a local master; on a cluster
    without the setting the answer is None and callers keep their plans unlanded.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="farebox-")
    return _scratch[app]
