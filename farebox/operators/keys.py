"""Dense surrogate keys and ranks: a global numbering that no single task computes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.session import shared_dir

#: A partition's own part of `monotonically_increasing_id`.
_IN_PARTITION = (1 << 33) - 1


def dense_key(df: DataFrame, key: str, first: Column, order_by: list[str | Column],
              descending: bool = False, kind: str = "int") -> DataFrame:
    """Number rows 1..n by `first` (`descending` if asked), then by `order_by`; equals a global `row_number`.

    Rows are dealt into ranges of the whole ordering, sorted there and written to the shared folder with their
    range and their place in it. What they are numbered by is then fixed, whatever is lost or run again:
    a row's number is its place plus the rows of the ranges before, one count per range. Rows with an equal
    beginning spread over all ranges, since the whole ordering decides; only fully equal rows stay together.
    """
    spark = df.sparkSession
    shared = shared_dir(spark)
    if shared is None:
        raise ValueError("numbering writes its ranges: set spark.checkpoint.dir to a folder that all executors share")
    keyed = df.withColumn("_first", first)
    order = [F.col("_first").desc() if descending else F.col("_first").asc(),
             *[F.col(c).asc() if isinstance(c, str) else c for c in order_by]]
    placed = (keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_first")
              .withColumns({"_range": F.spark_partition_id(),
                            "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}))
    path = f"{shared}/farebox/{spark.sparkContext.applicationId}/{key.lower()}-{uuid.uuid4().hex[:12]}"
    placed.write.parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path)
    before, offsets = 0, []
    for r in kept.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():  # a row per range
        offsets.append((r["_range"], before))
        before += r["n"]
    starts = spark.createDataFrame(offsets, "_range int, _before bigint")
    number = (F.col("_place") + F.col("_before") + 1).cast(kind).alias(key)
    return (kept.join(F.broadcast(starts), "_range")  # a row per range
            .select(number, *[F.col(f"`{c}`") for c in df.columns]))


def prefix(column: str, length: int = 3) -> Column:
    """Leading characters, an order-preserving bucket for names."""
    return F.substring(F.col(column), 1, length)
