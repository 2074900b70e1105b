"""Strict comparison of a Spark result with DuckDB's: columns, types, rows and exact values."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when equal, else what differs."""
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    found = []
    if ours != theirs:
        found.append(f"schema: only ours {sorted(set(ours.items()) - set(theirs.items()))}, "
                     f"only theirs {sorted(set(theirs.items()) - set(ours.items()))}")
    names = sorted(ours)
    if sorted(theirs) != names:
        return found
    order = [list(theirs).index(n) for n in names]
    expected = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    actual = Counter(tuple(row[n] for n in names) for row in df.collect())
    if actual != expected:
        found.append(f"rows: {sum(actual.values())} ours, {sum(expected.values())} theirs, "
                     f"{sum((actual - expected).values())} differ")
        key = lambda row: tuple(str(v) for v in row)
        found.append(f"only ours: {sorted((actual - expected), key=key)[:2]}")
        found.append(f"only theirs: {sorted((expected - actual), key=key)[:2]}")
        found.append(f"columns: {names}")
    return found
