"""Every query against DuckDB on the smallest tables, and its plan."""

import __spark_entry__ as entry
import pytest
from farebox.plans import catalog, landing
from oracle import queries as sql
from oracle.compare import connect, differences

QUERIES, SQL = catalog.QUERIES, sql.oracle_sql()
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY and set(SQL) <= set(QUERIES)


def assert_plan_is_clean(df):
    """No product join and no row-at-a-time Python function."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in plan, word


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    assert differences(df, duck, SQL[name]) == []
    assert_plan_is_clean(df)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["Year", "Quarter"]


def test_scan_reads_four_columns_of_the_lines(spark, tiny):
    plan = QUERIES["weekly_source"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "l_orderkey" in line]
    assert len(scans) == 1
    schema = scans[0].split("ReadSchema: ")[1]
    assert all(c in schema for c in ("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate"))
    assert "l_extendedprice" not in schema and "l_comment" not in schema


def test_shuffled_joins_give_the_same_rows(spark, tiny, duck):
    """With broadcasts off every join shuffles; results stay equal."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("weekly_source", "fact_load", "star_read", "check_referential", "sheet_extract"):
            assert differences(QUERIES[name](spark, tiny), duck, SQL[name]) == [], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_supplier_is_split(spark, tiny, tmp_path):
    """A third of all lines on one supplier: the shuffled join splits it and stays right."""
    from pyspark.sql import functions as F
    folder = str(tmp_path / "hot")
    for name in ("nation", "region", "supplier"):
        spark.read.parquet(f"{tiny}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet")
    many = lines.select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("c"))
    hot = many.select(
        (F.col("l_orderkey") * 40 + F.col("c")).alias("l_orderkey"),
        F.when(F.col("c") % 3 == 0, 1).otherwise(F.col("l_suppkey")).cast("bigint").alias("l_suppkey"),
        "l_quantity", "l_shipdate").repartition(8)
    hot.write.parquet(f"{folder}/lineitem.parquet")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        from farebox.sources.weekly_feed import weekly_departures
        df = weekly_departures(spark, folder)
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "skew=true" in plan
    import duckdb
    con = duckdb.connect()
    for name in ("nation", "region", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    assert sorted(tuple(r) for r in got) == sorted(con.execute(SQL["weekly_source"]).fetchall())


def test_landed_tables_are_read_back(spark, tiny):
    landing.warehouse(spark, tiny)
    plan = landing.staging(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "staging" in plan and "lineitem" not in plan
