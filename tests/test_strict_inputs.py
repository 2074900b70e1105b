"""Inputs that do not look like the fixture: renamed carriers, swapped headings, odd numbers, changed files."""

import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.functions.measures import to_number
from farebox.plans.catalog import QUERIES
from farebox.sources.readers import read_weekly_csv


def test_only_plain_numbers_are_numbers(spark):
    texts = ["12", " 3.5 ", "-1e2", ".5", "12d", "5f", "0x1p3", "inf", "NaN", "1e999", "n/a", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(to_number("t").alias("n")).collect()
    assert [r.n for r in rows] == [12.0, 3.5, -100.0, 0.5] + [None] * 9


def test_csv_goes_by_heading(spark, tmp_path):
    schema = T.StructType([T.StructField("Week_Date", T.DateType()), T.StructField("Bus", T.IntegerType()),
                           T.StructField("Pax", T.IntegerType())])
    (tmp_path / "a.csv").write_text("Pax,Bus,Note,Week_Date\n100,4,x,2020-01-03\nmany,5,y,01/10/2020\n")
    rows = read_weekly_csv(spark, str(tmp_path / "a.csv"), schema, corrupt="bad").orderBy("Bus").collect()
    assert [(str(r.Week_Date), r.Bus, r.Pax, r.bad) for r in rows] == [
        ("2020-01-03", 4, 100, None), ("2020-01-10", 5, None, "Pax=many")]
    (tmp_path / "b.csv").write_text("Week_Date,Bus\n2020-01-03,4\n")
    with pytest.raises(ValueError, match="Pax"):
        read_weekly_csv(spark, str(tmp_path / "b.csv"), schema)


def test_renamed_carriers_and_changed_files(spark, tiny, tmp_path):
    folder = str(tmp_path / "in")
    shutil.copytree(tiny, folder, copy_function=shutil.copyfile)

    def total(name, column):
        return QUERIES[name](spark, folder).agg(F.sum(column)).first()[0]

    def pivot():
        row = QUERIES["carrier_year_pivot"](spark, folder)
        return sum(sum(v or 0 for k, v in r.asDict().items() if k != "Year") for r in row.collect())

    kept, before = QUERIES["filter_members"](spark, folder).count(), pivot()
    nation = spark.read.parquet(f"{tiny}/nation.parquet").toPandas()
    nation["n_name"] = nation["n_name"].replace("NATION_3", "Elsewhere")
    nation.to_parquet(f"{folder}/nation.parquet")
    assert QUERIES["filter_members"](spark, folder).count() == kept
    assert QUERIES["filter_members"](spark, folder).where("Carrier_Name = 'Elsewhere'").count() > 0
    assert pivot() == pytest.approx(before) and "Elsewhere" in QUERIES["carrier_year_pivot"](spark, folder).columns
    was = total("forecast_annual", "Projected_Passengers")
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    lines = pq.read_table(f"{folder}/lineitem.parquet")
    at = lines.schema.get_field_index("l_quantity")
    pq.write_table(lines.set_column(at, "l_quantity", pc.multiply(lines["l_quantity"], 2)), f"{folder}/lineitem.parquet")
    assert total("forecast_annual", "Projected_Passengers") == pytest.approx(2 * was, rel=1e-6)
