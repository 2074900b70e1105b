"""Readers, writers, landing and the flows end to end."""

from datetime import date

import pytest
from farebox import session
from farebox.plans import jobs, landing
from farebox.schemas import CONSOLIDATED
from farebox.sources import readers, sinks, versions
from pyspark.sql import Observation
from tests.helpers import rows, staging, week
from tests.test_forecast import history
from tests.test_scalars import LABELS
from tests.test_sheets import HEAD, grid


def test_csv_roundtrip_and_rerun(spark, tmp_path):
    df = spark.createDataFrame([(date(2021, 3, 5), "a,b", 1.5), (None, None, None)],
                               "Week_Date date, Carrier_Name string, Bus_Departures double")
    for _ in range(2):
        sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "out"))
    assert rows(back) == rows(df)


def test_weekly_csv_reader(spark, tmp_path):
    names = [f.name for f in CONSOLIDATED]
    line = {n: "" for n in names} | {"Carrier_Name": "Academy", "Week_Date": "12/11/2020", "Bus_Departures": "4.0"}
    (tmp_path / "in.csv").write_text("\n".join([",".join(names), ",".join(line[n] for n in names)]) + "\n")
    got = readers.read_weekly_csv(spark, str(tmp_path / "in.csv")).first()
    assert (got.Carrier_Name, got.Week_Date, got.Bus_Departures, got.Notes) == ("Academy", date(2020, 12, 11), 4.0, None)


def test_table_sink_maps_columns_and_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 5)], "Year int, `Total Passengers` bigint")
    for _ in range(2):
        sinks.write_table(df, path, mapping={"Total Passengers": "Total_Passengers"})
    back = spark.read.parquet(path)
    assert back.columns == ["Year", "Total_Passengers"] and back.count() == 1


def test_failed_load_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([(1, 5)], "Year int, n bigint"), path)
    with pytest.raises(Exception, match="(?i)stop"):
        sinks.write_table(spark.range(3).selectExpr("1 as Year", "raise_error('stop') as n"), path)
    assert rows(spark.read.parquet(path)) == [(1, 5)]


def test_table_may_be_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([(2020, 5), (2021, 6)], "Year int, n bigint"), path, partition_by=["Year"])
    assert {p.name for p in (tmp_path / "t").iterdir()} >= {"Year=2020", "Year=2021"}
    sinks.write_table(spark.read.parquet(path).selectExpr("Year", "n + 1 as n"), path, partition_by=["Year"])
    assert sorted((r.Year, r.n) for r in spark.read.parquet(path).collect()) == [(2020, 6), (2021, 7)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_query_reader_options(spark):
    with pytest.raises(Exception, match="(?i)driver|jdbc"):
        readers.read_query(spark, "jdbc:nothing:x", "select 1", driver="no.such.Driver")


def test_stage_counts_while_writing(spark, tmp_path):
    seen = Observation("staged")
    staged = jobs.stage(staging(spark, [{"Week_Date": week(i)} for i in range(3)]), seen)
    sinks.write_table(staged, str(tmp_path / "s"))
    assert seen.get["rows"] == 3
    assert "ETL_Load_Date" in staged.columns and len(staged.columns) == 37


class FakeSession:
    def __init__(self, settings):
        self.conf = self
        self.settings = settings
        self.sparkContext = self
        self.applicationId = "app-test"

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_dir_rules():
    assert session.shared_dir(FakeSession({"spark.checkpoint.dir": "/x/", "spark.master": "yarn"})) == "/x"
    assert session.shared_dir(FakeSession({"spark.master": "yarn"})) is None
    local = FakeSession({"spark.master": "local[2]"})
    assert session.shared_dir(local) == session.shared_dir(local)


def test_landing_builds_once_refreshes_and_survives_cleaning(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "shared_dir", lambda s: str(tmp_path / "a"))
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    key = str(tmp_path)
    assert landing.land(spark, key, "t", build).count() == 1
    assert landing.land(spark, key, "t", build).count() == 1 and len(built) == 1
    assert landing.land(spark, key, "t", build, refresh=True).count() == 2
    memo = (spark.sparkContext.applicationId, key, landing.input_state(spark, key), "t")
    landing._landed[memo] = (str(tmp_path / "missing"), landing._landed[memo][1])
    assert landing.land(spark, key, "t", build).count() == 3
    monkeypatch.setattr(landing, "shared_dir", lambda s: None)
    assert landing.land(spark, key, "other", build).count() == 4


def test_publishing_survives_a_failure_between_any_two_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    load = lambda n: versions.publish(spark.range(n), path)
    read = lambda: readers.read_table(spark, path).count()

    def stop(*_):
        raise OSError("stop")

    load(1)
    assert read() == 1
    with pytest.raises(Exception, match="stop"):  # while rows are written
        versions.publish(spark.range(2).selectExpr("raise_error('stop') as id"), path)
    assert read() == 1
    with monkeypatch.context() as m, pytest.raises(OSError):  # rows are there, the pointer is not
        m.setattr(versions, "_point", stop)
        load(3)
    assert read() == 1
    half = tmp_path / "t" / "_pointers" / "000000000900"
    half.write_text("000000000900-cut")  # a pointer without its end
    assert read() == 1
    half.unlink()
    with monkeypatch.context() as m, pytest.raises(OSError):  # published, nothing reclaimed
        m.setattr(versions, "_reclaim", stop)
        load(4)
    assert read() == 4
    before = readers.read_table(spark, path)
    load(5)
    assert read() == 5 and before.count() == 4  # a reader of the last load is not cut off
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == versions.KEEP  # failed and older loads are gone
    assert len([p for p in (tmp_path / "t" / "_pointers").iterdir() if p.name.isdigit()]) == versions.KEEP


def test_a_second_load_at_once_fails_and_leaves_the_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.publish(spark.range(1), path)
    real = versions._point

    def other_first(s, p, number, folder):
        monkeypatch.setattr(versions, "_point", real)
        versions.publish(spark.range(7), path) if number == 2 else None
        real(s, p, number, folder)

    monkeypatch.setattr(versions, "_children", lambda s, p, f=versions._children: [n for n in f(s, p) if "000000000002" not in n])
    monkeypatch.setattr(versions, "_reclaim", lambda *_: None)
    monkeypatch.setattr(versions, "_point", other_first)
    with pytest.raises(Exception, match="(?i)exist"):
        versions.publish(spark.range(3), path)
    monkeypatch.undo()
    assert readers.read_table(spark, path).count() == 7


def test_publishing_renames_conforms_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(2020, 5), (2021, 6)], "Year int, `Total n` bigint")
    versions.publish(df, path, mapping={"Total n": "n"}, partition_by=["Year"])
    out = versions.publish(readers.read_table(spark, path).selectExpr("Year", "n + 1 as n"), path, partition_by=["Year"])
    assert sorted((r.Year, r.n) for r in out.collect()) == [(2020, 6), (2021, 7)]
    plain = str(tmp_path / "plain")
    df.write.parquet(plain)
    assert readers.read_table(spark, plain).count() == 2


def test_input_is_fingerprinted_once_and_on_refresh(spark, tmp_path, monkeypatch):
    """A nested partition counts, content is not read, and repeated use costs no listing."""
    folder = str(tmp_path)
    spark.range(6).selectExpr("id", "id % 2 as k").write.partitionBy("k").parquet(f"{folder}/lineitem.parquet")
    (tmp_path / "orders.parquet").write_bytes(b"one file")
    real, calls = landing.fingerprint, []
    monkeypatch.setattr(landing, "fingerprint", lambda s, f: calls.append(f) or real(s, f))
    first = landing.input_state(spark, folder)
    assert [landing.input_state(spark, folder) for _ in range(3)] == [first] * 3 and len(calls) == 1
    assert calls[0] == [f"{folder}/lineitem.parquet"]
    spark.range(1).write.mode("append").parquet(f"{folder}/lineitem.parquet/k=1")
    changed = landing.input_state(spark, folder, refresh=True)
    assert changed != first and landing.input_state(spark, folder) == changed
    (tmp_path / "orders.parquet").write_bytes(b"another file")  # a root that is a file is seen at once
    assert landing.input_state(spark, folder) != changed


def test_sheets_to_warehouse_to_forecast(spark, tmp_path):
    """Every sheet of the fixed label list, from grid to written tables; a rerun changes nothing."""
    sheets = [(label, year, [["Report"], HEAD, ["Academy", 10 + i, 300 + i], ["Martz", 5, 100 + 2 * i],
                             ["Total", 15 + i, 400 + 3 * i]])
              for i, (label, year) in enumerate((x, y) for y, labels in LABELS.items() for x in labels)]
    out = str(tmp_path / "flow")
    consolidated = jobs.consolidate_job(grid(spark, *sheets), f"{out}/csv")
    assert consolidated.count() == 117 * 3
    src = jobs.derive_staging(
        readers.read_weekly_csv(spark, f"{out}/csv"), [("2020-03-01", "During"), ("2022-01-01", "Post")], "Pre",
        [("2022-01-01", "High")], "Stable", date(2020, 3, 1), ["During"], ["High"], baseline_year=2021)
    first = {}
    for attempt in range(2):
        tables = jobs.warehouse_job(src, f"{out}/dw")
        counts = {name: rows(df.drop("ETL_Load_Date")) for name, df in tables.items()}
        first = first or counts
        assert counts == first
    assert len(first["fact"]) == 351 and len(first["dim_date"]) == 117 and len(first["dim_carrier"]) == 3
    assert len(first["carrier_performance"]) == 2  # the roll-up row is no carrier
    assert {r.COVID_Period for r in tables["period_impact_summary"].collect()} == {"During", "Post"}
    jobs.forecast_job(src, f"{out}/fc", baseline_year=2021, weeks=104, importance=False)
    weekly = spark.read.option("header", True).csv(f"{out}/fc/weekly_passenger_forecast")
    assert weekly.count() == 104 and weekly.columns[:4] == ["ds", "yhat", "yhat_lower", "yhat_upper"]


def test_derived_staging_of_plain_history(spark):
    src = staging(spark, history(30))
    assert src.count() == 30 and len(src.columns) == 36
