from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shirelens.operators.incidents import surge, window_counts
from shirelens.streaming import alerts as st

SCHEMA = "ts timestamp_ntz, kind string, value double"
START = datetime(2024, 1, 1)


@pytest.fixture
def source(spark, tmp_path):
    def add(name, minutes):
        rows = [(START + timedelta(minutes=m), "a" if m % 2 else "b", float(m % 120)) for m in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        return str(tmp_path / "in" / name)
    return add


def run(spark, directory, tmp_path):
    stream = st.event_stream(spark, directory, spark.read.parquet(directory).schema)
    windows = st.closed_windows(stream, "kind", "ts", "1 hour", "10 minutes", "value")
    st.start_window_sink(windows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return spark.read.schema(windows.schema).parquet(str(tmp_path / "out"))


def test_only_closed_windows_and_no_repeats_on_restart(spark, source, tmp_path):
    directory = source("x", range(0, 400, 5))
    first = run(spark, directory, tmp_path)
    assert first.agg(F.max("window_end")).first()[0] <= START + timedelta(minutes=385)
    n = first.count()
    assert run(spark, directory, tmp_path).count() == n == 12  # six closed hours, two kinds
    batch = window_counts(spark.read.parquet(directory).withColumn("ts", F.col("ts").cast("timestamp")), "kind", "ts", "1 hour", "value")
    assert first.exceptAll(batch).count() == 0


def test_late_rows_are_dropped(spark, source, tmp_path):
    directory = source("y", range(0, 400, 5))
    run(spark, directory, tmp_path)
    late = spark.createDataFrame([(START, "a", 1.0)], SCHEMA).coalesce(1)
    late.write.mode("append").parquet(directory)
    got = run(spark, directory, tmp_path).where(F.col("window_start") == START)
    assert {r.kind: r.n for r in got.collect()} == {"a": 6, "b": 6}


def test_alert_sink(spark, source, tmp_path):
    directory = source("z", range(0, 400, 5))
    stream = st.event_stream(spark, directory, spark.read.parquet(directory).schema)
    windows = st.closed_windows(stream, "kind", "ts", "1 hour", "10 minutes", "value")
    for _ in range(2):
        st.start_alert_sink(windows, "kind", 4.0, str(tmp_path / "alerts"), str(tmp_path / "s")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "alerts"))
    assert got.count() == 12 and {r.alert_type for r in got.collect()} == {"CRIME_HOTSPOT"}


def test_surge_ratio(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 4), ("a", 3, 9), ("b", 1, 5)], "k string, t int, n long")
    got = {(r.k, r.t): r.surge_ratio for r in surge(df, "k", "t", "n", 2).collect()}
    assert got == {("a", 1): None, ("a", 2): 2.0, ("a", 3): 3.0, ("b", 1): None}
