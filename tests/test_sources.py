from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shirelens.session import materialize, shared_dir
from shirelens.sources import files as fl, tables as tb
from shirelens.operators import readside as rs

SCHEMA = "k long, v string"


def test_missing_empty_and_unknown(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        fl.read_table(spark, str(tmp_path / "no.csv"), SCHEMA)
    with pytest.raises(ValueError, match="unsupported"):
        fl.read_table(spark, str(tmp_path / "x.xlsx"), SCHEMA)
    with pytest.raises(ValueError, match="schema"):
        fl.read_table(spark, str(tmp_path / "x.csv"))
    empty = str(tmp_path / "e.parquet")
    fl.write_table(spark.createDataFrame([], SCHEMA), empty)
    with pytest.raises(fl.EmptyTableError):
        fl.read_table(spark, empty, SCHEMA)
    assert fl.read_table(spark, empty, SCHEMA, require_rows=False).count() == 0


def test_write_makes_parents_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "a" / "b.csv")
    for n in (3, 2):
        fl.write_table(spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("v")), path, fmt="csv")
    assert fl.read_table(spark, path, SCHEMA).count() == 2


def test_documents_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], SCHEMA)
    assert fl.as_document(df).first()[0] == '{"k":1,"v":null}'
    fl.write_documents(df, str(tmp_path / "d"))
    assert fl.read_documents(spark, str(tmp_path / "d"), SCHEMA).first().v is None


def test_insert_is_idempotent_and_dedupes_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    fl.write_table(spark.createDataFrame([(1, "old")], SCHEMA), path)
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (3, "c")], SCHEMA)
    for _ in range(2):
        tb.insert_if_absent(new, path, ["k"], F.col("v"))
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "old"), (2, "a"), (3, "c")]


def test_runs_append_and_latest_wins(spark, tmp_path):
    path = str(tmp_path / "p")
    for run, v in (("r1", "old"), ("r2", "new")):
        tb.append_run(spark.createDataFrame([(1, v)], SCHEMA), path, run, datetime(2024, 1, int(run[1])))
    log = spark.read.parquet(path)
    assert log.count() == 2 and rs.latest_per_key(log, "k", "run_id").first().v == "new"


def test_snapshot_keeps_existing_when_asked(spark, tmp_path):
    tb.build_snapshot({"a": spark.range(1)}, str(tmp_path))
    tb.build_snapshot({"a": spark.range(5), "b": spark.range(2)}, str(tmp_path), only_missing=True)
    assert [spark.read.schema("id long").json(str(tmp_path / n)).count() for n in "ab"] == [1, 2]


def test_catalog_table(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert tb.read_relational(spark, "three").count() == 3


def test_materialized_tables_live_in_the_shared_folder(spark):
    df = materialize(spark.range(10), "probe", balance=True)
    assert df.count() == 10 and df.inputFiles()[0].replace("file://", "").startswith(shared_dir(spark).replace("file:", ""))
