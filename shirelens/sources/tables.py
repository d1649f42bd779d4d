"""Relational sources and the append-style loads."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.pick import pick_row
from .files import write_table


def read_relational(spark: SparkSession, table: str, url: str | None = None, partition_column: str | None = None,
                    bounds: tuple[str, str] | None = None, partitions: int = 16,
                    options: Mapping[str, str] | None = None) -> DataFrame:
    """A catalog table, or with ``url`` a JDBC table.

    JDBC reads are split into ``partitions`` range queries when a partition column and its bounds are given;
    filters, projections and limits are pushed to the database either way.
    """
    if url is None:
        return spark.table(table)
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**dict(options or {}))
    if partition_column and bounds:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
             .option("upperBound", bounds[1]).option("numPartitions", str(partitions)))
    return r.load()


def keep_first(df: DataFrame, keys: list[str], order_by: Column) -> DataFrame:
    """One row per key, the smallest by ``order_by``."""
    return pick_row(df, keys, order_by, largest=False)


def unseen_rows(new: DataFrame, target: DataFrame, keys: list[str], order_by: Column) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target``, one per key."""
    return keep_first(new, keys, order_by).join(target.select(*keys), keys, "left_anti")


def insert_if_absent(new: DataFrame, path: str, keys: list[str], order_by: Column) -> None:
    """Append the unseen rows to a Parquet table; running it twice adds nothing."""
    spark = new.sparkSession
    target = spark.read.schema(new.schema).parquet(path)
    write_table(unseen_rows(new, target, keys, order_by), path, mode="append")


def stamp_run(df: DataFrame, run_id: str, loaded_at: datetime | None = None) -> DataFrame:
    """Add the run id and load time, so that the newest row per key stays well defined over re-runs."""
    at = F.current_timestamp() if loaded_at is None else F.lit(loaded_at)
    return df.withColumn("run_id", F.lit(run_id)).withColumn("created_at", at)


def append_run(df: DataFrame, path: str, run_id: str, loaded_at: datetime | None = None) -> None:
    write_table(stamp_run(df, run_id, loaded_at), path, mode="append")


def build_snapshot(frames: Mapping[str, DataFrame], directory: str, fmt: str = "json", only_missing: bool = False) -> None:
    """Write every read-side frame once under ``directory/<name>``; ``only_missing`` keeps existing ones."""
    for name, df in frames.items():
        write_table(df, f"{directory}/{name}", fmt=fmt, mode="ignore" if only_missing else "overwrite")
