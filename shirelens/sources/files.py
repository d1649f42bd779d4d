"""File sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


class EmptyTableError(ValueError):
    """The table holds no rows."""


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file type: {ext or path}")
    return FORMATS[ext]


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | str | None):
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    elif fmt != "parquet":
        raise ValueError(f"{fmt} needs an explicit schema; inference would scan the data twice")
    return r.option("header", "true").option("multiLine", "false") if fmt == "csv" else r


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None,
               require_rows: bool = True) -> DataFrame:
    """Scan one table; missing path, unknown extension and (by a one-row probe) an empty table all raise."""
    fmt = _format_of(path, fmt)
    try:
        df = _reader(spark, fmt, schema).load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(path) from exc
        raise
    if require_rows and df.isEmpty():
        raise EmptyTableError(f"{path} contains no records")
    return df


def read_many(spark: SparkSession, directory: str, schema: T.StructType | str, fmt: str = "csv",
              unit: str = "unit_file") -> DataFrame:
    """All files of a directory tree in one scan; ``unit`` holds the file each row came from."""
    return (
        _reader(spark, fmt, schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{fmt}")
        .load(directory)
        .withColumn(unit, F.col("_metadata.file_path"))
    )


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys; column pruning makes a row cap needless."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, nulls kept so that every document has every field."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def as_document(df: DataFrame, name: str = "document") -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
