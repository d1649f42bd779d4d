"""Data quality: profiles, key consistency, required columns, load metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..functions.numeric import total

PASSED, FAILED, FAILED_OVERALL = "PASSED", "FAILED", "FAILED WITH WARNINGS"


def clean_columns(df: DataFrame) -> DataFrame:
    """Trim, lower-case, blanks and hyphens to ``_``, parentheses dropped."""
    names = [re.sub(r"[()]", "", re.sub(r"[ -]", "_", c.strip().lower())) for c in df.columns]
    return df.toDF(*names)


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _is_missing(field: T.StructField) -> Column:
    c = F.col(field.name)
    return c.isNull() | F.isnan(c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def infinity_count(df: DataFrame) -> Column:
    """Aggregate expression: infinities over all floating columns."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return F.lit(0).cast("long")
    return total([F.coalesce(F.count_if(F.abs(F.col(c)) == float("inf")), F.lit(0)) for c in floats])


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """One report row: rows, columns, missing cells, duplicate rows, infinities.

    Duplicates are counted by a SHA-256 digest of the whole row, so the shuffle carries 64 characters per
    distinct row instead of the row itself, and copies fold together before it.
    """
    missing = total([F.when(_is_missing(f), 1).otherwise(0) for f in df.schema]).cast("long")
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    infinite = total([F.when(F.abs(F.col(c)) == float("inf"), 1).otherwise(0) for c in floats]) if floats else F.lit(0)
    # adding zero makes -0.0 and 0.0 the same value
    cells = [(F.col(c) + F.lit(0.0)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]
    digest = F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)
    folded = (
        df.select(digest.alias("_row"), missing.alias("_missing"), F.coalesce(infinite, F.lit(0)).alias("_inf"))
        .groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), F.sum("_missing").alias("_missing"), F.sum("_inf").alias("_inf"))
    )
    out = folded.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_values"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
        F.coalesce(F.sum("_inf"), F.lit(0)).cast("long").alias("invalid_numeric_values"),
    )
    return out.select(
        F.lit(dataset).alias("dataset"),
        F.when(F.col("n_rows") > 0, PASSED).otherwise(FAILED).alias("status"),
        F.when(F.col("n_rows") == 0, "Empty dataset").alias("error"),
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"),
        "missing_values", "duplicate_rows", "invalid_numeric_values",
    )


def failed_report(spark, dataset: str, error: str) -> DataFrame:
    """Report row of an input that could not be read."""
    return spark.range(1).select(
        F.lit(dataset).alias("dataset"), F.lit(FAILED).alias("status"), F.lit(error).alias("error"),
        *[F.lit(None).cast("long").alias(c) for c in
          ("n_rows", "n_columns", "missing_values", "duplicate_rows", "invalid_numeric_values")],
    )


def stack_reports(reports: list[DataFrame]) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def overall_status(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.when(F.max(F.col("status") == FAILED), FAILED_OVERALL).otherwise(PASSED).alias("overall_status"),
        F.count(F.lit(1)).alias("datasets_validated"),
        F.count_if(F.col("status") == FAILED).alias("datasets_failed"),
    )


def key_consistency(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side with ``both``/``left_only``/``right_only``.

    One union and one aggregate; the key lists stay rows, so their number has no limit.
    """
    sides = (
        left.select(F.col(key).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(F.col(key).alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r")))
        .where(F.col("key").isNotNull())
    )
    return sides.groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r")).select(
        "key", F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left_only")
        .otherwise("right_only").alias("side"))


def consistency_summary(keys: DataFrame) -> DataFrame:
    return keys.agg(
        F.count_if(F.col("side") != "right_only").alias("total_left"),
        F.count_if(F.col("side") != "left_only").alias("total_right"),
        F.count_if(F.col("side") == "both").alias("matched"),
    )


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The same comparison with set operations: intersection and the two differences."""
    a, b = left.select(F.col(key).alias("key")), right.select(F.col(key).alias("key"))

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select("key", F.lit(name).alias("side"))

    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "left_only")).unionByName(
        tag(b.subtract(a), "right_only"))


def duplicate_key_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows that repeat an earlier key."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_extra")).agg(
        F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicate_keys"))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Count rows while they pass to the sink: load metrics without a second scan."""
    obs = Observation(name)
    exprs = [F.count(F.lit(1)).alias("rows")] + [m.alias(k) for k, m in metrics.items()]
    return df.observe(obs, *exprs), obs


def reconciliation(loaded: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows loaded, kept and removed between two stages, as a frame."""
    counts = loaded.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        cleaned.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("rows_loaded"),
                      F.coalesce(F.sum("b"), F.lit(0)).alias("rows_cleaned")).withColumn(
        "rows_removed", F.col("rows_loaded") - F.col("rows_cleaned"))
