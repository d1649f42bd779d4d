"""Key canonicalisation and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import canonical_name, is_blank, match_key
from ..session import checkpoint


def canonical_key(df: DataFrame, key: str, aliases: DataFrame, alias: str = "alias", canonical: str = "canonical",
                  out: str | None = None) -> DataFrame:
    """Replace raw names by canonical ones; many raw names may share one.

    ``aliases`` must hold one row per upper-cased alias.  No broadcast is forced: Spark picks it by size, and
    blank keys get keys of many values that match nothing, so that missing names do not all meet in one task.
    """
    lookup = aliases.select(F.upper(F.trim(alias)).alias("_alias"), F.col(canonical).alias("_canonical"))
    probe = F.when(~is_blank(F.col(key)), F.upper(F.trim(key))).otherwise(_no_match())
    joined = df.withColumn("_probe", probe).join(lookup, F.col("_probe") == F.col("_alias"), "left")
    name = canonical_name(F.col(key), F.col("_canonical"))
    return joined.withColumn(out or key, name).drop("_probe", "_alias", "_canonical")


def _no_match() -> Column:
    """A key that no name has, of many values."""
    return F.concat(F.lit("\u0000"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))


def lookup_or_default(df: DataFrame, key: str, table: DataFrame, value: str, default: float) -> DataFrame:
    """Left lookup; the default stands in for unknown keys and ``<value>_imputed`` marks it."""
    found = df.join(table.select(key, F.col(value).alias("_found")), key, "left")
    return found.withColumn(value, F.coalesce(F.col("_found"), F.lit(default))).withColumn(
        f"{value}_imputed", F.col("_found").isNull()).drop("_found")


def attach_by_name(df: DataFrame, key: str, table: DataFrame, table_key: str, columns: list[str], how: str = "left") -> DataFrame:
    """Join on the case-insensitive trimmed name: coordinates, deployments, indicators."""
    side = table.select(match_key(F.col(table_key)).alias("_k"), *columns)
    return df.withColumn("_n", F.coalesce(match_key(F.col(key)), _no_match())).join(side, F.col("_n") == F.col("_k"), how).drop("_n", "_k")


def unmatched_names(df: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    side = table.select(match_key(F.col(table_key)).alias("_k"))
    return (df.select(key, match_key(F.col(key)).alias("_n")).join(side, F.col("_n") == F.col("_k"), "left_anti")
            .select(key).distinct())


def select_by_name(df: DataFrame, key: str, name: str) -> DataFrame:
    """Case-insensitive equality filter; the argument is folded once, on the driver."""
    return df.where(match_key(F.col(key)) == name.strip().lower())


def sequential_ids(df: DataFrame, order_by: list, out: str = "seq") -> DataFrame:
    """0-based dense numbering in key order without a single-task window.

    Range-partition and sort, checkpoint that layout so that both passes below see the same partitions, then
    add to each row's place in its partition the number of rows before that partition.  The offsets table has
    one row per partition.
    """
    laid_out = checkpoint(df.orderBy(*order_by)).withColumn("_mid", F.monotonically_increasing_id())
    part, place = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    rows = laid_out.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # this window sees one row per partition
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per partition, so its size is bounded by the partition count
    return rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + place).drop(
        "_mid", "_part", "_offset")
