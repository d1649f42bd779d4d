"""One whole row per key by an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def pick_row(df: DataFrame, keys: list[str], order: Column | str, largest: bool) -> DataFrame:
    """The row of smallest or largest order per key, combined on the map side.

    Columns of fixed width are picked one by one, which keeps Spark on a hash aggregate; all of them compare
    the same order and so come from the same row.  Text needs the struct form, whose partial aggregate sorts.
    """
    by = F.max_by if largest else F.min_by
    order = F.col(order) if isinstance(order, str) else order

    def pick(what):
        """Rows without an order come last; where a key has no other, its first row stands for it."""
        return F.when(F.count(order) > 0, by(what, order)).otherwise(F.first(what))

    rest = [f for f in df.schema if f.name not in keys]
    if all(isinstance(f.dataType, _FIXED_WIDTH) for f in rest):
        return df.groupBy(*keys).agg(*[pick(F.col(f.name)).alias(f.name) for f in rest]).select(*df.columns) if rest else df.distinct()
    picked = df.groupBy(*keys).agg(pick(F.struct(*[f.name for f in rest])).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
