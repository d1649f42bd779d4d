"""Numeric expressions: lenient parsing, guarded ratios, clipping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Digits with at most one dot; no sign, exponent or blanks.
PLAIN_NUMBER = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"


def to_number_or_zero(c: Column) -> Column:
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double")).otherwise(F.lit(0.0))


def tail_sum(cells: list[Column]) -> Column:
    """Row-wise sum of the numeric-looking cells among ``cells``."""
    return F.aggregate(F.array(*[to_number_or_zero(c) for c in cells]), F.lit(0.0), lambda acc, x: acc + x)


def nan_to_null(c: Column) -> Column:
    """NaN poisons ``sum`` and ``avg``; NULL is skipped."""
    return F.when(~F.isnan(c), c)


def or_default(c: Column, default: float) -> Column:
    return F.coalesce(c, F.lit(default))


def guarded_ratio(num: Column, den: Column, scale: float = 1.0, digits: int = 2) -> Column:
    """``round(num / den * scale)``, 0 where the denominator is not positive (ANSI division would raise)."""
    return F.when(den > 0, F.round(num / den * F.lit(scale), digits)).otherwise(F.lit(0.0))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def hash_int(*parts: Column) -> Column:
    """32-bit integer from md5 of ``|``-joined parts: reproducible randomness in any SQL engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_unit(*parts: Column) -> Column:
    """Uniform double in (0, 1) from :func:`hash_int`."""
    return (hash_int(*parts) + F.lit(0.5)) / F.lit(4294967296.0)
