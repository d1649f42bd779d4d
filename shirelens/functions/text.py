"""Key and text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN = "Unknown"


def match_key(c: Column) -> Column:
    """Case- and padding-insensitive form of a key, for both sides of an equality."""
    return F.lower(F.trim(c))


def title_case(c: Column) -> Column:
    """Capitalise after every non-letter, so ``hubballi-dharwad`` gives ``Hubballi-Dharwad``.

    ``initcap`` alone only looks at blanks, so it is applied to each run of letters.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def canonical_name(raw: Column, alias: Column) -> Column:
    """Blank -> ``Unknown``; a known alias -> its canonical name; anything else title-cased."""
    return F.when(is_blank(raw), F.lit(UNKNOWN)).otherwise(F.coalesce(alias, title_case(F.trim(raw))))


def signed_label(label: Column, value: Column) -> Column:
    """``label (+x.xx)`` text used in explanations."""
    return F.format_string("%s (%s%.2f)", label, F.when(value >= 0, "+").otherwise("-"), F.abs(value))
