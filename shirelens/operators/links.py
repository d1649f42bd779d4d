"""Which pairs of grid cells hold two points within reach of each other?

Used by both clustering operators.  Comparing every point of one crowded cell with every point of the next is
quadratic, so only small pairs are compared point by point.  Larger ones are described by their parts: a part
has a box, a representative point and its number of distinct positions.  A pair of parts is accepted when the
representatives are close, dropped when the boxes are too far apart, compared directly when few positions are
involved, and otherwise split again.  The answer is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

DIRECT_PAIRS = 4096  # positions compared point by point in one pair of parts
MAX_LEVEL = 20


def box_gap_squared(a: str, b: str, dims: list[str]) -> Column:
    """Squared distance between two boxes with fields ``lo_*`` and ``hi_*``."""
    out = F.lit(0.0)
    for d in dims:
        gap = F.greatest(F.col(f"{a}.lo_{d}") - F.col(f"{b}.hi_{d}"), F.col(f"{b}.lo_{d}") - F.col(f"{a}.hi_{d}"), F.lit(0.0))
        out = out + gap * gap
    return out


def parts_of(points: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Box, representative and number of positions of each group of distinct positions."""
    box = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    # any real position represents its group; picked field by field (from one row) this stays a hash aggregate
    fields = points.schema["pos"].dataType.fieldNames()
    grouped = points.groupBy(*keys).agg(*[F.first(f"pos.{f}").alias(f"_{f}") for f in fields], F.count(F.lit(1)).alias("n"), *box)
    pos = F.struct(*[F.col(f"_{f}").alias(f) for f in fields])
    return grouped.select(*keys, F.struct(pos.alias("pos"), "n", *[f"{n}_{d}" for d in dims for n in ("lo", "hi")]).alias("part"))


def linked_cells(points: DataFrame, pairs: DataFrame, dims: list[str], reach: float,
                 close: Callable[[Column, Column], Column], sub_key: Callable[[int], Column],
                 parent_of: Callable[[Column], Column]) -> DataFrame:
    """Filter candidate cell pairs ``(a, b)`` to those with two points for which ``close`` holds.

    ``points``: ``cell``, ``pos`` (struct with what ``close`` and ``sub_key`` need) and the coordinates ``dims``,
    in which points further apart than ``reach`` are never close.
    """
    limit = F.lit((reach * (1 + 1e-9)) ** 2 + 1e-24)
    spots = materialize(points.select("cell", "pos", *dims).distinct(), "positions")
    near, small = box_gap_squared("pa", "pb", dims) <= limit, F.col("pa.n") * F.col("pb.n") <= DIRECT_PAIRS
    hit = close(F.col("pa.pos"), F.col("pb.pos"))
    found: list[DataFrame] = []

    def side(df: DataFrame, cell: str, part: str, extra: str | None = None) -> DataFrame:
        cols = [F.col("cell").alias(cell), F.col("part").alias(part)]
        return df.select(*cols, *([F.col("sub").alias(extra)] if extra else []))

    cells = parts_of(spots, ["cell"], dims)
    todo = (pairs.join(side(cells, "a", "pa"), "a").join(side(cells, "b", "pb"), "b").where(near)
            .withColumn("hit", hit).withColumn("small", small))
    todo = materialize(todo.select("a", "b", "hit", "small"), "cell-pairs")
    found.append(todo.where("hit").select("a", "b"))
    direct = todo.where("NOT hit AND small").select("a", "b")
    pos_a, pos_b = (spots.select(F.col("cell").alias(c), F.col("pos").alias(p)) for c, p in (("a", "xa"), ("b", "xb")))
    found.append(direct.join(pos_a, "a").join(pos_b, "b").where(close(F.col("xa"), F.col("xb"))).select("a", "b"))

    open_pairs = todo.where("NOT hit AND NOT small").select("a", "b", F.lit(None).alias("sa"), F.lit(None).alias("sb"))
    level = 0
    while not open_pairs.isEmpty():
        level += 1
        involved = open_pairs.select(F.col("a").alias("cell")).unionByName(open_pairs.select(F.col("b").alias("cell"))).distinct()
        fine = spots.join(involved, "cell", "left_semi").withColumn("sub", sub_key(level))
        parts = materialize(parts_of(fine, ["cell", "sub"], dims), "parts")
        pa, pb = side(parts, "a", "pa", "ca"), side(parts, "b", "pb", "cb")
        if level == 1:
            tried = open_pairs.select("a", "b").join(pa, "a").join(pb, "b")
        else:
            tried = (open_pairs.join(pa.withColumn("sa", parent_of(F.col("ca"))), ["a", "sa"])
                     .join(pb.withColumn("sb", parent_of(F.col("cb"))), ["b", "sb"]))
        tried = tried.where(near).withColumn("hit", hit).withColumn("small", small)
        tried = materialize(tried.select("a", "b", F.col("ca").alias("sa"), F.col("cb").alias("sb"), "hit", "small"), "tried")
        hits = tried.where("hit").select("a", "b").distinct()
        found.append(hits)
        rest = tried.join(hits, ["a", "b"], "left_anti")
        last = level >= MAX_LEVEL
        direct = (rest if last else rest.where("small")).select("a", "b", "sa", "sb")
        fa = fine.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), F.col("pos").alias("xa"))
        fb = fine.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), F.col("pos").alias("xb"))
        done = materialize(direct.join(fa, ["a", "sa"]).join(fb, ["b", "sb"]).where(close(F.col("xa"), F.col("xb")))
                           .select("a", "b").distinct(), "direct")
        found.append(done)
        if last:
            break
        open_pairs = rest.where("NOT small").join(done, ["a", "b"], "left_anti").select("a", "b", "sa", "sb")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
