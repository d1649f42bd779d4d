"""Placing a limited number of units so that they cover the most risk.

The exact problem is an integer program for one machine; here it is the greedy cover, which reaches at least
63 % of the optimum, together with an upper bound that often proves a plan optimal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import geo
from ..session import materialize

RISK_TYPE = "decimal(28,2)"  # exact sums, so that picks never hang on the order of additions


def coverage_groups(spots: DataFrame, bases: DataFrame, radii: list[float], spot: tuple[str, str, str] = ("center_lat", "center_lon", "risk_score"),
                    base: tuple[str, str, str] = ("base_id", "base_lat", "base_lon")) -> DataFrame:
    """Spots folded to ``(radius, covers, risk, n)``: spots reached by the same bases are interchangeable.

    The bases of a grid cell form one row, so each spot meets exactly one row, and the exact distance decides
    inside it.  Whatever the number of spots, the result has at most one row per distinct set of bases, and the
    rounds of the greedy search only ever read that.
    """
    reach = max(radii)
    side = reach / geo.EARTH_RADIUS_KM
    lat, lon, risk = spot
    bid, blat, blon = (F.col(c) for c in base)
    # bases at one position cover the same spots; the smallest id stands for them
    sites = bases.groupBy(blat.alias("la"), blon.alias("lo")).agg(F.min(bid).alias("id"))
    blat, blon = F.col("la"), F.col("lo")
    by_cell = (
        sites.select("id", "la", "lo",
                     F.explode(geo.reach_cells(blat, blat, blon, blon, reach, side)).alias("_cell"))
        .groupBy("_cell").agg(F.collect_list(F.struct("id", "la", "lo")).alias("_near")))
    la, lo = F.col(lat), F.col(lon)
    placed = spots.select(la, lo, F.col(risk).cast("decimal(18,2)").alias("risk"), geo.cell_id(la, lo, side).alias("_cell"))
    with_d = placed.join(by_cell, "_cell", "left").withColumn("_near", F.transform(
        F.coalesce("_near", F.array().cast(by_cell.schema["_near"].dataType)),
        lambda b: F.struct(b["id"].alias("id"), b["la"].alias("la"), b["lo"].alias("lo"),
                           geo.haversine_km(b["la"], b["lo"], la, lo).alias("d"))))
    rows = with_d.select("risk", "_near", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius"))
    covers = F.array_sort(F.transform(F.filter("_near", lambda b: b["d"] <= F.col("radius")),
                                      lambda b: F.struct(b["id"].alias("id"), b["la"].alias("la"), b["lo"].alias("lo"))))
    return rows.select("radius", covers.alias("covers"), "risk").groupBy("radius", "covers").agg(
        F.sum("risk").cast(RISK_TYPE).alias("risk"), F.count(F.lit(1)).alias("n"))


def _picked(picks: dict[float, list], id_type: T.DataType) -> Column:
    """Array of a radius' picked ids, from one map literal: the plan stays the same every round."""
    kind = T.ArrayType(id_type)
    entries = [x for r, v in picks.items() for x in (F.lit(r), F.array(*[F.lit(p[0]) for p in v]).cast(kind))]
    return F.element_at(F.create_map(*entries), F.col("radius"))


def plan_schema(id_type: T.DataType) -> T.StructType:
    """Columns of a plan; bases keep the type of their ids."""
    return T.StructType([
        T.StructField("radius", T.DoubleType()), T.StructField("units", T.IntegerType()), T.StructField("base_id", id_type),
        T.StructField("gain", T.DecimalType(28, 2)), T.StructField("covered", T.DecimalType(28, 2)),
        T.StructField("covered_spots", T.LongType()), T.StructField("la", T.DoubleType()), T.StructField("lo", T.DoubleType())])


def _far_apart(a: tuple, b: tuple, km: float) -> bool:
    """Plain great-circle test for two picks on the driver, with slack on the safe side."""
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(h))) > km * (1 + 1e-9)


def greedy_plan(groups: DataFrame, k: int, radii: list[float]) -> DataFrame:
    """Up to ``k`` picks for every radius at once: ``(radius, units, base_id, gain, covered, covered_spots, la, lo)``.

    A round is one aggregate over the folded groups and brings back at most ``k`` rows per radius, the largest
    gains.  Gains only ever shrink, and bases further apart than two radii share no spot, so the head of that list
    is taken as long as each base is clear of those just picked: exactly the order of one pick per round, in far
    fewer rounds.  Ties go to the smaller base id; a radius stops when nothing is left to gain.
    """
    picks: dict[float, list] = {float(r): [] for r in radii}
    id_type = groups.schema["covers"].dataType.elementType["id"].dataType
    covered, spots = {r: 0 for r in picks}, {r: 0 for r in picks}
    plan, active = [], set(picks)
    order = W.partitionBy("radius").orderBy(F.desc("gain"), F.asc("b.id"))
    while active:
        free = F.col("radius").isin(*sorted(active)) & ~F.arrays_overlap("covers.id", _picked(picks, id_type))
        gains = groups.where(free).select("radius", F.explode("covers").alias("b"), "risk", "n").groupBy("radius", "b").agg(
            F.sum("risk").cast(RISK_TYPE).alias("gain"), F.sum("n").alias("n"))
        rows = gains.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "radius", "rank", "b.id", "b.la", "b.lo", "gain", "n").collect()
        for radius in list(active):
            batch: list = []
            for r in sorted((r for r in rows if r["radius"] == radius), key=lambda r: r["rank"]):
                base = (r["id"], r["la"], r["lo"])
                if r["gain"] <= 0 or len(picks[radius]) == k or not all(_far_apart(base, b, 2 * radius) for b in batch):
                    break
                batch.append(base)
                picks[radius].append(base)
                covered[radius] += r["gain"]
                spots[radius] += r["n"]
                plan.append((radius, len(picks[radius]), r["id"], r["gain"], covered[radius], spots[radius], r["la"], r["lo"]))
            if not batch or len(picks[radius]) == k:
                active.discard(radius)
    return groups.sparkSession.createDataFrame(plan, plan_schema(id_type))


def coverage_bounds(groups: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """``(radius, units, bound)``: no plan of that many units covers more.

    After any number of picks, a plan of u units gains at most the u largest remaining gains; the bound is the
    least such sum over all prefixes of the greedy plan.  A group counts for the prefixes before its first pick.
    """
    seq = plan.groupBy("radius").agg(F.array_sort(F.collect_list(F.struct("units", "base_id", "covered"))).alias("seq"))
    # one row per radius
    placed = groups.join(F.broadcast(seq), "radius", "left")
    ids = F.col("covers.id")
    hits = F.filter("seq", lambda p: F.array_contains(ids, p["base_id"]))
    first = F.coalesce(F.get(hits, F.lit(0))["units"], F.lit(k))
    folded = placed.select("radius", F.explode(ids).alias("base_id"), first.alias("first"), "risk").groupBy(
        "radius", "base_id", "first").agg(F.sum("risk").alias("risk"))
    gains = folded.select("radius", "base_id", F.explode(F.sequence(F.lit(0), F.least("first", F.lit(k)) - 1)).alias("i"), "risk").groupBy(
        "radius", "i", "base_id").agg(F.sum("risk").alias("gain"))
    w = W.partitionBy("radius", "i").orderBy(F.desc("gain"), "base_id")
    ranked = gains.withColumn("units", F.row_number().over(w)).where(F.col("units") <= k).withColumn(
        "top", F.sum("gain").over(w.rowsBetween(W.unboundedPreceding, 0)))
    before = plan.select("radius", F.col("units").alias("i"), "covered")
    sums = ranked.join(F.broadcast(before), ["radius", "i"], "left").select(
        "radius", "i", "units", (F.coalesce("covered", F.lit(0)) + F.col("top")).alias("bound"))
    # a prefix with fewer than u bases left keeps its last sum for larger u
    wide = sums.groupBy("radius", "i").agg(F.array_sort(F.collect_list(F.struct("units", "bound"))).alias("s")).select(
        "radius", "i", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda u: F.get(
            F.col("s"), F.least(u, F.size("s")) - 1)["bound"])).alias("p", "bound"))
    return wide.groupBy("radius", (F.col("p") + 1).alias("units")).agg(F.min("bound").alias("bound"))


def max_coverage(spots: DataFrame, bases: DataFrame, k: int, radius_km: float, **columns) -> tuple[DataFrame, DataFrame]:
    """Plan rows and one metrics row for ``k`` units of one radius."""
    groups = materialize(coverage_groups(spots, bases, [radius_km], **columns), "coverage")
    plan = greedy_plan(groups, k, [radius_km])
    return plan, coverage_metrics(groups, plan, [radius_km], [k])


def coverage_metrics(groups: DataFrame, plan: DataFrame, radii: list[float], units: list[int]) -> DataFrame:
    """Covered share, uncovered spots and bound for every (radius, units).

    Greedy picks are nested: the plan for fewer units is a prefix, so one run serves all unit counts.  Without any
    spot everything counts as covered; with spots but no risk nothing does.
    """
    spark, c = groups.sparkSession, F.col
    asked = spark.createDataFrame([(float(r), int(u)) for r in radii for u in units], "radius double, units int")
    totals = groups.groupBy("radius").agg(F.sum("risk").alias("total"), F.sum("n").alias("spots"))
    steps = plan.select("radius", c("units").alias("u"), "covered", "covered_spots")
    got = asked.join(steps, (asked["radius"] == steps["radius"]) & (c("u") <= c("units")), "left").groupBy(
        asked["radius"], "units").agg(
        F.coalesce(F.max("covered"), F.lit(0)).alias("covered"), F.coalesce(F.max("covered_spots"), F.lit(0)).alias("covered_spots"),
        F.count("u").alias("units_used"))
    bounds = coverage_bounds(groups, plan, max(units))
    share = lambda v: F.round(v.cast("double") / c("total").cast("double") * 100, 1)
    return got.join(totals, "radius", "left").join(bounds, ["radius", "units"], "left").select(
        "radius", "units",
        F.when(c("total").isNull(), 100.0).when(c("total") > 0, share(c("covered"))).otherwise(0.0).alias("covered_pct"),
        (F.coalesce("spots", F.lit(0)) - c("covered_spots")).alias("uncovered_count"),
        F.coalesce("spots", F.lit(0)).alias("total_spots"), "units_used",
        F.when(c("total").isNull(), 100.0).when(c("total") > 0, F.least(
            F.lit(100.0), share(F.coalesce("bound", F.lit(0))))).otherwise(0.0).alias("upper_bound_pct"))


def coverage_grid(spots: DataFrame, bases: DataFrame, units: list[int], radii: list[float], **columns) -> DataFrame:
    """Coverage of every (units, radius) scenario from one greedy run."""
    groups = materialize(coverage_groups(spots, bases, radii, **columns), "coverage")
    return coverage_metrics(groups, greedy_plan(groups, max(units), radii), radii, units)


def plan_summary(metrics: DataFrame, requested_units: int) -> DataFrame:
    """Residual risk and status; a plan is called optimal only where its bound proves it."""
    c = F.col
    proven = c("covered_pct") >= c("upper_bound_pct")
    return metrics.select(
        F.lit(requested_units).alias("total_units"), c("radius").alias("max_radius_km"),
        c("total_spots").alias("regions_considered"), c("covered_pct").alias("risk_reduced"),
        F.round(100.0 - c("covered_pct"), 1).alias("residual_risk"),
        F.when((c("units_used") == 0) & (c("total_spots") > 0), "Infeasible").when(proven, "Optimal")
        .otherwise("Feasible").alias("solver_status"), "covered_pct", "uncovered_count")


def assignments(plan: DataFrame, bases: DataFrame, base_id: str = "base_id", name: str = "base_name") -> DataFrame:
    """One row per deployed unit; the plan has at most k rows."""
    return bases.select(base_id, name).join(F.broadcast(plan.select("radius", "units", base_id)), base_id).select(
        "radius", "units", F.concat(F.lit("Station:"), name).alias("assignment"), F.lit(1).alias("units_assigned"))
