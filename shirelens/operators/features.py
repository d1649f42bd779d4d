"""Composite indices and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FEATURE_COLUMNS = [
    "population_density", "crime_rate_per_100k", "literacy_pct", "female_ratio", "urban_pct",
    "crime_growth_rate", "economic_activity_index", "crime_severity_score", "normalized_crime_index",
]
# Baseline growth, household area factor and the weights of severity and hotspot score.
POPULATION_GROWTH = 1.25
HOUSEHOLD_AREA = 0.04
SEVERITY_WEIGHTS = (4.0, 1.5)
HOTSPOT_WEIGHTS = (0.45, 0.35, 0.20)


def global_stats(df: DataFrame, **aggs: Column) -> Column:
    """Whole-table aggregates as one scalar struct column: a single-row subquery, not a join or a window."""
    row = df.agg(*[a.alias(k) for k, a in aggs.items()])
    return row.select(F.struct(*aggs).alias("s")).scalar()


def join_summary(profiles: DataFrame, summary: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Profiles with incident summaries; ``how="left"`` keeps regions without incidents, zero-filled."""
    joined = profiles.join(summary, key, how)
    return joined.na.fill(0.0) if how == "left" else joined


def composite_indices(features: DataFrame, key: str = "region") -> DataFrame:
    """Density, rate, severity, normalised index and hotspot score."""
    c = F.col
    base = features.select(
        key, c("total_population"),
        F.round(c("total_population") / (c("households") * HOUSEHOLD_AREA + 1.0), 2).alias("population_density"),
        F.round(c("total_crimes_latest") / c("total_population") * 100000.0, 2).alias("crime_rate_per_100k"),
        F.round("literacy_rate", 2).alias("literacy_pct"),
        F.round("female_ratio", 4).alias("female_ratio"),
        F.round("urban_pct", 2).alias("urban_pct"),
        F.lit(POPULATION_GROWTH).alias("population_growth"),
        F.round("crime_growth", 2).alias("crime_growth_rate"),
        F.round("work_participation_rate", 2).alias("economic_activity_index"),
        F.round((c("violent_crimes_sum") * SEVERITY_WEIGHTS[0] + c("property_crimes_sum") * SEVERITY_WEIGHTS[1]
                 + c("total_crimes_max")) / (c("total_population") / 10000.0), 2).alias("crime_severity_score"),
    )
    s = global_stats(base, lo=F.min("crime_rate_per_100k"), hi=F.max("crime_rate_per_100k"),
                     sev=F.max("crime_severity_score"))
    scaled = base.withColumn("_s", s)
    span = F.when(c("_s.hi") > c("_s.lo"), c("_s.hi") - c("_s.lo")).otherwise(1.0)
    top = F.when(c("_s.sev") > 0, c("_s.sev")).otherwise(1.0)
    w1, w2, w3 = HOTSPOT_WEIGHTS
    return (
        scaled.withColumn("normalized_crime_index", F.round((c("crime_rate_per_100k") - c("_s.lo")) / span, 4))
        .withColumn("hotspot_score", F.round((w1 * c("normalized_crime_index") + w2 * (c("crime_severity_score") / top)
                                              + w3 * (1.0 - c("literacy_pct") / 100.0)) * 100.0, 2))
        .drop("_s")
    )


def min_max(df: DataFrame, col: str, out: str, digits: int = 4) -> DataFrame:
    """Scale to [0, 1]; a flat column has span 1."""
    s = global_stats(df, lo=F.min(col), hi=F.max(col))
    span = F.when(F.col("_s.hi") > F.col("_s.lo"), F.col("_s.hi") - F.col("_s.lo")).otherwise(1.0)
    return df.withColumn("_s", s).withColumn(out, F.round((F.col(col) - F.col("_s.lo")) / span, digits)).drop("_s")


def standardize(df: DataFrame, cols: list[str], prefix: str = "z_") -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    aggs = {f"m{i}": F.avg(F.col(c).cast("double")) for i, c in enumerate(cols)}
    aggs |= {f"d{i}": F.stddev_pop(F.col(c).cast("double")) for i, c in enumerate(cols)}
    # a deviation this small against the mean is rounding noise of a constant column
    def z(i: int, c: str) -> Column:
        m, d = F.col(f"_s.m{i}"), F.col(f"_s.d{i}")
        flat = d <= F.abs(m) * 1e-14
        return F.when(flat, 0.0).otherwise((F.col(c).cast("double") - m) / F.when(flat, 1.0).otherwise(d)).alias(prefix + c)

    return df.withColumn("_s", global_stats(df, **aggs)).select(
        *df.columns, *[z(i, c) for i, c in enumerate(cols)])
