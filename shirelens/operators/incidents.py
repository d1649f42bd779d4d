"""Census profiles and yearly incident statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import guarded_ratio, nan_to_null, tail_sum, to_number_or_zero, total
from .keys import canonical_key

# Census measure -> profile column.
CENSUS_SUMS = {
    "Total Population Person": "total_population",
    "Total Population Male": "male_population",
    "Total Population Female": "female_population",
    "Literates Population Person": "literate_population",
    "No of Households": "households",
    "Total Worker Population Person": "total_workers",
    "Main Working Population Person": "main_workers",
    "Non Working Population Person": "non_workers",
}


def with_ratios(df: DataFrame) -> DataFrame:
    """The five guarded ratios of a profile."""
    c = F.col
    return (
        df.withColumn("literacy_rate", guarded_ratio(c("literate_population"), c("total_population"), 100.0))
        .withColumn("sex_ratio", guarded_ratio(c("female_population"), c("male_population"), 1000.0))
        .withColumn("female_ratio", guarded_ratio(c("female_population"), c("total_population"), 1.0, 4))
        .withColumn("urban_pct", guarded_ratio(c("urban_population"), c("total_population"), 100.0))
        .withColumn("work_participation_rate", guarded_ratio(c("total_workers"), c("total_population"), 100.0))
    )


def region_profile(census: DataFrame, unit: str, level: str = "Level", area: str = "Total/Rural/Urban",
                   block: str = "CD BLOCK", sums: dict[str, str] = CENSUS_SUMS) -> DataFrame:
    """Profile per unit from block rows, in one aggregate.

    Each sum is kept twice, over block rows and over all levels; whether the unit has a block *Total* row
    then decides which set is used.  So the per-unit fallback needs no window and combines on the map side.
    """
    in_block = F.col(level) == block
    slices = {"Total": F.col(area) == "Total", "Urban": F.col(area) == "Urban", "Rural": F.col(area) == "Rural"}
    wanted = {out: (src, "Total") for src, out in sums.items() if src in census.columns}
    person = next(src for src, out in sums.items() if out == "total_population")
    wanted["urban_population"] = (person, "Urban")
    wanted["rural_population"] = (person, "Rural")

    def s(cond: Column, src: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(f"`{src}`"))), F.lit(0)).cast("long")

    aggs = [F.max(in_block & slices["Total"]).alias("_has_block")]
    for out, (src, sl) in wanted.items():
        aggs += [s(in_block & slices[sl], src).alias(f"_b_{out}"), s(slices[sl], src).alias(f"_a_{out}")]
    rows = census.groupBy(unit).agg(*aggs)
    chosen = [F.when(F.col("_has_block"), F.col(f"_b_{o}")).otherwise(F.col(f"_a_{o}")).alias(o) for o in wanted]
    absent = [F.lit(0).cast("long").alias(o) for o in sums.values() if o not in wanted]
    return with_ratios(rows.select(unit, *chosen, *absent).where(F.col("total_population") > 0))


def parse_stacked(raw: DataFrame, named: dict[str, str], first_year: int, state: str,
                  positional: list[str], drop_keys: list[str], grand_total: str = "total_crimes",
                  fallback_sum: list[str] | None = None, aliases: DataFrame | None = None,
                  pseudo_regions: list[str] | None = None) -> DataFrame:
    """Union of the two layouts stacked in one ragged file read as strings.

    Layout 1 (``first_year`` in the second column) takes its measures by column *name*; layout 2 (``state`` in
    the second column) by *position* from the seventh column on, its total being the row-wise tail sum.  A missing
    total in layout 1 becomes the sum of ``fallback_sum``.  With ``aliases`` the regions get their canonical names, and those of
    ``pseudo_regions`` are left out afterwards.  NaN counts as nothing, and a padded number of layout 2 is none.
    """
    cols = [F.col(f"`{c}`") for c in raw.columns]
    c0, c1 = F.trim(cols[0]), F.trim(cols[1])
    measures = [m for m in named.values() if m != grand_total]

    by_name = {m: F.coalesce(nan_to_null(F.col(f"`{src}`").try_cast("double")), F.lit(0.0)) if src in raw.columns else F.lit(0.0)
               for src, m in named.items()}
    partial = total([by_name[m] for m in fallback_sum or measures])
    layout1 = raw.where((c1 == str(first_year)) & c0.isNotNull() & ~c0.isin(*drop_keys)).select(
        c0.alias("region"), F.lit(first_year).alias("year"), *[by_name[m].alias(m) for m in measures],
        F.when(by_name[grand_total] > 0, by_name[grand_total]).otherwise(partial).alias(grand_total))

    region = F.trim(cols[5])
    layout2 = raw.where((c1 == state) & c0.rlike(r"^[0-9]+$") & region.isNotNull() & ~region.isin(*drop_keys)).select(
        region.alias("region"), c0.cast("int").alias("year"),
        *[(to_number_or_zero(cols[6 + positional.index(m)]) if m in positional else F.lit(0.0)).alias(m)
          for m in measures],
        tail_sum(cols[6:]).alias(grand_total))
    both = layout1.unionByName(layout2)
    if aliases is not None:
        both = canonical_key(both, "region", aliases)
    return drop_regions(both, "region", pseudo_regions) if pseudo_regions else both


def yearly_statistics(incidents: DataFrame, measures: list[str], region: str = "region", year: str = "year") -> DataFrame:
    """Sum every measure by region and year, merging jurisdictions that share a canonical name."""
    return incidents.groupBy(region, year).agg(*[F.sum(m).alias(m) for m in measures])


def drop_regions(df: DataFrame, region: str, names: list[str]) -> DataFrame:
    return df.where(~F.col(region).isin(*names))


def with_rate(stats: DataFrame, total_col: str = "total_crimes", population: str = "population") -> DataFrame:
    return stats.withColumn("crime_rate_per_100k", guarded_ratio(F.col(total_col), F.col(population), 100000.0))


def region_summary(stats: DataFrame, violent: list[str], property_: list[str], region: str = "region",
                   year: str = "year", total_col: str = "total_crimes") -> DataFrame:
    """Mean, latest, maximum, violent and property sums and first-to-last growth per region, in one aggregate."""
    t = F.col(total_col)
    first, last = F.min_by(t, F.col(year)), F.max_by(t, F.col(year))
    return stats.groupBy(region).agg(
        F.round(F.avg(t), 2).alias("total_crimes_mean"),
        last.alias("total_crimes_latest"),
        F.max(t).alias("total_crimes_max"),
        total([F.sum(c) for c in violent]).alias("violent_crimes_sum"),
        total([F.sum(c) for c in property_]).alias("property_crimes_sum"),
        F.when(first > 0, F.round((last - first) / first * 100.0, 2)).otherwise(0.0).alias("crime_growth"),
    )


def yearly_trend(stats: DataFrame, measures: list[str], year: str = "year") -> DataFrame:
    """Totals by year, ascending; the number of years rides along on each row."""
    sums = [F.coalesce(F.sum(m), F.lit(0)).cast("double").alias(m) for m in measures]
    per_year = stats.groupBy(year).agg(*sums)
    n = per_year.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_year.withColumn("years_count", n).orderBy(year)


def surge(counts: DataFrame, key: str, bucket: str, n: str, trailing: int) -> DataFrame:
    """Ratio of each bucket's count to the mean of the ``trailing`` buckets before it, per key.

    The window sees counts per (key, bucket), never events, so a key's partition grows with time only.
    """
    w = W.partitionBy(key).orderBy(bucket).rowsBetween(-trailing, -1)
    base = F.avg(n).over(w)
    return counts.withColumn("trailing_mean", F.round(base, 4)).withColumn(
        "surge_ratio", F.when(base > 0, F.round(F.col(n) / base, 4)))


def window_counts(events: DataFrame, key: str, ts: str, width: str, value: str | None = None) -> DataFrame:
    """Tumbling-window counts per key; the same code serves batch and stream."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.max(value).alias("peak"))
    return events.groupBy(F.window(ts, width).alias("w"), F.col(key)).agg(*aggs).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in ("n", "peak")
                                                                                         if c == "n" or value])
