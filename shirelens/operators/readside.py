"""Read-side queries: list, detail document, latest prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .keys import select_by_name
from .pick import pick_row

LIST_COLUMNS = ["total_population", "male_population", "female_population", "literacy_rate", "urban_pct",
                "work_participation_rate"]
DEMOGRAPHICS = ["total_population", "male_population", "female_population", "literacy_rate", "sex_ratio", "urban_pct",
                "work_participation_rate"]
METRICS = ["population_density", "crime_severity_score", "normalized_crime_index", "hotspot_score"]
PREDICTIONS = ["risk_score", "hotspot_score", "crime_forecast", "anomaly_score"]


def list_regions(profiles: DataFrame, key: str = "region") -> DataFrame:
    return profiles.select(key, *LIST_COLUMNS)


def latest_per_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row per key.  A ranking window would sort whole keys; this aggregate sends one row per task and key."""
    return pick_row(log, [key], order, largest=True).select(key, *[c for c in log.columns if c != key])


def region_documents(profiles: DataFrame, history: DataFrame, features: DataFrame, predictions: DataFrame,
                     key: str = "region", history_columns: list[str] | None = None, prediction_order: str = "id",
                     year: str = "year") -> DataFrame:
    """One nested document per region.

    Every side becomes one row per key before it is joined.  ``history`` must be unique on (key, year), as
    ``yearly_statistics`` makes it, so an array holds one struct per year and no more.
    """
    cols = [year] + (history_columns or [c for c in history.columns if c not in (key, year)])
    hist = history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("history"))
    feat = features.select(key, F.struct(*METRICS).alias("feature_metrics"))
    pred = latest_per_key(predictions.select(key, prediction_order, *PREDICTIONS), key, prediction_order).select(
        key, F.struct(*PREDICTIONS).alias("predictions"))
    empty = F.array().cast(hist.schema["history"].dataType)
    return (
        profiles.select(key, F.struct(*DEMOGRAPHICS).alias("demographics"))
        .join(hist, key, "left").join(feat, key, "left").join(pred, key, "left")
        .withColumn("history", F.coalesce("history", empty))
    )


def region_detail(documents: DataFrame, name: str, key: str = "region") -> DataFrame:
    """The document of one region, matched without regard to case or padding."""
    return select_by_name(documents, key, name)
