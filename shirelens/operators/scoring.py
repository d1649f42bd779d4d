"""Risk blending, alerts and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scores as S
from .features import global_stats

# Weights of forecast, index and anomaly in the blended risk.
RISK_WEIGHTS = (0.50, 0.35, 0.15)


def blended_risk(df: DataFrame, forecast: str = "crime_forecast", index: str = "normalized_crime_index",
                 anomaly: str = "anomaly_score", out: str = "risk_score") -> DataFrame:
    top = global_stats(df, hi=F.max(forecast))
    w1, w2, w3 = RISK_WEIGHTS
    hi = F.when(F.col("_s.hi") > 0, F.col("_s.hi")).otherwise(1.0)
    risk = F.round((w1 * (F.col(forecast) / hi) + w2 * F.col(index) + w3 * F.col(anomaly)) * 100.0, 2)
    return df.withColumn("_s", top).withColumn(out, risk).drop("_s")


def heuristic_score(requests: DataFrame, defaults: dict[str, float] = S.REQUEST_DEFAULTS) -> DataFrame:
    """Closed-form scores for a table of requests, with the service risk level."""
    c = F.col
    return requests.withColumns(
        S.heuristic_scores(c("crime_rate_per_100k"), c("literacy_pct"), c("crime_growth_rate"), c("crime_severity_score"),
                           defaults)
    ).withColumn("risk_level", S.band(c("risk_score"), inclusive=False))


def alerts(pred: DataFrame, key: str = "region", keep: list[str] | None = None) -> DataFrame:
    """Alert rows for high risk, else for high anomaly; other rows give none."""
    risk, anomaly = F.col("risk_score"), F.coalesce(F.col("anomaly_score"), F.lit(0.0))
    return pred.select(
        key, *(keep or []), S.alert_type(risk, anomaly).alias("alert_type"), S.alert_severity(risk, anomaly).alias("severity"),
        S.alert_message(F.col(key).cast("string"), risk, anomaly, F.col("crime_forecast")).alias("message"),
    ).where(F.col("alert_type").isNotNull())


def count_by_band(df: DataFrame, score: str = "risk_score") -> DataFrame:
    return df.groupBy(S.band(F.col(score)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, k: int = 10, key: str = "region", by: tuple[str, ...] = ("risk_score", "hotspot_score")) -> DataFrame:
    """The k riskiest rows (k from 1 to 50), ties broken by key."""
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    return df.orderBy(*[F.desc(c) for c in by], F.asc(key)).limit(k)


def run_summary(pred: DataFrame, key: str = "region") -> DataFrame:
    """Counts, mean rate, extremes and the five riskiest regions of a scoring run."""
    c = F.col
    head = pred.agg(
        F.count(F.lit(1)).alias("total_regions"),
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("total_anomalies"),
        F.round(F.avg("current_crime_rate_per_100k"), 2).alias("avg_rate"),
        F.min_by(key, F.struct(-c("risk_score"), c(key))).alias("highest_risk_region"),
        F.max_by(key, F.struct(-c("risk_score"), c(key))).alias("lowest_risk_region"),
    )
    # at most five rows reach this aggregate
    top = pred.orderBy(F.desc("risk_score"), key).limit(5).agg(
        F.array_sort(F.collect_list(F.struct((-c("risk_score")).alias("order"), c(key).alias("region"),
                                             "risk_score", "crime_forecast"))).alias("t"))
    picked = top.select(F.transform("t", lambda s: F.struct(s["region"].alias("region"), s["risk_score"].alias("risk_score"),
                                                            s["crime_forecast"].alias("crime_forecast")))).scalar()
    return head.withColumn("top_high_risk", picked)
