"""Bands, alert rules, closed-form scores and display attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import clip, or_default

# Band edges and names, alert thresholds.
BAND_EDGES = (75.0, 50.0, 25.0)
ALERT_RISK, ALERT_CRITICAL, ALERT_ANOMALY = 65.0, 80.0, 0.70
# Colours of bands, relations and groups.
BAND_COLORS = {"critical": "darkred", "high": "red", "medium": "orange", "low": "green"}
LINK_COLORS = {"same_gang": "#ff4d6d", "associate": "#ffd166", "shared_mo": "#4cc9f0"}
DEFAULT_LINK_COLOR = "#94a3b8"
GROUP_PALETTE = ["#00f2fe", "#f72585", "#7209b7", "#3a0ca3", "#4361ee",
                 "#4cc9f0", "#80ed99", "#ffd166", "#ff7b00", "#ff4d6d"]
NO_GROUP_COLOR = "#64748b"

# Defaults of a scoring request.
REQUEST_DEFAULTS = {
    "total_population": 1000000.0,
    "crime_rate_per_100k": 150.0,
    "literacy_pct": 75.0,
    "urban_pct": 30.0,
    "crime_growth_rate": 2.0,
    "crime_severity_score": 45.0,
}
# Labels of features in explanations.
FEATURE_LABELS = {
    "population_density": "Population Density",
    "crime_rate_per_100k": "Crime Rate / 100k",
    "literacy_pct": "Literacy %",
    "female_ratio": "Female Ratio",
    "urban_pct": "Urban %",
    "crime_growth_rate": "Crime Growth Rate",
    "economic_activity_index": "Economic Activity Index",
    "crime_severity_score": "Crime Severity Score",
    "normalized_crime_index": "Normalized Crime Index",
}


def band(score: Column, inclusive: bool = True) -> Column:
    """Map bands take their lower edge (``>=``); service levels do not (``>``) and are upper case."""
    names = ["critical", "high", "medium", "low"]
    if not inclusive:
        names = [n.upper() for n in names]
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(BAND_EDGES, names))):
        out = F.when(score >= edge if inclusive else score > edge, name).otherwise(out)
    return out


def band_color(band_name: Column) -> Column:
    return _lookup(band_name, BAND_COLORS, "green")


def marker_radius(risk: Column) -> Column:
    return 6 + risk / 100.0 * 22


def node_size(degree: Column) -> Column:
    return 12 + F.least(degree, F.lit(12)) * 2


def link_width(weight: Column) -> Column:
    return 1 + weight * 0.6


def link_color(kind: Column) -> Column:
    return _lookup(kind, LINK_COLORS, DEFAULT_LINK_COLOR)


def group_color(group_ordinal: Column) -> Column:
    """Palette colour by 0-based ordinal of the group, wrapping around; grey without a group."""
    palette = F.array(*[F.lit(c) for c in GROUP_PALETTE])
    return F.coalesce(F.get(palette, (group_ordinal % len(GROUP_PALETTE)).cast("int")), F.lit(NO_GROUP_COLOR))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def alert_type(risk: Column, anomaly: Column) -> Column:
    return F.when(risk > ALERT_RISK, "CRIME_HOTSPOT").when(anomaly > ALERT_ANOMALY, "ANOMALY_DETECTED")


def alert_severity(risk: Column, anomaly: Column) -> Column:
    return (
        F.when(risk > ALERT_RISK, F.when(risk < ALERT_CRITICAL, "HIGH").otherwise("CRITICAL"))
        .when(anomaly > ALERT_ANOMALY, "HIGH")
    )


def alert_message(region: Column, risk: Column, anomaly: Column, forecast: Column) -> Column:
    return F.when(
        risk > ALERT_RISK,
        F.format_string("High crime risk detected in %s (Risk Score: %s, Forecast: %s).",
                        region, risk.cast("string"), forecast.cast("string")),
    ).when(
        anomaly > ALERT_ANOMALY,
        F.format_string("Statistical crime anomaly detected in %s (Anomaly Score: %s).", region, anomaly.cast("string")),
    )


def growth_forecast(prediction: Column, growth_pct: Column) -> Column:
    return F.round(prediction * (1.0 + clip(growth_pct / 100.0, -0.2, 0.5)), 2)


def heuristic_scores(rate: Column, literacy: Column, growth: Column, severity: Column,
                     defaults: dict[str, float] = REQUEST_DEFAULTS) -> dict[str, Column]:
    """Closed-form scorer for requests that have no fitted model; every field has a default."""
    d = defaults
    rate, literacy = or_default(rate, d["crime_rate_per_100k"]), or_default(literacy, d["literacy_pct"])
    growth, severity = or_default(growth, d["crime_growth_rate"]), or_default(severity, d["crime_severity_score"])
    n_rate, n_sev = clip(rate / 400.0, 0.0, 1.0), clip(severity / 100.0, 0.0, 1.0)
    unlit = F.greatest(F.lit(0.0), 1.0 - literacy / 100.0)
    forecast = F.round(rate * (1.0 + growth / 100.0), 2)
    anomaly = F.round(clip((rate - 150.0) / 300.0 + growth / 50.0, 0.0, 1.0), 4)
    return {
        "hotspot_score": F.round((0.45 * n_rate + 0.35 * n_sev + 0.20 * unlit) * 100.0, 2),
        "crime_forecast": forecast,
        "anomaly_score": anomaly,
        "risk_score": clip(F.round((0.50 * (forecast / 300.0) + 0.35 * n_rate + 0.15 * anomaly) * 100.0, 2), 0.0, 100.0),
    }
