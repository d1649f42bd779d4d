import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from shirelens.functions import geo, numeric as N, scores as S, text as X
from shirelens.operators import features as feat, incidents as inc, keys as K, quality as qa, scoring as sc


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("v")).first()[0]


@pytest.mark.parametrize("text,number", [("12", 12.0), ("1.5", 1.5), (".5", 0.5), ("5.", 5.0), ("-3", 0.0), ("1e3", 0.0),
                                         (" 12 ", 0.0), ("", 0.0), ("n/a", 0.0), (None, 0.0), ("1.2.3", 0.0)])
def test_lenient_numbers(spark, text, number):
    assert one(spark, N.to_number_or_zero(F.lit(text).cast("string"))) == number


def test_guarded_ratio_and_clip(spark):
    assert one(spark, N.guarded_ratio(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, N.guarded_ratio(F.lit(1), F.lit(8), 1.0, 2)) == 0.13
    assert one(spark, N.clip(F.lit(0.9), -0.2, 0.5)) == 0.5


@pytest.mark.parametrize("raw,name", [("hubballi-dharwad k.g.f.", "Hubballi-Dharwad K.G.F."), ("NATION_7", "Nation_7"),
                                      ("o'neil", "O'Neil"), ("", "")])
def test_title_case(spark, raw, name):
    assert one(spark, X.title_case(F.lit(raw))) == name == raw.title()


def test_canonical_key(spark):
    aliases = spark.createDataFrame([("OLD CITY", "Newcity"), ("NEWCITY COMMR.", "Newcity"), ("H.I.J.", "Hill")], "alias string, canonical string")
    df = spark.createDataFrame([("  old city ",), ("Newcity Commr.",), ("H.I.J.",), ("  ",), (None,), ("new-town",)], "d string")
    got = rows(K.canonical_key(df, "d", aliases, out="c").select("c"))
    assert [r[0] for r in got] == ["Newcity", "Newcity", "Hill", "Unknown", "Unknown", "New-Town"]


@pytest.mark.parametrize("score,low,high", [(75.0, "critical", "HIGH"), (75.01, "critical", "CRITICAL"), (50.0, "high", "MEDIUM"),
                                            (25.0, "medium", "LOW"), (24.99, "low", "LOW")])
def test_band_borders(spark, score, low, high):
    assert one(spark, S.band(F.lit(score))) == low
    assert one(spark, S.band(F.lit(score), inclusive=False)) == high


def test_alert_borders(spark):
    df = spark.createDataFrame([("a", 65.0, 0.70, 1.0), ("b", 65.01, 0.9, 2.0), ("c", 80.0, 0.0, 3.0), ("d", 10.0, 0.71, 4.0)],
                               "region string, risk_score double, anomaly_score double, crime_forecast double")
    got = {r[0]: r[1:3] for r in rows(sc.alerts(df))}
    assert got == {"b": ("CRIME_HOTSPOT", "HIGH"), "c": ("CRIME_HOTSPOT", "CRITICAL"), "d": ("ANOMALY_DETECTED", "HIGH")}


def test_known_distance(spark):
    assert 6 < one(spark, geo.haversine_km(F.lit(12.9716), F.lit(77.5946), F.lit(13.0358), F.lit(77.5970))) < 9
    half = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert abs(half - math.pi * geo.EARTH_RADIUS_KM) < 1e-6


@pytest.mark.parametrize("center", [(0.0, 0.0), (12.9, 77.6), (60.0, 179.999), (-45.0, -180.0), (89.99, 10.0), (-90.0, 0.0)])
def test_grid_reaches_every_neighbour(spark, center):
    """No point within the radius may lie in a cell that is not listed, at poles and the date line too."""
    rng = np.random.default_rng(1)
    radius, side = 5.0, geo.tight_side(5.0)
    pts = []
    for _ in range(400):
        ang, turn = rng.uniform(0, 1.02 * radius / geo.EARTH_RADIUS_KM), rng.uniform(0, 2 * math.pi)
        p, q = math.radians(center[0]), math.radians(center[1])
        p2 = math.asin(max(-1, min(1, math.sin(p) * math.cos(ang) + math.cos(p) * math.sin(ang) * math.cos(turn))))
        q2 = q + math.atan2(math.sin(turn) * math.sin(ang) * math.cos(p), math.cos(ang) - math.sin(p) * math.sin(p2))
        pts.append((math.degrees(p2), (math.degrees(q2) + 540) % 360 - 180))
    df = spark.createDataFrame(pts, "lat double, lon double")
    la, lo = F.lit(center[0]), F.lit(center[1])
    seen = df.select(geo.haversine_km(la, lo, F.col("lat"), F.col("lon")).alias("d"),
                     F.array_contains(geo.reach_cells(la, la, lo, lo, radius, side), geo.cell_id(F.col("lat"), F.col("lon"), side)).alias("in"))
    assert seen.where((F.col("d") <= radius) & ~F.col("in")).count() == 0


def test_cells_are_tight(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(70, 70.02, 600), rng.uniform(20, 20.05, 600)))]
    df = spark.createDataFrame(pts, "i int, lat double, lon double").withColumn("c", geo.cell_id(F.col("lat"), F.col("lon"), geo.tight_side(0.5)))
    b = df.select(F.col("lat").alias("la"), F.col("lon").alias("lo"), "c")
    assert df.join(b, "c").select(F.max(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")))).first()[0] <= 0.5


def test_heuristic_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None)], "crime_rate_per_100k double, literacy_pct double, crime_growth_rate double, crime_severity_score double")
    r = sc.heuristic_score(df).first()
    assert (r.crime_forecast, r.anomaly_score, r.hotspot_score, r.risk_level) == (153.0, 0.04, 37.63, "MEDIUM")
    assert sc.heuristic_score(df, {**S.REQUEST_DEFAULTS, "urban_pct": 35.0, "crime_growth_rate": 2.5}).first().crime_forecast == 153.75


def test_profile_counts_nan_null_inf_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, 1.0)], "a int, b double")
    r = qa.profile(df, "t").first()
    assert (r.n_rows, r.n_columns, r.missing_values, r.duplicate_rows, r.invalid_numeric_values) == (6, 2, 3, 1, 2)
    assert qa.profile(df.where("a > 9"), "t").first().status == "FAILED"


def test_column_names_and_requirements(spark):
    df = spark.createDataFrame([(1, 2)], "` Total-Pop (k) ` int, b int")
    assert qa.clean_columns(df).columns == ["total_pop_k", "b"]
    with pytest.raises(ValueError, match="district"):
        qa.require_columns(df, ["district"])


def test_observed_counts_without_a_second_pass(spark):
    df, obs = qa.observed(spark.range(7), "load", top=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 7, "top": 6}


def test_profile_falls_back_without_block_rows(spark):
    cols = ["u", "Level", "Total/Rural/Urban", "Total Population Person", "Total Population Male", "Total Population Female",
            "Literates Population Person", "No of Households"]
    data = [("A", "CD BLOCK", "Total", 100, 40, 60, 50, 20), ("A", "DISTRICT", "Total", 900, 1, 1, 1, 1), ("A", "CD BLOCK", "Urban", 30, 0, 0, 0, 0),
            ("B", "DISTRICT", "Total", 10, 5, 5, 5, 2), ("B", "CD BLOCK", "Rural", 7, 0, 0, 0, 0), ("C", "CD BLOCK", "Total", 0, 0, 0, 0, 0)]
    got = {r.u: r for r in inc.region_profile(spark.createDataFrame(data, cols), "u").collect()}
    assert set(got) == {"A", "B"}  # no population, no profile
    assert (got["A"].total_population, got["A"].urban_population, got["A"].sex_ratio, got["A"].literacy_rate) == (100, 30, 1500.0, 50.0)
    assert (got["B"].total_population, got["B"].rural_population, got["B"].total_workers) == (10, 7, 0)


def test_stacked_file(spark):
    cols = ["DISTRICT", "YEAR", "ALPHA", "BETA", "GAMMA", "P5", "DELTA", "P7"]
    named = {"DELTA": "delta", "ALPHA": "alpha", "BETA": "beta", "GAMMA": "gamma", "ALL": "total_crimes"}
    data = [("Ash", "2013", "1", "2", "3", None, "4", None), ("ZZ TOTAL", "2013", "9", "9", "9", None, "9", None),
            ("2016", "Stateland", None, None, None, "Ash", "5", "6.5"), ("2016", "Stateland", None, None, None, "Total", "5", "6"),
            ("2017", "Stateland", None, None, None, "Ash Town", " 5 ", "6"), ("Ash", "2013", "NaN", "1", None, None, None, None),
            ("Trains", "2013", "1", "1", "1", None, "1", None)]
    df = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in cols))
    args = (df, named, 2013, "Stateland", ["delta", "alpha"], ["ZZ TOTAL", "Total"])
    got = inc.parse_stacked(*args).where("region <> 'Trains'").select("region", "year", "delta", "alpha", "total_crimes")
    assert sorted(rows(got)) == [("Ash", 2013, 0.0, 0.0, 1.0), ("Ash", 2013, 4.0, 1.0, 10.0), ("Ash", 2016, 5.0, 6.5, 11.5),
                                 ("Ash Town", 2017, 0.0, 6.0, 6.0)]  # a padded number is no number, a NaN counts nothing
    aliases = spark.createDataFrame([("ASH TOWN", "Ash"), ("TRAINS", "Railway")], "alias string, canonical string")
    clean = inc.parse_stacked(*args, aliases=aliases, pseudo_regions=["Railway", "Unknown"])
    assert {(r.region, r.year) for r in clean.collect()} == {("Ash", 2013), ("Ash", 2016), ("Ash", 2017)}


def test_growth_is_zero_from_nothing(spark):
    df = spark.createDataFrame([("a", 2013, 0.0), ("a", 2014, 5.0), ("b", 2013, 4.0), ("b", 2014, 5.0)], "region string, year int, total_crimes double")
    got = {r.region: r.crime_growth for r in inc.region_summary(df, ["total_crimes"], ["total_crimes"]).collect()}
    assert got == {"a": 0.0, "b": 25.0}


def test_flat_columns(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.1)], "i int, v double")
    assert {r[0] for r in feat.min_max(df, "v", "s").select("s").collect()} == {0.0}
    assert {r[0] for r in feat.standardize(df, ["v"]).select("z_v").collect()} == {0.0}


def test_numbering_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(v, str(v)) for v in (5, 3, 9, 1, 7, 7)], "a int, b string").repartition(4)
    got = rows(K.sequential_ids(df, ["a"], "s").orderBy("s").select("a", "s"))
    assert [g[1] for g in got] == list(range(6)) and [g[0] for g in got] == sorted(g[0] for g in got)
    assert K.sequential_ids(df.where("a > 99"), ["a"], "s").count() == 0
