"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, numeric as N, scores as S
from ..operators import (allocation as al, features as feat, graph as gr, incidents as inc, isolation as iso, keys as K,
                         quality as qa, readside as rs, regression as rg, scoring as sc, spatial as sp)
from ..session import materialize, scratch_path
from ..sources import files as fl, tables as tb
from ..streaming import alerts as st
from . import shapes as sh
from .scoring_run import build_features, score_regions
from .shapes import Tables

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col


def query(fn: Callable[[Tables], DataFrame]):
    REGISTRY[fn.__name__] = lambda spark, directory: fn(Tables(spark, directory))
    return fn


# --- shared inputs -------------------------------------------------------------------------------------------

def _stats(t: Tables, grain: str = "nation") -> DataFrame:
    return inc.yearly_statistics(sh.incident_rows(t, grain), sh.MEASURES)


def _profiles(t: Tables) -> DataFrame:
    return inc.region_profile(sh.census_rows(t), "region")


def _features(t: Tables, grain: str = "nation") -> DataFrame:
    profiles = _profiles(t) if grain == "nation" else sh.customer_profiles(t)
    return build_features(profiles, sh.incident_rows(t, grain), sh.MEASURES, sh.VIOLENT, sh.PROPERTY)


def _cents_mean(amount: str):
    """Mean of a money column by exact integer sums, the same in whatever order rows arrive."""
    return F.sum(F.round(c(amount) * 100).cast("long")) / F.count(F.lit(1)) / 100.0


def _saved_features(t: Tables) -> DataFrame:
    """The feature store as a written table, for models that read it more than once."""
    return materialize(_features(t, "customer"), "features", balance=True)


def _raw_names(t: Tables) -> DataFrame:
    """Customers with their nation's name spelled three ways, and sometimes not at all."""
    n = t.nation.select("n_nationkey", "n_name")
    joined = t.customer.join(n, c("c_nationkey") == c("n_nationkey"))
    k = c("c_custkey")
    raw = F.when(k % 11 == 0, "  ").when(k % 3 == 0, F.lower("n_name")).when(
        k % 3 == 1, F.concat(F.lit("  "), "n_name", F.lit(" "))).otherwise(F.upper("n_name"))
    return joined.select("c_custkey", "c_nationkey", "c_acctbal", raw.alias("raw_name"))


def _aliases(t: Tables) -> DataFrame:
    """Even nations have a canonical name; several nations may share one."""
    return t.nation.where(c("n_nationkey") % 2 == 0).select(
        F.upper("n_name").alias("alias"), F.concat(F.lit("Land "), (c("n_nationkey") % 10).cast("string")).alias("canonical"))


def _predictions(t: Tables) -> DataFrame:
    return rs.latest_per_key(sh.prediction_log(t), "region", "id")


# --- sources and sinks -----------------------------------------------------------------------------------------

@query
def table_scan(t):
    return fl.read_table(t.spark, f"{t.directory}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


@query
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    df = t.customer
    fl.write_table(df, path, fmt="csv")
    return fl.read_table(t.spark, path, df.schema, fmt="csv")


@query
def json_round_trip(t):
    path = scratch_path(t.spark, "json")
    df = t.supplier
    fl.write_documents(df, path)
    return fl.read_documents(t.spark, path, df.schema)


@query
def read_many_units(t):
    """One folder of CSV files per nation, read in one scan with the file as unit key."""
    path = scratch_path(t.spark, "units")
    # rebalancing gathers each unit's rows and still splits a unit that is too large for one task
    fl.write_table(t.customer.hint("rebalance", "c_nationkey"), path, fmt="csv", partition_by=["c_nationkey"])
    rows = fl.read_many(t.spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING")
    unit = F.regexp_extract("unit_file", r"c_nationkey=(\d+)", 1).cast("int")
    return rows.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query
def distinct_keys(t):
    return fl.distinct_keys(t.orders, "o_custkey")


@query
def relational_table(t):
    t.orders.createOrReplaceTempView("shirelens_orders")
    return tb.read_relational(t.spark, "shirelens_orders").where(c("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")


@query
def insert_unseen(t):
    """Orders of customers that are not yet in the target table, one row per customer."""
    target = t.customer.where(c("c_acctbal") < 0).select(c("c_custkey").alias("region"))
    return tb.unseen_rows(sh.prediction_log(t).select("region", "id", "risk_score"), target, ["region"], c("id"))


@query
def insert_twice(t):
    """A table with some customers' rows; inserting the absent ones a second time adds nothing."""
    path = scratch_path(t.spark, "inserted")
    log = sh.prediction_log(t).select("region", "id", "risk_score")
    there = log.join(t.customer.where(c("c_acctbal") < 0).select(c("c_custkey").alias("region")), "region", "left_semi")
    fl.write_table(tb.keep_first(there, ["region"], -c("id")), path)
    for _ in range(2):
        tb.insert_if_absent(log, path, ["region"], c("id"))
    return t.spark.read.parquet(path)


@query
def append_runs(t):
    """Two appended runs of the same predictions stay apart by run id."""
    path = scratch_path(t.spark, "runs")
    for run, day in (("run-1", 1), ("run-2", 2)):
        tb.append_run(sh.prediction_log(t), path, run, datetime(2024, 1, day))
    runs = t.spark.read.parquet(path)
    return runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.date_format("created_at", "yyyy-MM-dd")).alias("loaded"))


@query
def snapshot_counts(t):
    """Materialise read-side queries once and report what each holds."""
    path = scratch_path(t.spark, "snapshot")
    pred = _predictions(t)
    frames = {"hotspots": sc.top_k(pred, 50), "regions": rs.list_regions(_profiles(t)),
              "trend": inc.yearly_trend(_stats(t), ["total_crimes"])}
    tb.build_snapshot(frames, path, fmt="parquet")
    out = [t.spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in frames]
    return qa.stack_reports(out)


# --- quality -----------------------------------------------------------------------------------------------------

@query
def quality_profile(t):
    names = ["customer", "orders", "lineitem", "documents", "events", "labels"]
    return qa.stack_reports([qa.profile(getattr(t, n), n) for n in names])


@query
def duplicate_profile(t):
    """Columns that repeat often, with missing and infinite numbers."""
    v = F.when(c("l_discount") == 0, F.lit(float("inf"))).when(c("l_tax") == 0, F.lit(float("nan"))).otherwise(c("l_discount"))
    return qa.profile(t.lineitem.select("l_suppkey", "l_returnflag", v.alias("v")), "lines")


@query
def infinity_count(t):
    v = F.when(c("o_orderstatus") == "F", F.lit(float("-inf"))).otherwise(c("o_totalprice"))
    return t.orders.select("o_orderstatus", v.alias("v")).agg(qa.infinity_count(t.orders.select(v.alias("v"))).alias("infinite"))


@query
def dataset_status(t):
    empty = t.orders.where(c("o_totalprice") < 0)
    return qa.overall_status(qa.stack_reports([qa.profile(t.customer, "customer"), qa.profile(empty, "empty"),
                                               qa.failed_report(t.spark, "absent", "File missing or zero bytes")]))


@query
def key_consistency(t):
    return qa.key_consistency(t.customer.select(c("c_custkey").alias("k")), t.orders.select((c("o_custkey") + 7).alias("k")), "k")


@query
def key_consistency_summary(t):
    return qa.consistency_summary(key_consistency(t))


@query
def key_sets(t):
    return qa.key_sets(t.customer.select(c("c_custkey").alias("k")), t.orders.select((c("o_custkey") + 7).alias("k")), "k")


@query
def duplicate_keys(t):
    return qa.duplicate_key_count(t.lineitem, ["l_partkey", "l_suppkey"])


@query
def keep_first_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return tb.keep_first(rows, ["o_custkey"], c("o_orderkey"))


@query
def distinct_rows(t):
    return qa.drop_duplicate_rows(t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus"))


@query
def load_reconciliation(t):
    """Counts taken while the rows pass from the source to the cleaned table: one scan."""
    rows, loaded = qa.observed(t.orders.select("o_custkey", "o_orderkey"), "loaded")
    kept, cleaned = qa.observed(tb.keep_first(rows, ["o_custkey"], c("o_orderkey")), "cleaned")
    materialize(kept, "cleaned")
    n, m = loaded.get["rows"], cleaned.get["rows"]
    return t.spark.createDataFrame([(n, m, n - m)], "rows_loaded long, rows_cleaned long, rows_removed long")


# --- scalars -----------------------------------------------------------------------------------------------------

@query
def canonical_names(t):
    named = K.canonical_key(_raw_names(t), "raw_name", _aliases(t), out="region")
    return named.select("c_custkey", "region")


@query
def select_by_name(t):
    return K.select_by_name(_raw_names(t), "raw_name", " Nation_3 ").select("c_custkey", "raw_name")


def _number_texts(t: Tables) -> DataFrame:
    k = c("c_custkey").cast("string")
    v = c("c_custkey") % 8
    text = (F.when(v == 0, k).when(v == 1, F.concat(k, F.lit(".5"))).when(v == 2, F.concat(F.lit("-"), k))
            .when(v == 3, F.concat(k, F.lit("e3"))).when(v == 4, F.concat(F.lit(" "), k)).when(v == 5, F.concat(F.lit("."), k))
            .when(v == 6, F.concat(k, F.lit("."))).otherwise(F.lit("")))
    return t.customer.select("c_custkey", text.alias("txt"), c("c_mktsegment"))


@query
def parse_numbers(t):
    return _number_texts(t).select("c_custkey", "txt", F.round(N.to_number_or_zero(c("txt")), 6).alias("number"))


@query
def tail_sums(t):
    k = c("c_custkey")
    cells = [c("txt"), c("c_mktsegment"), k.cast("string"), F.lit(None).cast("string"), (k % 7).cast("string")]
    return _number_texts(t).select("c_custkey", F.round(N.tail_sum(cells), 6).alias("tail_sum"))


@query
def null_defaults(t):
    v = F.when(c("o_orderstatus") == "O", F.lit(None).cast("double")).when(
        c("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(c("o_totalprice"))
    return t.orders.select("o_orderkey", N.or_default(N.nan_to_null(v), 0.0).alias("filled"))


@query
def guarded_ratios(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", N.guarded_ratio(c("l_quantity"), c("l_discount"), 1.0, 4).alias("ratio"),
                             N.clip(c("l_quantity") / 100.0, 0.05, 0.4).alias("clipped"))


@query
def points_in_box(t):
    p = sh.incident_points(t)
    return p.where(geo.within_bounds(c("lat"), c("lon"), (12.5, 15.9, 74.5, 77.0))).select("point_id", "region")


@query
def great_circle_distance(t):
    p = sh.incident_points(t)
    return p.select("point_id", F.round(geo.haversine_km(c("lat"), c("lon"), F.lit(14.7), F.lit(76.1)), 6).alias("km"))


@query
def risk_bands(t):
    return sh.prediction_log(t).select("id", S.band(c("risk_score")).alias("band"), S.band(c("risk_score"), False).alias("level"))


@query
def band_counts(t):
    return sc.count_by_band(sh.prediction_log(t))


@query
def alert_rows(t):
    return sc.alerts(_predictions(t))


@query
def marker_attributes(t):
    p = sh.prediction_log(t).withColumn("band", S.band(c("risk_score")))
    return p.select("id", F.round(S.marker_radius(c("risk_score")), 6).alias("radius"), S.band_color(c("band")).alias("color"))


def _requests(t: Tables) -> DataFrame:
    k = c("c_custkey")

    def some(every: int, v):
        return F.when(k % every != 0, v)
    return t.customer.select(
        k.alias("region"), some(7, (k * 7919 % 60000) / 100.0).alias("crime_rate_per_100k"),
        some(5, (k * 104729 % 10000) / 100.0).alias("literacy_pct"),
        some(3, (k * 15485863 % 6000) / 100.0 - 20.0).alias("crime_growth_rate"),
        some(4, (k * 32452843 % 15000) / 100.0).alias("crime_severity_score"))


@query
def heuristic_scores(t):
    return sc.heuristic_score(_requests(t)).select("region", "hotspot_score", "crime_forecast", "anomaly_score", "risk_score", "risk_level")


@query
def numbered_rows(t):
    return K.sequential_ids(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], "seq").select(
        "o_orderkey", "seq")


# --- joins -------------------------------------------------------------------------------------------------------

def _summary(t: Tables, grain: str = "customer") -> DataFrame:
    return inc.region_summary(_stats(t, grain), sh.VIOLENT, sh.PROPERTY)


@query
def profile_join(t):
    j = feat.join_summary(sh.customer_profiles(t), _summary(t), "region")
    return j.select("region", "total_population", "literacy_rate", "total_crimes_latest", "crime_growth")


@query
def profile_left_join(t):
    j = feat.join_summary(sh.customer_profiles(t), _summary(t), "region", how="left")
    return j.select("region", "total_population", "total_crimes_latest", "total_crimes_mean", "crime_growth")


@query
def population_lookup(t):
    pops = sh.customer_profiles(t).where(c("total_population") >= 1000).select("region", c("total_population").cast("double").alias("population"))
    s = K.lookup_or_default(_stats(t, "customer"), "region", pops, "population", 1000000.0)
    return inc.with_rate(s).select("region", "year", "population", "population_imputed", "crime_rate_per_100k")


def _centroids(t: Tables) -> DataFrame:
    k = c("n_nationkey")
    return t.nation.where(k % 4 != 3).select(F.lower("n_name").alias("name"), (12.5 + k % 5).alias("lat"), (74.5 + F.expr("n_nationkey div 5")).alias("lon"))


@query
def centroid_lookup(t):
    return K.attach_by_name(_raw_names(t), "raw_name", _centroids(t), "name", ["lat", "lon"], "inner").select(
        "c_custkey", c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon"))


@query
def unplaced_names(t):
    return K.unmatched_names(_raw_names(t), "raw_name", _centroids(t), "name")


@query
def deployment_overlay(t):
    units = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("units"))
    return K.attach_by_name(_raw_names(t), "raw_name", units, "n_name", ["units"]).select("c_custkey", "units")


@query
def indicator_overlay(t):
    """External indicators per canonical name joined to incident totals."""
    named = K.canonical_key(_raw_names(t), "raw_name", _aliases(t), out="region")
    totals = t.orders.join(named, c("o_custkey") == c("c_custkey")).groupBy("region").agg(F.count(F.lit(1)).alias("incidents"))
    ind = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select(c("n_name").alias("raw"), "s_acctbal")
    ind = K.canonical_key(ind, "raw", _aliases(t), out="region").groupBy("region").agg(
        F.count(F.lit(1)).alias("stations"), _cents_mean("s_acctbal").alias("indicator"))
    return totals.join(ind, "region", "left")


@query
def distance_pairs(t):
    p = sp.distance_join(sh.incident_points(t), sh.base_points(t), 3.0, ("point_id", "lat", "lon"), ("base_id", "base_lat", "base_lon"))
    return p.select("point_id", "base_id", F.round("distance_km", 6).alias("km"))


@query
def region_documents(t):
    docs = rs.region_documents(sh.customer_profiles(t), _stats(t, "customer"), _features(t, "customer"), sh.prediction_log(t),
                               history_columns=["total_crimes", "m_urgent"])
    years = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["year"].cast("string"), h["total_crimes"].cast("int").cast("string"))), ";")
    return docs.select("region", c("demographics.literacy_rate").alias("literacy_rate"), years.alias("history"),
                       c("feature_metrics.hotspot_score").alias("feature_hotspot"), c("predictions.risk_score").alias("risk_score"))


@query
def region_detail(t):
    docs = rs.region_documents(_profiles(t).withColumn("region", c("region").cast("string")),
                               _stats(t).withColumn("region", c("region").cast("string")),
                               _features(t).withColumn("region", c("region").cast("string")),
                               sh.prediction_log(t).withColumn("region", (c("region") % 25).cast("string")))
    one = rs.region_detail(docs, " 7 ")
    return one.select("region", F.explode("history").alias("h"), c("predictions.risk_score").alias("risk_score")).select(
        "region", "risk_score", c("h.year").alias("year"), c("h.total_crimes").alias("total_crimes"))


@query
def list_regions(t):
    return rs.list_regions(_profiles(t))


# --- aggregates, windows, sorts ------------------------------------------------------------------------------------

@query
def region_profiles(t):
    return _profiles(t)


@query
def yearly_statistics(t):
    return inc.drop_regions(_stats(t), "region", [24])


@query
def customer_yearly_statistics(t):
    return _stats(t, "customer")


@query
def region_summary(t):
    return _summary(t, "customer")


@query
def yearly_trend(t):
    return inc.yearly_trend(_stats(t), sh.MEASURES)


@query
def scaled_prices(t):
    return feat.min_max(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "scaled")


@query
def standardized_lines(t):
    z = feat.standardize(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return z.select("l_orderkey", "l_linenumber", F.round("z_l_quantity", 6).alias("z_qty"), F.round("z_l_extendedprice", 6).alias("z_price"))


@query
def composite_indices(t):
    return _features(t, "customer")


@query
def nation_indices(t):
    return _features(t)


@query
def top_hotspots(t):
    return sc.top_k(_features(t).withColumn("risk_score", c("hotspot_score")), 10).select("region", "hotspot_score", "crime_rate_per_100k", "crime_severity_score")


@query
def latest_predictions(t):
    return _predictions(t)


@query
def ranked_predictions(t):
    p = sh.prediction_log(t)
    return p.select("id", "risk_score", "hotspot_score").orderBy(F.desc("risk_score"), "id")


@query
def top_predictions(t):
    return sc.top_k(sh.prediction_log(t), 50, key="id").select("id", "region", "risk_score", "hotspot_score")


@query
def region_counts(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).agg(
        F.count_distinct("c_nationkey").alias("regions"), F.count_distinct("o_custkey").alias("customers"))


@query
def stacked_layouts(t):
    """Two row layouts in one ragged string table: by column name and by position."""
    k = c("c_custkey")
    s = lambda e: e.cast("string")
    first = k % 2 == 0
    region = F.concat(F.lit("R"), s(c("c_nationkey")))
    num = lambda m: s(k % m)
    raw = t.customer.select(
        F.when(k % 29 == 0, "ZZ TOTAL").when(first, region).otherwise(s(2016 + k % 7)).alias("DISTRICT"),
        F.when(first, "2013").otherwise("Stateland").alias("YEAR"), F.when(first, num(5)).alias("ALPHA"), F.when(first, num(7)).alias("BETA"),
        F.when(first & (k % 4 == 0), num(11)).alias("TOTAL"), F.when(~first, F.when(k % 31 == 0, "Total").otherwise(region)).alias("NAME"),
        F.when(~first, num(13)).alias("P6"), F.when(~first, F.when(k % 5 == 1, "n/a").otherwise(num(17))).alias("P7"),
        F.when(~first, F.concat(num(19), F.lit(".5"))).alias("P8"))
    parsed = inc.parse_stacked(raw, {"ALPHA": "alpha", "BETA": "beta", "TOTAL": "total_crimes"}, 2013, "Stateland", ["alpha", "beta"],
                               ["ZZ TOTAL", "Total"])
    return inc.yearly_statistics(parsed, ["alpha", "beta", "total_crimes"])


# --- scoring -------------------------------------------------------------------------------------------------------

def _scored(t: Tables) -> DataFrame:
    f = _saved_features(t).withColumn("crime_forecast", S.growth_forecast(c("crime_rate_per_100k"), c("crime_growth_rate")))
    odd = _predictions(t).select("region", "anomaly_score")
    return sc.blended_risk(f.join(odd, "region"))


@query
def blended_risk(t):
    return _scored(t).select("region", "crime_forecast", "risk_score")


@query
def run_summary(t):
    p = materialize(_scored(t), "scored").withColumn("is_anomaly", (c("anomaly_score") > 0.85).cast("int")).withColumn("current_crime_rate_per_100k", c("crime_rate_per_100k"))
    top = F.array_join(F.transform("top_high_risk", lambda r: r["region"].cast("string")), ",")
    return sc.run_summary(p).withColumn("top_high_risk", top)


@query
def anomaly_regions(t):
    """Nine standardised features, contamination 0.15."""
    z = materialize(feat.standardize(_saved_features(t), feat.FEATURE_COLUMNS), "scaled", balance=True)
    cols = [f"z_{f}" for f in feat.FEATURE_COLUMNS]
    return iso.isolation_forest(z, "region", cols, 0.15).select("region", "anomaly_score", "is_anomaly")


def _order_cells(t: Tables) -> DataFrame:
    """Incident points folded to 0.01-degree cells."""
    p = sh.incident_points(t)
    return p.groupBy(F.floor(c("lat") * 100).alias("i"), F.floor(c("lon") * 100).alias("j")).agg(
        F.count(F.lit(1)).alias("crime_count"),
        _cents_mean("severity").alias("severity_mean")).select(
        (c("i") * 100000 + c("j")).alias("cell"), "crime_count", "severity_mean",
        ((c("i") + 0.5) / 100.0).alias("lat_center"), ((c("j") + 0.5) / 100.0).alias("lon_center"))


CELL_FEATURES = ["crime_count", "severity_mean", "lat_center", "lon_center"]


@query
def anomaly_cells(t):
    """Four raw features of grid cells, contamination 0.05."""
    return iso.isolation_forest(materialize(_order_cells(t), "cells", balance=True), "cell", CELL_FEATURES, 0.05).select("cell", "raw_score", "is_anomaly")


@query
def isolation_tree_nodes(t):
    nodes = iso.fit(_order_cells(t), "cell", CELL_FEATURES, n_trees=100, sample=256)
    return nodes.select("tree", "node", "feature", F.round("split", 6).alias("split"), "size")


@query
def contamination_threshold(t):
    share = t.lineitem.select(F.round(c("l_extendedprice") / 200000.0, 6).alias("v"))
    return iso.contamination_threshold(share, "v", 0.15).select(F.round("threshold", 6).alias("threshold"))


@query
def feature_clusters(t):
    z = feat.standardize(_saved_features(t), feat.FEATURE_COLUMNS)
    return sp.dbscan_features(z, "region", [f"z_{f}" for f in feat.FEATURE_COLUMNS], 1.5).withColumnRenamed("region", "id")


@query
def point_clusters(t):
    return sp.dbscan_geo(sh.incident_points(t), "point_id")


def _centers(t: Tables) -> DataFrame:
    p = sh.incident_points(t)
    return sp.cluster_centers(p, sp.dbscan_geo(p, "point_id"), "point_id")


@query
def cluster_centers(t):
    return _centers(t).select("cluster_id", "region", F.round("center_lat", 6).alias("center_lat"),
                              F.round("center_lon", 6).alias("center_lon"), "size", "risk_score")


@query
def cluster_risk_by_region(t):
    return sp.risk_by_region(_centers(t))


@query
def center_cells(t):
    """Cells of the cluster centres with their mean severity instead of a random one."""
    p = sh.incident_points(t)
    labels = sp.dbscan_geo(p, "point_id")
    severity = p.join(labels, "point_id").groupBy("cluster_id").agg(_cents_mean("severity").alias("severity_mean"))
    cells = sp.grid_cells(sp.cluster_centers(p, labels, "point_id").join(severity, "cluster_id"))
    return cells.select("cell_id", "region", "crime_count", "severity_mean")


FOREST = dict(n_trees=100, max_depth=30)
FOREST_INPUTS = [f for f in feat.FEATURE_COLUMNS if f not in ("crime_rate_per_100k", "normalized_crime_index")]


@query
def forest_predictions(t):
    f = _saved_features(t)
    model = rg.fit_forest(f, FOREST_INPUTS, "crime_rate_per_100k", **FOREST)
    p = rg.predict(model, f, FOREST_INPUTS)
    span = p.agg(F.struct(F.min("crime_rate_per_100k").alias("lo"), F.max("crime_rate_per_100k").alias("hi"))).scalar()
    return p.withColumn("s", span).select("region", "crime_rate_per_100k", F.coalesce(
        c("prediction").between(c("s.lo") - 1e-9, c("s.hi") + 1e-9), F.lit(False)).alias("within_range"))


def _explained(t: Tables) -> DataFrame:
    f = _saved_features(t)
    model = rg.fit_forest(f, FOREST_INPUTS, "crime_rate_per_100k", **FOREST)
    return materialize(rg.explain_rows(model, f, "region", FOREST_INPUTS, labels=S.FEATURE_LABELS, digits=9), "explained")


@query
def explained_regions(t):
    """Whether every explanation adds up to its prediction, is sorted by size, and has its texts."""
    e = _explained(t)
    sizes = F.transform("contributions", lambda x: F.abs(x["shap_value"]))
    total = F.aggregate("contributions", c("base_value"), lambda acc, x: acc + x["shap_value"])
    signs = lambda op: F.least(F.lit(3), F.size(F.filter("contributions", op)))
    texts = signs(lambda x: x["shap_value"] > 0) + signs(lambda x: x["shap_value"] < 0)
    return e.select("region", F.size("contributions").alias("contributions"), (F.abs(total - c("model_output")) < 1e-6).alias("adds_up"),
                    (sizes == F.reverse(F.array_sort(sizes))).alias("sorted"), (F.size("plain_english") == texts).alias("texts_fit"),
                    F.forall("contributions", lambda x: x["label"].isNotNull() & x["shap_value"].isNotNull()).alias("complete"))


@query
def global_importance(t):
    """Per feature: how many explanations hold it, and whether its importance is the mean size of its contributions over all regions."""
    rows = materialize(rg.contribution_rows(_explained(t), "region"), "contributions")
    own = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("regions"), F.sum(F.abs("shap_value")).alias("whole"))
    ranked = rg.global_importance(rows).join(own, "feature")
    return ranked.select("feature", "label", "regions", (F.abs(c("mean_abs_shap") - c("whole") / c("regions")) <= 6e-5).alias("is_mean"))


@query
def scoring_run(t):
    """Features to scored regions; the risk is compared with its formula over the emitted forecast."""
    f = _saved_features(t)
    r = materialize(score_regions(f, **FOREST), "scored").join(f.select("region", "normalized_crime_index"), "region")
    top = r.agg(F.max("crime_forecast").alias("m")).scalar()
    risk = F.round((0.5 * (c("crime_forecast") / F.when(c("top") > 0, c("top")).otherwise(1.0)) + 0.35 * c("normalized_crime_index")
                    + 0.15 * c("anomaly_score")) * 100.0, 2)
    return r.withColumn("top", top).select("region", "cluster_id", "current_crime_rate_per_100k", "anomaly_score", "is_anomaly",
                                           (F.abs(risk - c("risk_score")) <= 0.011).alias("risk_fits"))


# --- allocation ----------------------------------------------------------------------------------------------------

def _spots(t: Tables) -> DataFrame:
    """Risk per 0.01-degree cell."""
    return _order_cells(t).select(c("lat_center").alias("center_lat"), c("lon_center").alias("center_lon"),
                                  (c("crime_count") * 1.25).alias("risk_score"))


@query
def coverage_plan(t):
    plan, _ = al.max_coverage(_spots(t), sh.base_points(t), 10, 3.0)
    return plan.select("units", "base_id", c("gain").cast("double").alias("gain"), c("covered").cast("double").alias("covered"), "covered_spots")


@query
def coverage_metrics(t):
    _, m = al.max_coverage(_spots(t), sh.base_points(t), 5, 3.0)
    return m.select("radius", "units", "covered_pct", "uncovered_count", "total_spots", "units_used", "upper_bound_pct")


@query
def coverage_grid(t):
    """All 300 scenarios of 1..30 units and 1..10 km."""
    g = al.coverage_grid(_spots(t), sh.base_points(t), list(range(1, 31)), [float(r) for r in range(1, 11)])
    return g.select("radius", "units", "covered_pct", "uncovered_count")


@query
def plan_summary(t):
    _, m = al.max_coverage(_spots(t), sh.base_points(t), 10, 3.0)
    return al.plan_summary(m, 10)


@query
def unit_assignments(t):
    bases = sh.base_points(t)
    plan, _ = al.max_coverage(_spots(t), bases, 5, 3.0)
    return al.assignments(plan, bases)


# --- network -------------------------------------------------------------------------------------------------------

@query
def entity_degree(t):
    return gr.degree(sh.entity_edges(t))


@query
def top_connected(t):
    return gr.top_connected(gr.degree(sh.entity_edges(t)))


@query
def subgraph_nodes(t):
    nodes, _ = gr.subgraph(sh.entity_nodes(t), sh.entity_edges(t), " nation_3")
    return nodes


@query
def subgraph_edges(t):
    w = c("weight") % 3
    kinds = sh.entity_edges(t).withColumn("kind", F.when(w == 0, "same_gang").when(w == 1, "associate").otherwise("other"))
    _, edges = gr.subgraph(sh.entity_nodes(t), kinds, "NATION_3 ")
    return edges.withColumn("width", F.round("width", 6))


@query
def subgraph_summary(t):
    return gr.subgraph_summary(sh.entity_nodes(t), sh.entity_edges(t), "nation_3")


@query
def entity_groups(t):
    return gr.groups_of(sh.entity_nodes(t))


@query
def edge_endpoints(t):
    return gr.with_endpoints(sh.entity_edges(t), sh.entity_nodes(t))


@query
def pair_affinity(t):
    return gr.pair_affinity(sh.entity_edges(t), sh.entity_nodes(t)).select("src", "dst", "affinity")


@query
def weighted_pair_sample(t):
    return gr.weighted_pair_sample(pair_affinity(t), 70).select("src", "dst", "affinity")


# --- time ----------------------------------------------------------------------------------------------------------

@query
def hourly_surge(t):
    counts = inc.window_counts(t.events.withColumn("ts", c("ts").cast("timestamp")), "event_type", "ts", "1 hour")
    return inc.surge(counts.drop("window_end"), "event_type", "window_start", "n", 6)


@query
def window_alerts(t):
    counts = inc.window_counts(t.events.withColumn("ts", c("ts").cast("timestamp")), "event_type", "ts", "1 hour", "value")
    return st.window_alerts(counts, "event_type", 3.0)


def _closed(t: Tables, value: str | None = None) -> DataFrame:
    stream = st.event_stream(t.spark, t.directory, t.events.schema, glob="events.parquet")
    return st.closed_windows(stream, "event_type", "ts", "1 hour", "10 minutes", value)


@query
def stream_closed_windows(t):
    path = scratch_path(t.spark, "stream")
    windows = _closed(t)
    st.start_window_sink(windows, f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.schema(windows.schema).parquet(f"{path}/out").drop("window_end")


@query
def stream_alerts(t):
    path = scratch_path(t.spark, "stream-alerts")
    st.start_alert_sink(_closed(t, "value"), "event_type", 3.0, f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").drop("batch")


@query
def stream_surge(t):
    path = scratch_path(t.spark, "stream-surge")
    st.start_surge_sink(_closed(t), "event_type", 6, f"{path}/counts", f"{path}/surge", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/surge").drop("batch", "window_end")
