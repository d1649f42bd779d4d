"""The library's input shapes, derived from the star-schema tables.

Everything here is integer or exactly rounded arithmetic over whole tables, so any SQL engine gives the same
values.  Regions come at two grains: nations (few, heavy groups) and customers (many, light groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MEASURES = ["m_urgent", "m_high", "m_medium", "m_unspecified", "m_low", "total_crimes"]
VIOLENT = ["m_urgent", "m_high"]
PROPERTY = ["m_medium", "m_unspecified"]
PRIORITIES = {"m_urgent": "1-URGENT", "m_high": "2-HIGH", "m_medium": "3-MEDIUM", "m_unspecified": "4-NOT SPECIFIED",
              "m_low": "5-LOW"}


class Tables:
    """The Parquet tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def population_columns(df: DataFrame) -> DataFrame:
    """Head counts of a customer, as census measures."""
    c = F.col
    return (
        df.withColumn("pop", F.floor(F.abs("c_acctbal")) + 100)
        .withColumn("male", F.expr("pop * (45 + c_custkey % 10) div 100"))
        .withColumn("female", c("pop") - c("male"))
        .withColumn("literate", F.expr("pop * (40 + c_custkey % 50) div 100"))
        .withColumn("households", F.expr("pop div 5 + 1"))
        .withColumn("workers", F.expr("pop * (30 + c_custkey % 30) div 100"))
        .withColumn("main_workers", F.expr("workers div 2"))
        .withColumn("non_workers", c("pop") - c("workers"))
    )


def census_rows(t: Tables) -> DataFrame:
    """Census-like rows by nation: level from the balance, area from the market segment.

    Every sixth nation has no block rows, which takes the fallback path of the profile.
    """
    c = F.col
    rows = population_columns(t.customer)
    return rows.select(
        c("c_nationkey").alias("region"),
        F.when((c("c_nationkey") % 6 == 0) | (c("c_acctbal") < 0), "DISTRICT").otherwise("CD BLOCK").alias("Level"),
        F.when(c("c_mktsegment") == "BUILDING", "Urban").when(c("c_mktsegment") == "FURNITURE", "Rural")
        .otherwise("Total").alias("Total/Rural/Urban"),
        c("pop").alias("Total Population Person"), c("male").alias("Total Population Male"),
        c("female").alias("Total Population Female"), c("literate").alias("Literates Population Person"),
        c("households").alias("No of Households"), c("workers").alias("Total Worker Population Person"),
        c("main_workers").alias("Main Working Population Person"), c("non_workers").alias("Non Working Population Person"),
    )


def customer_profiles(t: Tables) -> DataFrame:
    """One profile per customer (the fine grain)."""
    from ..operators.incidents import with_ratios

    c = F.col
    rows = population_columns(t.customer)
    return with_ratios(rows.select(
        c("c_custkey").alias("region"), c("pop").alias("total_population"), c("male").alias("male_population"),
        c("female").alias("female_population"), c("literate").alias("literate_population"), "households",
        c("workers").alias("total_workers"), "main_workers", "non_workers",
        F.expr("pop * (c_custkey % 100) div 100").alias("urban_population"),
        F.expr("pop - pop * (c_custkey % 100) div 100").alias("rural_population")))


def incident_rows(t: Tables, grain: str = "nation") -> DataFrame:
    """One row per order: region, year and one 0/1 measure per priority."""
    o = t.orders.select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    if grain == "nation":
        o = o.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    region = "c_nationkey" if grain == "nation" else "o_custkey"
    flags = [(F.col("o_orderpriority") == p).cast("double").alias(m) for m, p in PRIORITIES.items()]
    return o.select(F.col(region).alias("region"), "year", *flags, F.lit(1.0).alias("total_crimes"))


def incident_points(t: Tables) -> DataFrame:
    """Order locations scattered around their nation."""
    k, i = "c_nationkey", "o_orderkey"
    return t.orders.select(i, "o_custkey", "o_totalprice").join(
        t.customer.select("c_custkey", k), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col(i).alias("point_id"), F.col(k).alias("region"), F.col("o_totalprice").alias("severity"),
        F.expr(f"12.5 + ({k} % 5) * CAST(1.1 AS DOUBLE) + (({i} * 7919) % 97 - 48) * (({i} * 104729) % 89)"
               " / CAST(89.0 AS DOUBLE) / CAST(1000.0 AS DOUBLE)").alias("lat"),
        F.expr(f"74.5 + ({k} div 5) * CAST(0.8 AS DOUBLE) + (({i} * 15485863) % 97 - 48) * (({i} * 32452843) % 89)"
               " / CAST(89.0 AS DOUBLE) / CAST(1000.0 AS DOUBLE)").alias("lon"))


def base_points(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("base_id"), F.col("s_name").alias("base_name"),
        F.expr("12.5 + (s_nationkey % 5) * CAST(1.1 AS DOUBLE) + ((s_suppkey * 37) % 41 - 20) / CAST(1000.0 AS DOUBLE)").alias("base_lat"),
        F.expr("74.5 + (s_nationkey div 5) * CAST(0.8 AS DOUBLE) + ((s_suppkey * 53) % 41 - 20) / CAST(1000.0 AS DOUBLE)").alias("base_lon"))


def prediction_log(t: Tables) -> DataFrame:
    """One scored run per order; a customer's newest order is its latest prediction."""
    return t.orders.select(
        F.col("o_custkey").alias("region"), F.col("o_orderkey").alias("id"),
        (F.expr("o_orderkey * 7919 % 10001") / 100.0).alias("risk_score"),
        (F.expr("o_orderkey * 104729 % 10001") / 100.0).alias("hotspot_score"),
        F.col("o_totalprice").alias("crime_forecast"),
        (F.expr("o_orderkey * 15485863 % 10001") / 10000.0).alias("anomaly_score"))


def entity_nodes(t: Tables) -> DataFrame:
    """Customers and suppliers as nodes of one network; groups are balance bands."""
    def nodes(df: DataFrame, prefix: str, key: str, name: str, nation: str, bal: str) -> DataFrame:
        b = F.col(bal)
        return df.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"), F.col(name).alias("name"),
            F.when(b < 0, "Independent").when(b < 3000, "amber").when(b < 6000, "blue").otherwise("coral").alias("grp"),
            F.concat(F.lit("NATION_"), F.col(nation).cast("string")).alias("region"))
    return nodes(t.customer, "C", "c_custkey", "c_name", "c_nationkey", "c_acctbal").unionByName(
        nodes(t.supplier, "S", "s_suppkey", "s_name", "s_nationkey", "s_acctbal"))


def entity_edges(t: Tables) -> DataFrame:
    """Who bought from whom; the weight counts order lines."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(
        t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("weight")).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"), "weight")
