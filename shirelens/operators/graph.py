"""Entity network: degree, induced sub-graphs, pair affinity, weighted sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scores as S
from ..functions.numeric import hash_unit
from .keys import select_by_name, sequential_ids

NO_GROUP = "Independent"


class UnknownRegionError(ValueError):
    """No node lies in the region."""


def degree(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("links"))


def top_connected(degrees: DataFrame, k: int = 5) -> DataFrame:
    """Most linked entities; ties go to the smaller id."""
    return degrees.orderBy(F.desc("links"), "node_id").limit(k)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the node subset."""
    ids = nodes.select("node_id")
    return (edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"))


def region_nodes(nodes: DataFrame, region: str | None, check: bool = False) -> DataFrame:
    if region is None:
        return nodes
    out = select_by_name(nodes, "region", region)
    if check and out.isEmpty():
        raise UnknownRegionError(region)
    return out


def subgraph(nodes: DataFrame, edges: DataFrame, region: str | None = None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes of a region with their degree in the *full* graph, and the edges among them, with display attributes."""
    kept = region_nodes(nodes, region, check)
    groups = kept.select("grp").where(F.col("grp").isNotNull()).distinct()
    ordinal = sequential_ids(groups, ["grp"], "_ord")
    ids = kept.select("node_id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).join(ids, "node_id", "left_semi")  # degrees of kept nodes only
    links = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("links"))
    shown = (kept.join(links, "node_id", "left").join(ordinal, "grp", "left")
             .withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
             .withColumn("size", S.node_size(F.col("links"))).withColumn("color", S.group_color(F.col("_ord"))).drop("_ord"))
    inner = induced_edges(edges, kept).withColumn("width", S.link_width(F.col("weight")))
    if "kind" in edges.columns:
        inner = inner.withColumn("color", S.link_color(F.col("kind")))
    return shown.select(*nodes.columns, "links", "size", "color"), inner


def subgraph_summary(nodes: DataFrame, edges: DataFrame, region: str | None = None) -> DataFrame:
    """Node, edge and group counts of the sub-graph."""
    kept = region_nodes(nodes, region)
    n_edges = induced_edges(edges, kept).agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct("grp").alias("group_count")).withColumn(
        "edge_count", n_edges)


def groups_of(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("grp").isNotNull()).select("grp").distinct().orderBy("grp")


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Group and region of both ends, and whether they share a real group."""
    def end(prefix: str) -> DataFrame:
        return nodes.select(F.col("node_id").alias(prefix), F.col("grp").alias(f"{prefix}_grp"), F.col("region").alias(f"{prefix}_region"))
    same = (F.col("src_grp") == F.col("dst_grp")) & (F.col("src_grp") != NO_GROUP)
    return edges.join(end("src"), "src").join(end("dst"), "dst").withColumn("same_group", F.coalesce(same, F.lit(False)))


def pair_affinity(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """1, plus 4 for a shared real group, plus 2 for a shared region.

    Scores the pairs of an explicit table; all pairs of a group are never formed.
    """
    both = with_endpoints(pairs, nodes)
    score = 1.0 + F.when(F.col("same_group"), 4.0).otherwise(0.0) + F.when(
        F.col("src_region") == F.col("dst_region"), 2.0).otherwise(0.0)
    return both.withColumn("affinity", score)


def weighted_pair_sample(pairs: DataFrame, n: int, weight: str = "affinity", seed: int = 42) -> DataFrame:
    """``n`` distinct pairs drawn with probability proportional to weight, without replacement.

    Exponential keys (Efraimidis and Spirakis 2006) turn the sequential draw into a top-n.
    """
    key = -F.log(hash_unit(F.lit(seed), F.col("src"), F.col("dst"))) / F.col(weight)
    return pairs.withColumn("draw_key", key).orderBy("draw_key", "src", "dst").limit(n)
