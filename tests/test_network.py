import pytest
from pyspark.sql import functions as F

from shirelens.operators import graph as gr

NODES = [("a", "red", "North"), ("b", "red", " north "), ("c", "Independent", "South"), ("d", "Independent", "South"), ("e", None, "North")]
EDGES = [("a", "b", 2), ("b", "c", 1), ("c", "d", 3)]


@pytest.fixture
def net(spark):
    return spark.createDataFrame(NODES, "node_id string, grp string, region string"), spark.createDataFrame(EDGES, "src string, dst string, weight long")


def test_subgraph_keeps_full_degrees(net):
    nodes, edges = gr.subgraph(*net, "NORTH")
    got = {r.node_id: (r.links, r["size"], r.color) for r in nodes.collect()}
    assert got == {"a": (1, 14, "#00f2fe"), "b": (2, 16, "#00f2fe"), "e": (0, 12, "#64748b")}
    assert [(r.src, r.dst, round(r.width, 6)) for r in edges.collect()] == [("a", "b", 2.2)]
    s = gr.subgraph_summary(*net, "north").first()
    assert (s.node_count, s.group_count, s.edge_count) == (3, 1, 1)


def test_unknown_region(net):
    with pytest.raises(gr.UnknownRegionError):
        gr.subgraph(*net, "West")


def test_whole_graph_and_top(net):
    nodes, edges = gr.subgraph(*net)
    assert nodes.count() == 5 and edges.count() == 3
    assert [tuple(r) for r in gr.top_connected(gr.degree(net[1]), 2).collect()] == [("b", 2), ("c", 2)]
    assert [r.grp for r in gr.groups_of(net[0]).collect()] == ["Independent", "red"]


def test_affinity(net):
    nodes, edges = net
    got = {(r.src, r.dst): r.affinity for r in gr.pair_affinity(edges, nodes.withColumn("region", F.lower(F.trim("region")))).collect()}
    assert got == {("a", "b"): 7.0, ("b", "c"): 1.0, ("c", "d"): 3.0}


def test_weighted_sample_prefers_heavy_pairs_and_is_repeatable(spark):
    pairs = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("src"), F.lit("q").alias("dst"),
                                     F.when(F.col("id") < 1000, 5.0).otherwise(1.0).alias("affinity"))
    one = gr.weighted_pair_sample(pairs, 300).collect()
    assert one == gr.weighted_pair_sample(pairs.repartition(5), 300).collect()
    heavy = sum(r.affinity == 5.0 for r in one)
    assert len({r.src for r in one}) == 300 and 225 < heavy < 275  # 5 to 1, so about 250
    assert gr.weighted_pair_sample(pairs, 5000).count() == 2000
