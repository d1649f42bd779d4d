"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

#: Edges that a task contracts at once.
LOCAL_EDGES = 1 << 20
#: Edges for which ``_gathered`` plans a task.
TASK_EDGES = 1 << 18


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of the given ones: every node points at the smallest of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        ra, rb = root[a], root[b]
        np.minimum.at(root, ra, rb)
        np.minimum.at(root, rb, ra)
        while ((up := root[root]) != root).any():
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, held[0].schema.field(0).type) for x in _stars(
            *(np.concatenate([np.asarray(b.column(k)) for b in held]) for k in ("u", "v")))], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LOCAL_EDGES:
            yield stars()
            held = []
    if held:
        yield stars()


def _numbered(e: DataFrame) -> bool:
    """Whether tasks can contract these edges; edges of other keys are left to the rounds."""
    return not {t for _, t in e.dtypes} - {"bigint", "int"}


def _contracted(e: DataFrame) -> DataFrame:
    """The edges of each task replaced by stars with the same components, at most one edge per node there."""
    return e.mapInArrow(_contract, e.schema) if _numbered(e) else e


def _gathered(e: DataFrame) -> tuple[DataFrame, bool]:
    """Written edges that lie in many small files are contracted once more in tasks of about TASK_EDGES; also whether they are settled.

    A shuffle of few edges over many partitions leaves hardly two edges of a component in one task.  A larger input gets more
    of these tasks, not larger ones.
    """
    tasks = -(-e.count() // TASK_EDGES)
    if _numbered(e) and len(e.inputFiles()) > tasks > 0:
        e = materialize(_contracted(e.coalesce(tasks)), "gathered")
    return e, _is_star_forest(e)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node on an edge; the component is its smallest node.

    Large-star / small-star rounds (Kiveris et al. 2014): each round re-points edges at the smallest
    neighbour, which halves path lengths instead of walking them.  All steps are min-aggregates and
    equi-joins against one row per node, so a hub that holds a third of the edges is pre-aggregated before
    its shuffle and can be split by AQE in the join.  Before and after each round tasks contract the edges
    they hold by themselves, so rounds are only needed for what lies in different tasks.  Lineage is cut each round by a
    table in the shared folder.
    """
    hi, lo = F.greatest(src, dst), F.least(src, dst)
    e = edges.where(F.col(src) != F.col(dst)).select(hi.alias("u"), lo.alias("v")).distinct()
    e, settled = _gathered(materialize(_contracted(e), "edges"))
    for _ in range(max_rounds):
        if settled:
            break
        # large star: every larger neighbour of u goes to the smallest node around u
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = sym.where(F.col("v") > F.col("u")).join(root, F.col("u") == F.col("k")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(
            "u != v").unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        e, settled = _gathered(materialize(_contracted(small.distinct()), "stars"))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def _is_star_forest(e: DataFrame) -> bool:
    """Every node points at one smaller node at most, and no node that is pointed at points on."""
    roles = e.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    per_node = roles.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    return per_node.where((F.col("c") > 1) | ((F.col("c") == 1) & (F.col("p") == 1))).isEmpty()
