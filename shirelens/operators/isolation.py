"""Isolation forest (Liu, Ting and Zhou 2008) with md5 randomness.

Fitting groups a bounded sample by tree; scoring passes each row once by the fitted node table.  Every random choice is an md5 of (seed, tree, node), so a fit is reproducible anywhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import hash_int
from .features import global_stats

SCORE_DIGITS = 6


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


#: A row is offered to a tree when its hash falls below this many times the sample's share, so that far more than ``sample`` rows are.
OFFER = 8


def training_sample(df: DataFrame, id_col: str, cols: list[str], n_trees: int, sample: int, seed: int) -> DataFrame:
    """``(tree, id, x)``: per tree the ``sample`` rows of smallest hash, out of all rows.

    Each row finds the trees whose hash of it is small enough to matter before it is multiplied, so about ``OFFER * sample`` rows per tree are
    shuffled whatever the table's size, and the smallest hashes are among them.  A row with a NULL feature takes no part in fitting.
    """
    x = F.array(*[F.col(c).cast("double") for c in cols])
    whole = df.where(~F.exists(x, lambda v: v.isNull()))
    n = whole.agg(F.count(F.lit(1)).alias("n")).scalar()
    draw = lambda tree: hash_int(F.lit(seed), tree, F.col("id"))
    rows = whole.select(F.col(id_col).alias("id"), x.alias("x"), n.alias("n"))
    offered = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) / F.lit(4294967296.0) * F.col("n") < float(OFFER * sample))
    trees = rows.select("id", "x", F.explode(offered).alias("tree"))
    ranked = trees.withColumn("_r", F.row_number().over(W.partitionBy("tree").orderBy(draw(F.col("tree")), "id")))
    return ranked.where(F.col("_r") <= sample).select("tree", "id", "x")


NODE_SCHEMA = "tree int, node long, feature int, split double, size long"


def _draw(*parts) -> int:
    """The Python twin of ``hash_int``."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def grow_tree(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of one tree over its sample; root is 1, children 2i and 2i+1, leaves have no feature."""
    limit = math.ceil(math.log2(max(len(x), 1)))
    out, level = [], [(1, np.arange(len(x)))]
    for depth in range(limit + 1):
        below = []
        for node, rows in level:
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            varied = np.flatnonzero(hi > lo)
            if depth == limit or len(varied) == 0:
                out.append((tree, node, None, None, len(rows)))
                continue
            f = int(varied[_draw(seed, "f", tree, node) % len(varied)])
            u = (_draw(seed, "s", tree, node) + 0.5) / 4294967296.0
            split = float(lo[f] + u * (hi[f] - lo[f]))
            left = x[rows, f] < split
            out.append((tree, node, f, split, len(rows)))
            below += [(child, part) for child, part in ((2 * node, rows[left]), (2 * node + 1, rows[~left])) if len(part)]
        level = below
    return out


def fit(df: DataFrame, id_col: str, cols: list[str], n_trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Node table ``(tree, node, feature, split, size)``.  One shuffle by tree; a group is one sample."""
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = grow_tree(int(rows["tree"].iloc[0]), np.array(rows["x"].tolist(), dtype=float), seed)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "size"]).astype({"feature": "Int32"})

    return training_sample(df, id_col, cols, n_trees, sample, seed).groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def score(df: DataFrame, nodes: DataFrame, cols: list[str], digits: int = SCORE_DIGITS, out: str = "score") -> DataFrame:
    """Add the isolation score (higher is more anomalous).

    The node table is bounded by trees x 2 x sample rows, which is why it may travel with the function.  A NULL feature goes left
    at every split on it; without a model all scores are NULL.
    """
    model = nodes.toPandas().sort_values(["tree", "node"])
    if model.empty:  # nothing was there to learn from
        return df.withColumn(out, F.lit(None).cast("double"))
    n_trees = int(model["tree"].nunique())
    width = int(model["node"].max()) + 1
    tree_no = pd.factorize(model["tree"], sort=True)[0]
    at = (tree_no, model["node"].to_numpy())
    feature = np.full((n_trees, width), -1, dtype=np.int16)
    split = np.zeros((n_trees, width))
    length = np.zeros((n_trees, width))
    feature[at] = model["feature"].fillna(-1).astype(int)
    split[at] = model["split"].fillna(0.0)
    depth_of = np.floor(np.log2(model["node"].to_numpy())).astype(int)
    length[at] = depth_of + np.array([average_path(int(s)) for s in model["size"]])
    levels, norm = int(depth_of.max()), average_path(int(model.loc[model["node"] == 1, "size"].iloc[0]))

    @F.pandas_udf("double")
    def path_length(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total, pick = np.zeros(len(x)), np.arange(len(x))
            for t in range(n_trees):
                node = np.ones(len(x), dtype=np.int64)
                for _ in range(levels):
                    f = feature[t][node]
                    go = f >= 0
                    right = x[pick, np.where(go, f, 0)] >= split[t][node]
                    node = np.where(go, node * 2 + right, node)
                total += length[t][node]
            yield pd.Series(total / n_trees)

    mean = path_length(*[F.col(c).cast("double") for c in cols])
    return df.withColumn("_h", mean).withColumn(out, F.round(F.pow(F.lit(2.0), -F.col("_h") / F.lit(norm)), digits)).drop("_h")


def contamination_threshold(df: DataFrame, value: str, share: float) -> DataFrame:
    """Interpolated percentile of a rounded value in [0, 1].

    Equal values are counted first; with six digits at most a million rows reach the final aggregate, however
    many rows were scored.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.percentile(value, share, F.col("_n")).alias("threshold"))


def isolation_forest(df: DataFrame, id_col: str, cols: list[str], contamination: float, n_trees: int = 100,
                     sample: int = 256, seed: int = 42) -> DataFrame:
    """Adds ``raw_score`` (higher is odder), ``is_anomaly`` and ``anomaly_score`` scaled to [0, 1].

    ``df`` is read twice, to fit and to score.  The flag marks rows whose negated score falls below its ``contamination`` percentile.
    """
    from ..session import materialize

    scored = materialize(score(df, fit(df, id_col, cols, n_trees, sample, seed), cols, out="raw_score"), "isolation")
    plain = scored.withColumn("_d", -F.col("raw_score"))
    t = contamination_threshold(plain, "_d", contamination).scalar()
    s = global_stats(plain, lo=F.min("_d"), hi=F.max("_d"))
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    return (
        plain.withColumn("_s", s).withColumn("_t", t)
        .withColumn("anomaly_score", F.round(1.0 - (F.col("_d") - lo) / (hi - lo + 1e-6), 4))
        .withColumn("is_anomaly", (F.col("_d") < F.col("_t")).cast("int")).drop("_d", "_s", "_t")
    )
