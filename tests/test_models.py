import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shirelens.operators import features as feat, isolation as iso, regression as rg
from shirelens.plans.scoring_run import score_regions


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (160, 3))
    y = 10 * (x[:, 0] > 0) + 5 * x[:, 1] + rng.normal(0, 0.1, 160)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, y double")
    return df


@pytest.fixture(scope="module")
def forest(table):
    return rg.fit_forest(table, ["a", "b", "c"], "y", n_trees=4, max_depth=4)


def test_contributions_add_up(table, forest):
    got = rg.explain_rows(forest, table, "k", ["a", "b", "c"], digits=9)
    gap = got.select(F.max(F.abs(F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["shap_value"]) - F.col("model_output"))))
    assert gap.first()[0] < 1e-6
    first = got.first()
    size = [abs(c.shap_value) for c in first.contributions]
    assert len(size) == 3 and size == sorted(size, reverse=True)
    assert all(t.split(" (")[0] in "abc" for t in first.plain_english)
    importance = rg.global_importance(rg.contribution_rows(got, "k")).collect()
    assert {r.feature for r in importance[:2]} == {"a", "b"} and importance[2].feature == "c"


def test_shapley_equals_enumeration(spark, table, forest, monkeypatch):
    """Against the definition: the value of a coalition follows known splits and averages unknown ones by cover."""
    nodes = rg.node_table(forest, spark).toPandas()
    trees = [{r.id: r for r in t.itertuples()} for _, t in nodes.groupby("tree")]

    def value(tree, node, x, known):
        n = tree[node]
        if n.left < 0:
            return n.prediction
        if n.feature in known:
            return value(tree, n.left if x[n.feature] <= n.threshold else n.right, x, known)
        return sum(tree[c].cover / n.cover * value(tree, c, x, known) for c in (n.left, n.right))

    x = np.array(table.orderBy("k").select("a", "b", "c").limit(5).collect())
    per_tree = [{k: t[k].to_numpy() for k in t.columns} for _, t in nodes.groupby("tree")]
    monkeypatch.setattr(rg, "CELLS", 64)
    fast = sum(rg.shapley_of(x, rg.leaf_paths(t)) for t in per_tree) / len(trees)
    monkeypatch.setattr(rg, "TABLE_FEATURES", 1)
    assert np.allclose(fast, sum(rg.shapley_of(x, rg.leaf_paths(t)) for t in per_tree) / len(trees))
    for row, got in zip(x, fast):
        for j in range(3):
            rest = [i for i in range(3) if i != j]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * np.mean([value(t, 0, row, {*s, j}) - value(t, 0, row, set(s)) for t in trees])
                       for n in range(3) for s in itertools.combinations(rest, n))
            assert abs(want - got[j]) < 1e-9


def test_codes_of_outcomes_give_the_same_shapley_values(monkeypatch):
    """All rows of a block go through a tree at once; as leaf by leaf, also for NaN, and for more features than a code holds."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (300, 5)), rng.normal(0, 1, 300)
    nodes = {k: np.array(v) for k, v in zip(rg.NODE_NAMES, zip(*rg.grow_tree(x, y + 3 * x[:, 0] * x[:, 3], 12)))}
    rows = np.concatenate([x, rng.normal(0, 2, (5000, 5))])
    rows[::9, 2] = np.nan
    want = rg.shapley_of(rows, rg.leaf_paths(nodes))
    assert np.abs(want).max() > 0.1 and np.allclose(rg.shapley_of_tree(rows, nodes), want, atol=1e-10)
    monkeypatch.setattr(rg, "CODE_FEATURES", 4)
    assert np.allclose(rg.shapley_of_tree(rows, nodes), want, atol=1e-10)
    single = {k: np.array([v]) for k, v in zip(rg.NODE_NAMES, (0, 1.5, 3.0, -1, -1, -1, 0.0))}
    assert (rg.shapley_of_tree(rows, single) == 0).all()


@pytest.mark.parametrize("cells,share", [(1 << 25, 400), (1 << 25, 1e9), (200, 400), (0, 400)])
def test_coalition_grids_and_walks_give_the_same_shapley_values(monkeypatch, cells, share):
    """Whatever coalitions are tabulated; a NaN goes right at every node, as in prediction."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (300, 5)), rng.normal(0, 1, 300)
    trees = [{k: np.array(v) for k, v in zip(rg.NODE_NAMES, zip(*rg.grow_tree(x[i:], (y + 3 * x[:, 0] * x[:, 3])[i:], 12)))} for i in (0, 20)]
    trees.append({k: np.array([v]) for k, v in zip(rg.NODE_NAMES, (0, 1.5, 3.0, -1, -1, -1, 0.0))})
    rows = np.concatenate([x, rng.normal(0, 2, (500, 5))])
    rows[::9, 2] = np.nan
    want = sum(rg.shapley_of(np.where(np.isnan(rows), np.inf, rows), rg.leaf_paths(t)) for t in trees[:2])
    monkeypatch.setattr(rg, "GRID_CELLS", cells)
    monkeypatch.setattr(rg, "GRID_SHARE", share)
    monkeypatch.setattr(rg, "LEAF_TABLES", 7)
    monkeypatch.setattr(rg, "WALK_ROWS", 100)
    assert np.abs(want).max() > 0.1 and np.allclose(rg.shapley_of_trees(rows, trees), want, atol=1e-9)
    monkeypatch.setattr(rg, "CODE_FEATURES", 4)
    assert np.allclose(rg.shapley_of_trees(rows, trees), want, atol=1e-9)


def test_missing_features_are_explained_as_they_are_predicted(table):
    holes = table.withColumn("b", F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("b")))
    model = rg.fit_forest(holes, ["a", "b", "c"], "y", n_trees=4, max_depth=6)
    got = rg.explain_rows(model, holes, "k", ["a", "b", "c"], digits=9)
    gap = F.abs(F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["shap_value"]) - F.col("model_output"))
    assert got.where(gap < 1e-6).count() == holes.count()


def test_rows_are_not_sent_once_per_tree(spark, table, monkeypatch):
    """With as many blocks as keep the cores busy, a row meets all trees in one group."""
    model = rg.fit_forest(table, ["a", "b", "c"], "y", n_trees=30, max_depth=4, fit_rows=100)
    rows = table.withColumn("_uid", F.col("k"))
    monkeypatch.setattr(rg, "BLOCK_ROWS", 1)
    sent = []
    real = F.sequence
    monkeypatch.setattr(rg.F, "sequence", lambda a, b, *more: (sent.append(b), real(a, b, *more))[1])
    got = rg.shapley_rows(model, model.nodes, rows, ["a", "b", "c"])
    assert got.count() == table.count()
    copies = spark.range(1).select(sent[0] + 1).first()[0]
    assert copies <= max(1, -(-4 * spark.sparkContext.defaultParallelism // table.count()))


def test_unknown_key_has_no_explanation(table, forest):
    assert rg.explain_rows(forest, table.where("k = 999"), "k", ["a", "b", "c"]).count() == 0


def test_predictions_stay_in_range(table, forest):
    lo, hi, plo, phi = rg.predict(forest, table, ["a", "b", "c"]).agg(F.min("y"), F.max("y"), F.min("prediction"), F.max("prediction")).first()
    assert lo <= plo <= phi <= hi


def test_leaking_target_is_refused(table):
    with pytest.raises(ValueError, match="also a feature"):
        rg.fit_forest(table, ["a", "y"], "y")


def test_rows_and_trees_are_split_into_blocks(table, forest, monkeypatch):
    whole = {r.k: r.contributions for r in rg.explain_rows(forest, table, "k", ["a", "b", "c"], digits=6).collect()}
    monkeypatch.setattr(rg, "BLOCK_ROWS", 7)
    assert {r.k: r.contributions for r in rg.explain_rows(forest, table, "k", ["a", "b", "c"], digits=6).collect()} == whole


def test_fit_rows_bound_what_is_learned_from(table):
    small = rg.fit_forest(table, ["a", "b", "c"], "y", n_trees=3, max_depth=30, fit_rows=10)
    assert small.nodes.count() <= 3 * 19
    whole = rg.fit_forest(table, ["a", "b", "c"], "y", n_trees=5, max_depth=30, fit_rows=10_000)
    assert rg.predict(whole, table, ["a", "b", "c"]).where("abs(prediction - y) > 2").count() < table.count() / 4
    got = rg.explain_rows(whole, table, "k", ["a", "b", "c"], digits=9)
    gap = got.select(F.max(F.abs(F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["shap_value"]) - F.col("model_output"))))
    assert gap.first()[0] < 1e-6
    with pytest.raises(ValueError, match="also a feature"):
        rg.fit_forest(table.withColumn("z_y", F.col("y")), ["a", "z_y"], "y")


def test_isolation_finds_the_odd_one(spark):
    rng = np.random.default_rng(9)
    data = [(i, *map(float, r)) for i, r in enumerate(rng.normal(0, 1, (400, 2)))] + [(999, 12.0, -12.0)]
    df = spark.createDataFrame(data, "k long, a double, b double")
    got = iso.isolation_forest(df, "k", ["a", "b"], 0.05, n_trees=50)
    assert got.orderBy(F.desc("anomaly_score")).first().k == 999
    assert abs(got.agg(F.sum("is_anomaly")).first()[0] - 20) <= 2
    lo, hi = got.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert lo == 0.0 and hi == pytest.approx(1.0, abs=1e-4)


def test_isolation_trees_are_well_formed(spark):
    df = spark.range(1000).select("id", (F.col("id") % 37).alias("a"), F.lit(1.0).alias("flat"))
    nodes = iso.fit(df, "id", ["a", "flat"], n_trees=5, sample=64).toPandas()
    assert set(nodes["feature"].dropna()) == {0} and nodes["node"].max() < 2**7
    for _, t in nodes.groupby("tree"):
        assert t.loc[t["node"] == 1, "size"].item() == 64
        assert t.loc[t["feature"].isna(), "size"].sum() == 64


def test_average_path():
    assert iso.average_path(1) == 0 and iso.average_path(2) == 1 and 10 < iso.average_path(256) < 10.5


def test_scoring_run_with_named_regions(spark):
    rng = np.random.default_rng(10)
    rows = [(f"R{i:02d}", *map(float, r), float(rng.uniform(0, 100))) for i, r in enumerate(rng.uniform(1, 100, (30, len(feat.FEATURE_COLUMNS))))]
    df = spark.createDataFrame(rows, ["region", *feat.FEATURE_COLUMNS, "hotspot_score"])
    got = score_regions(df, n_trees=5, max_depth=4).collect()
    assert len(got) == 30 and [r.risk_score for r in got] == sorted((r.risk_score for r in got), reverse=True)
    assert sum(r.is_anomaly for r in got) in (4, 5) and all(0 <= r.anomaly_score <= 1 for r in got)


def test_scoring_run_writes_no_row_per_tree(spark, monkeypatch):
    """However many trees forecast, no table of the run has more rows than regions or nodes."""
    from shirelens.operators import forest as fo

    rng = np.random.default_rng(12)
    rows = [(i, *map(float, r), float(rng.uniform(0, 100))) for i, r in enumerate(rng.uniform(1, 100, (80, len(feat.FEATURE_COLUMNS))))]
    df = spark.createDataFrame(rows, ["region", *feat.FEATURE_COLUMNS, "hotspot_score"])
    sizes = {}
    real = fo.materialize
    monkeypatch.setattr(fo, "materialize", lambda df, label, **kw: (got := real(df, label, **kw), sizes.setdefault(label, got.count()))[0])
    assert score_regions(df, n_trees=60, max_depth=2).count() == 80
    assert max(sizes.values()) <= 60 * 7


def test_indices_of_known_regions(spark):
    """Three hand-computed regions."""
    df = spark.createDataFrame([("a", 1000, 200, 50.0, 0.5, 10.0, 40.0, 10.0, 12.0, 5.0, 4.0, 20.0), ("b", 2000, 400, 80.0, 0.4, 20.0, 30.0, 10.0, 10.0, 0.0, 0.0, 0.0),
                                ("c", 500, 100, 60.0, 0.45, 0.0, 20.0, 10.0, 20.0, 1.0, 2.0, -5.0)],
                               "region string, total_population long, households long, literacy_rate double, female_ratio double, urban_pct double, work_participation_rate double,"
                               "total_crimes_latest double, total_crimes_max double, violent_crimes_sum double, property_crimes_sum double, crime_growth double")
    got = {r.region: r for r in feat.composite_indices(df).collect()}
    assert (got["a"].crime_rate_per_100k, got["a"].crime_severity_score, got["a"].population_density) == (1000.0, 380.0, 111.11)
    assert [got[k].normalized_crime_index for k in "abc"] == [0.3333, 0.0, 1.0]
    assert got["c"].hotspot_score == round((0.45 + 0.35 * 540 / 540 + 0.2 * 0.4) * 100, 2)


@pytest.mark.parametrize("name", ["forest_predictions", "scoring_run"])
def test_predictions_learn_from_all_regions(spark, monkeypatch, name):
    from shirelens.plans import queries, scoring_run

    class Seen(Exception):
        pass

    def fit(*args, fit_rows=None, **kwargs):
        raise Seen(fit_rows)

    monkeypatch.setattr(queries.rg, "fit_forest", fit)
    monkeypatch.setattr(scoring_run, "fit_forest", fit)
    with pytest.raises(Seen) as seen:
        queries.REGISTRY[name](spark, "/root/testdata/sf0.001").count()
    assert seen.value.args == (None,)


@pytest.mark.parametrize("name", ["explained_regions", "global_importance"])
def test_explanations_learn_from_all_regions(spark, monkeypatch, name):
    from shirelens.plans import queries

    class Seen(Exception):
        pass

    def fit(*args, fit_rows=None, **kwargs):
        raise Seen(fit_rows)

    monkeypatch.setattr(queries.rg, "fit_forest", fit)
    with pytest.raises(Seen) as seen:
        queries.REGISTRY[name](spark, "/root/testdata/sf0.001").count()
    assert seen.value.args == (None,)
