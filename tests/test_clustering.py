"""Clustering against brute force on fixtures that hit the crowded and the sparse paths."""

import numpy as np
import pytest

import shirelens.operators.links as links
import shirelens.operators.spatial as sp
from shirelens.operators import components
from shirelens.operators.components import connected_components

R = 6371.0


def distances(a, b):
    p, q = np.radians(a)[:, None], np.radians(b)[None]
    h = np.sin((q[..., 0] - p[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((q[..., 1] - p[..., 1]) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.minimum(h, 1)))


def brute(near, min_pts):
    """Labels by definition: core components numbered by smallest core, borders to the smallest neighbour cluster."""
    core = near.sum(1) >= min_pts
    label = np.full(len(near), -1)
    k = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = k
        while todo:
            j = todo.pop()
            for n in np.flatnonzero(near[j] & core & (label < 0)):
                label[n] = k
                todo.append(n)
        k += 1
    out = label.copy()
    for i in np.flatnonzero(~core):
        c = label[near[i] & core]
        out[i] = c.min() if len(c) else -1
    return out


def run(spark, xy, **kw):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, lat double, lon double")
    got = {r[0]: r[1] for r in sp.dbscan_geo(df, "id", **kw).collect()}
    return np.array([got[i] for i in range(len(xy))])


@pytest.fixture(params=[4096, 6])
def pair_limit(request, monkeypatch):
    """A tiny limit sends every pair of cells through the refinement levels."""
    monkeypatch.setattr(links, "DIRECT_PAIRS", request.param)


@pytest.mark.parametrize("center", [(12.97, 77.59), (65.0, 179.999)])
def test_dbscan_equals_brute_force(spark, center, pair_limit):
    rng = np.random.default_rng(3)
    hot = rng.normal(0, 0.0008, (150, 2))  # a third of all points in one spot
    loose = rng.uniform(-0.03, 0.03, (280, 2))
    same = np.tile([[0.02, 0.02]], (20, 1))
    xy = np.vstack([hot, loose, same]) + np.array(center)
    xy[:, 1] = (xy[:, 1] + 540) % 360 - 180
    got = run(spark, xy, eps_km=0.4, min_pts=6)
    assert (got == brute(distances(xy, xy) <= 0.4, 6)).all()
    assert got.max() >= 1 and (got == -1).any()  # several clusters, some noise


def test_border_point_takes_smaller_cluster_and_no_cluster_case(spark):
    step = 0.5 / 111.19492664455873  # just within 0.5 km of latitude
    west = [(0.0 - step * 0.999 + d * 1e-6, 10.0) for d in range(4)]
    east = [(0.0 + step * 0.999 - d * 1e-6, 10.0) for d in range(4)]
    xy = np.array(east + west + [(0.0, 10.0)])
    got = run(spark, xy, eps_km=0.5, min_pts=4)
    assert (got == brute(distances(xy, xy) <= 0.5, 4)).all()
    alone = np.array([(0.0, 1.0), (1.0, 1.0), (2.0, 2.0)])
    assert (run(spark, alone) == -1).all()


def test_centers_fall_back_to_regions(spark):
    pts = spark.createDataFrame([(1, "b", 1.0, 1.0), (2, "a", 3.0, 3.0), (3, "a", 5.0, 5.0)], "id long, region string, lat double, lon double")
    labels = spark.createDataFrame([(1, -1), (2, -1), (3, -1)], "id long, cluster_id long")
    got = [tuple(r) for r in sp.cluster_centers(pts, labels, "id").orderBy("cluster_id").collect()]
    assert got == [(0, "a", 4.0, 4.0, 2, 100.0), (1, "b", 1.0, 1.0, 1, 50.0)]


def test_modal_region_prefers_smaller_on_ties(spark):
    pts = spark.createDataFrame([(i, r, 0.0, 0.0) for i, r in enumerate("bbaac")], "id long, region string, lat double, lon double")
    labels = spark.createDataFrame([(i, 0) for i in range(5)], "id long, cluster_id long")
    assert sp.cluster_centers(pts, labels, "id").first().region == "a"


@pytest.mark.parametrize("dense,chunk,limit", [(64, 1000, 4096), (4, 50, 9), (4, 50, 4096)])
@pytest.mark.parametrize("d", [2, 5])
def test_feature_dbscan_equals_brute_force(spark, monkeypatch, dense, chunk, limit, d):
    monkeypatch.setattr(sp, "DENSE_CELL", dense)
    monkeypatch.setattr(sp, "CHUNK", chunk)
    monkeypatch.setattr(links, "DIRECT_PAIRS", limit)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.15, (120, d)), rng.normal(0, 2.0, (150, d)), rng.normal(3, 0.2, (60, d))])
    cols = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(f"r{i:04d}", *map(float, r)) for i, r in enumerate(x)], ["id", *cols])
    got = {r[0]: r[1] for r in sp.dbscan_features(df, "id", cols, eps=0.6).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.6
    assert [got[f"r{i:04d}"] for i in range(len(x))] == brute(near, 2).tolist()


def test_distance_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    p, b = rng.uniform(-0.2, 0.2, (300, 2)) + [50, -180], rng.uniform(-0.2, 0.2, (40, 2)) + [50, 180]
    wrap = lambda m: np.column_stack([m[:, 0], (m[:, 1] + 540) % 360 - 180])
    p, b = wrap(p), wrap(b)
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "p int, la double, lo double")
    bases = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(b)], "b int, bla double, blo double")
    got = {(r.p, r.b) for r in sp.distance_join(pts, bases, 7.0, ("p", "la", "lo"), ("b", "bla", "blo")).collect()}
    assert got == set(zip(*map(lambda v: v.tolist(), np.nonzero(distances(p, b) <= 7.0))))


def test_distance_join_of_one_file_is_dealt_out(spark):
    pts = spark.range(0, 400, 1, 1).selectExpr("id as p", "12.5 + id / 1e5 as la", "74.5D as lo")
    bases = spark.range(0, 50, 1, 1).selectExpr("id as b", "12.5 + id / 1e5 as bla", "74.5D as blo")
    got = sp.distance_join(pts, bases, 3.0, ("p", "la", "lo"), ("b", "bla", "blo"))
    assert got.count() == 400 * 50 and got.selectExpr("spark_partition_id() as task").distinct().count() > 1


def test_distances_by_matrix_product_follow_the_definition():
    rng = np.random.default_rng(4)
    p, q = np.round(rng.uniform(-50, 50, (90, 3)), 1), np.round(rng.uniform(-50, 50, (80, 3)), 1)
    q[:40] = p[:40] + [[0.0, 1.5, 0.0]]  # on the edge
    p[50], q[60] = np.nan, np.inf
    gap = np.zeros((90, 80))
    for x in range(3):
        gap += (p[:, None, x] - q[None, :, x]) ** 2
    with np.errstate(invalid="ignore"):
        assert (sp._within(p, q, 1.5) == (np.sqrt(gap) <= 1.5)).all()


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    hub = [(100, i) for i in range(101, 180)] + [(500, 500)]
    df = spark.createDataFrame(path + hub, "src long, dst long")
    got = {r[0]: r[1] for r in connected_components(df).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 180)} == {100} and 500 not in got
    assert connected_components(df.where("src > 900")).count() == 0


def test_edges_of_one_task_are_contracted_there(spark, monkeypatch):
    made = []
    keep = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label, **kw: (made.append(label), keep(df, label, **kw))[1])
    path = [(i * 7919 % 1000, (i + 1) * 7919 % 1000) for i in range(900)]
    df = spark.createDataFrame(path, "src long, dst long")
    got = {r[0]: r[1] for r in connected_components(df).collect()}
    assert len(got) == 901 and set(got.values()) == {min(got)} and made == ["edges"]  # no round
    monkeypatch.setattr(components, "LOCAL_EDGES", 40)  # 900 edges in stars of 40 at a time
    assert {r[0]: r[1] for r in connected_components(df).collect()} == got
    words = connected_components(spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "src string, dst string")).collect()
    assert {tuple(r) for r in words} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_edges_in_many_small_files_meet_without_rounds(spark, monkeypatch):
    made = []
    keep = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label, **kw: (made.append(label), keep(df, label, **kw))[1])
    df = spark.createDataFrame([(i * 7919 % 1000, (i + 1) * 7919 % 1000) for i in range(900)] + [(2000, 2001), (3000, None)], "src long, dst long")
    want = {i * 7919 % 1000: 0 for i in range(901)} | {2000: 2000, 2001: 2000}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r[0]: r[1] for r in connected_components(df).collect()} == want and made == ["edges", "gathered"]
        monkeypatch.setattr(components, "TASK_EDGES", 300)  # more than one task: the rounds take over
        assert {r[0]: r[1] for r in connected_components(df).collect()} == want and "stars" in made
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_grid_cells_truncate(spark):
    df = spark.createDataFrame([(3, "a", 1.0, 2.0, 0.39, 5.0)], "cluster_id long, region string, center_lat double, center_lon double, risk_score double, severity_mean double")
    r = sp.grid_cells(df).first()
    assert (r.cell_id, r.crime_count) == ("3_0", 11)
    assert sp.risk_by_region(df).count() == 1
