import itertools
from decimal import Decimal

import numpy as np
import pytest

from shirelens.operators import allocation as al

SPOTS = "center_lat double, center_lon double, risk_score double"
BASES = "base_id long, base_name string, base_lat double, base_lon double"


def data(spark, n_spots=60, n_bases=12, seed=7):
    rng = np.random.default_rng(seed)
    s = [(float(a), float(b), float(r)) for a, b, r in zip(rng.uniform(12.9, 13.1, n_spots), rng.uniform(77.5, 77.7, n_spots), rng.integers(1, 50, n_spots))]
    b = [(i, f"B{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([12.9, 77.5], [13.1, 77.7], (n_bases, 2)))]
    return s, b, spark.createDataFrame(s, SPOTS), spark.createDataFrame(b, BASES)


def km(a, b):
    p, q = np.radians(a[:2]), np.radians(b[:2])
    h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
    return 2 * 6371 * np.arcsin(np.sqrt(h))


def greedy(s, b, k, r):
    cover = {x[0]: {i for i, p in enumerate(s) if km(p, x[2:]) <= r} for x in b}
    done, out = set(), []
    for _ in range(k):
        best = max(cover, key=lambda i: (sum(s[j][2] for j in cover[i] - done), -i))
        gain = sum(s[j][2] for j in cover[best] - done)
        if gain <= 0:
            break
        done |= cover[best]
        out.append((best, gain))
    return out, cover


def test_batched_picks_equal_one_by_one(spark):
    s, b, spots, bases = data(spark)
    plan, metrics = al.max_coverage(spots, bases, 8, 4.0)
    got = [(r.base_id, float(r.gain)) for r in plan.orderBy("units").collect()]
    want, cover = greedy(s, b, 8, 4.0)
    assert got == want
    best = max(sum(s[j][2] for j in set().union(*(cover[i] for i in c))) for c in itertools.combinations(cover, 8))
    total = sum(x[2] for x in s)
    m = metrics.first()
    assert m.covered_pct <= round(best / total * 100, 1) <= m.upper_bound_pct + 0.05


def test_more_units_never_cover_less(spark):
    _, _, spots, bases = data(spark)
    grid = al.coverage_grid(spots, bases, [1, 2, 5, 9, 40], [1.0, 3.0, 6.0]).collect()
    for radius in (1.0, 3.0, 6.0):
        cells = sorted((g for g in grid if g.radius == radius), key=lambda g: g.units)
        assert [c.covered_pct for c in cells] == sorted(c.covered_pct for c in cells)
        assert [c.uncovered_count for c in cells] == sorted((c.uncovered_count for c in cells), reverse=True)
        assert all(c.covered_pct <= c.upper_bound_pct for c in cells) and cells[-1].units_used <= 12


def test_nothing_to_cover(spark):
    _, _, spots, bases = data(spark)
    plan, metrics = al.max_coverage(spots.limit(0), bases, 5, 3.0)
    m = metrics.first()
    assert (m.covered_pct, m.uncovered_count, m.total_spots, plan.count()) == (100.0, 0, 0, 0)
    far = spark.createDataFrame([(50.0, 8.0, 3.0)], SPOTS)
    m = al.max_coverage(far, bases, 5, 3.0)[1]
    assert m.first().covered_pct == 0.0 and m.first().uncovered_count == 1
    assert al.plan_summary(m, 5).first().solver_status == "Infeasible"
    free = spark.createDataFrame([(12.97, 77.59, 0.0)], SPOTS)
    assert al.max_coverage(free, bases, 5, 30.0)[1].first().covered_pct == 0.0


def test_bases_at_one_place_count_once(spark):
    spots = spark.createDataFrame([(12.0, 77.0, 1.0), (12.5, 77.5, 2.0)], SPOTS)
    bases = spark.createDataFrame([(4, "x", 12.0, 77.0), (2, "y", 12.0, 77.0), (9, "z", 12.5, 77.5)], BASES)
    plan, metrics = al.max_coverage(spots, bases, 3, 1.0)
    assert [(r.base_id, r.gain) for r in plan.orderBy("units").collect()] == [(9, Decimal("2.00")), (2, Decimal("1.00"))]
    assert al.plan_summary(metrics, 3).first().solver_status == "Optimal"
    assert {r.assignment for r in al.assignments(plan, bases).collect()} == {"Station:z", "Station:y"}


@pytest.mark.parametrize("k", [5, 10])
def test_units_reach_a_dense_spot(spark, k):
    bases = spark.createDataFrame([(f"b{i}", 10.0 + i * 0.05, 20.0, f"n{i}") for i in range(40)], "base_id string, base_lat double, base_lon double, base_name string")
    spots = spark.createDataFrame([(10.001, 20.001, 100.0), (10.5, 20.5, 0.22)], SPOTS)
    assert al.max_coverage(spots, bases, k, 3.0)[1].first().covered_pct >= 99.0
