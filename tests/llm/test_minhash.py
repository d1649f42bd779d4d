"""MinHash near-dedup against all pairs by brute force; sketch properties; edge rows."""

import re

import numpy as np

from shirelens.llm import minhash_dedup as mh
from shirelens.llm.common import U64

from .conftest import edge_rows, prose

SPACE = re.compile(r"[^\x20\x09-\x0d]+")


def shingle_set(text, width=2):
    words = SPACE.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(rows, percent=80):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            comp[r] = min(comp.get(r, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = comp.get(find(i))
        out.append((d, len(sets[i]), c, (d is None and c is None) or d == c))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or 0))


def _got(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or 0))


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 127, 128, 1000, 100_000):
        s = mh.sketch(rng.integers(0, 2**63, n).astype(U64))
        assert (s < np.iinfo(np.uint64).max).all()
    a = rng.integers(0, 2**63, 5000).astype(U64)
    b = np.concatenate([a[:4000], rng.integers(0, 2**63, 1000).astype(U64)])  # Jaccard 4000 / 6000
    agree = (mh.sketch(a) == mh.sketch(b)).mean()
    assert abs(agree - 4000 / 6000) < 0.15


def test_against_brute_force(spark, edge):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert _got(mh.near_duplicates(edge)) == brute(rows)


def test_families_and_chains(spark):
    base = prose(9, 200).split()
    rows = []
    for i in range(120):  # near copies: a few words changed each, plus exact copies
        w = list(base)
        for k in range(i % 4):
            w[(i * 7 + k * 31) % len(w)] = f"edit{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i % 10][1]) for i in range(60)]
    rows += [(400 + i, prose(100 + i, 30)) for i in range(40)] + [(None, rows[0][1]), (1000, None), (1001, ""), (1002, "ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert _got(mh.near_duplicates(df)) == brute(rows)


def test_links_between_members_that_miss_the_buckets_smallest(spark, monkeypatch):
    """Twins link with each other and with nobody else, but their buckets hold many smaller members of the family."""
    monkeypatch.setattr(mh, "BLOCK", 8, raising=False)  # every bucket and family is cut into several blocks
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(201)]  # 200 shingles
    rows = []
    for pair in range(30):
        at = rng.choice(np.arange(1, 200, 2), 12, replace=False)
        for twin in range(2):  # twins share 180 of 220 shingles, others about 172 of 228
            w = list(base)
            for k in at[:2]:
                w[k] = f"both{pair}_{k}"
            for k in at[2 + 5 * twin:7 + 5 * twin]:
                w[k] = f"own{pair}_{twin}_{k}"
            rows.append((pair + 100 * twin, " ".join(w)))
    df = spark.createDataFrame(sorted(rows), "doc_id long, text string").coalesce(1)  # row keys follow the ids
    want = brute(sorted(rows))
    assert sum(r[2] != r[0] for r in want) >= 30
    assert _got(mh.near_duplicates(df)) == want


def test_blocks_of_a_large_component_meet_the_others_only(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 20)
    comp = [0] * 1000 + list(range(1000, 1030)) + [1030] * 5
    rows = [(1, i, c) for i, c in enumerate(comp)] + [(2, 5000 + i, 7) for i in range(100)] + [(3, 6000 + i, i) for i in range(45)]
    got = mh._blocks(spark.createDataFrame(rows, "grp int, _rk long, comp long"), ["grp"]).collect()
    assert len(got) < 1000 * 2 + 35 * 52 + 45 * 4 + 50  # the square: 1,035 * 52
    met, sizes = set(), {}
    for r in got:
        sizes.setdefault(r.gid, []).append(r)
    for block in sizes.values():
        assert len(block) < 90 and len({r.cross for r in block}) == 1
        met |= {(a["_rk"], b["_rk"]) for a in block for b in block if a.comp != b.comp and (not a.cross or a.side != b.side)}
    for g in (1, 2, 3):
        own = [(rk, c) for k, rk, c in rows if k == g]
        assert {(a, b) for a, x in own for b, y in own if x != y} == {p for p in met if p[0] in dict(own)}


def test_empty_and_clashing(spark, nothing, edge):
    assert mh.near_duplicates(nothing).count() == 0
    clash = edge.withColumnRenamed("n", "_rk").withColumn("component", edge["doc_id"]).withColumn("bands", edge["text"])
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert _got(mh.near_duplicates(clash)) == brute(rows)
