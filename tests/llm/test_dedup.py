"""Exact dedup, Jaccard join and suffix dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from shirelens.llm import common, exact_dedup, jaccard_join, registry, suffix_dedup

from .conftest import SCHEMA, edge_rows, prose


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((i, t or ""))
    out = []
    for plain, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), hashlib.sha256(plain.encode()).hexdigest()) for i, _ in members]
    return Counter(out)


def test_exact_matches_brute_force(edge):
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = exact_dedup.duplicates(edge).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_exact_many_runs_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 7)
    rows = [(i, f"text {i % 90}" + " " * (i % 4)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = exact_dedup.duplicates(df).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)


def test_runs_of_one_leading_word_are_told_apart():
    e = np.zeros(3, exact_dedup.ENTRY)
    e["d0"], e["d3"], e["n"], e["uid"] = 5, [1, 2, 1], 1, [9, 8, 7]
    merged = exact_dedup.merge_runs(e)
    assert merged["n"].tolist() == [2, 1] and merged["uid"].tolist() == [7, 8]


def test_keep_one_keeps_columns(edge, nothing):
    got = exact_dedup.keep_one(edge)
    assert got.columns == edge.columns
    plain = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in got.collect()]
    assert len(plain) == len(set(plain)) == len({re.sub("[\x20\x09-\x0d]", "", r[1] or "") for r in edge_rows()})
    assert exact_dedup.keep_one(nothing).count() == 0 and exact_dedup.duplicates(nothing).count() == 0


def shingle_set(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    """Component per row position, with the links among all of them."""
    sets = [shingle_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[max(root(i), root(j))] = min(root(i), root(j))
    name = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        name[root(k)].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in name.items()}
    return Counter((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width,percent,leaf", [(3, 90, 2048), (5, 80, 2)])
def test_jaccard_matches_brute_force(edge, monkeypatch, width, percent, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF_MAX", leaf)
    got = jaccard_join.linked_classes(edge, width=width, percent=percent).collect()
    assert Counter(tuple(r) for r in got) == brute_components([(r[0], r[1]) for r in edge_rows()], width, percent)


@pytest.mark.parametrize("leaf", [2048, 20])
def test_jaccard_families(spark, monkeypatch, leaf):
    """A large family whose members differ from each other more than from their origin, and chains of links."""
    monkeypatch.setattr(jaccard_join, "LEAF_MAX", leaf)
    base, rows = prose(9, 120).split(), []
    for k in range(90):
        w = list(base)
        for m in range(k % 5):
            w[(k * 7 + m * 31) % len(w)] = f"edit{k}x{m}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, " ".join(prose(77, 200).split()[k * 3:k * 3 + 100])) for k in range(20)]
    rows += [(3000 + k, prose(100 + k, 60) + " shared line that all of these documents end with") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.linked_classes(df, width=3, percent=90).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows, 3, 90)


def test_jaccard_keep_one(edge, nothing):
    got = jaccard_join.keep_one(edge).collect()
    names = brute_components([(r[0], r[1]) for r in edge_rows()], 5, 80)
    wanted = {c for (i, n, c) in names if n} | {i for (i, n, c) in names if not n}
    assert {r.doc_id for r in got} == wanted and jaccard_join.keep_one(edge).columns == edge.columns
    assert jaccard_join.keep_one(nothing).count() == 0 and jaccard_join.linked_classes(nothing).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_tree_bounds_lose_nothing(percent):
    """Sets of all sizes, on both sides of every change of the bitmap's length."""
    rng = np.random.default_rng(4)
    sets = []
    for size in (3, 20, 240, 256, 257, 300, 500, 513, 1100):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64) << np.uint64(1)
        for k in range(12):
            sets.append(np.unique(np.concatenate([base[:size - k * size // 40], rng.integers(0, 1 << 63, k * size // 60).astype(np.uint64) << np.uint64(1)])))
    sizes = np.array([len(s) for s in sets])
    similar = lambda p, q: 100 * len(np.intersect1d(sets[p], sets[q])) >= percent * len(np.union1d(sets[p], sets[q]))
    links, bound = jaccard_join.Links(len(sets)), jaccard_join.Links(len(sets))
    jaccard_join.connect(sizes, [jaccard_join.bitmap_of(s) for s in sets], percent, links, similar)
    jaccard_join.connect(sizes, [jaccard_join.bitmap_of(s) for s in sets], percent, bound)
    for p in range(len(sets)):
        for q in range(p):
            assert not similar(p, q) or (links.root(p) == links.root(q) and bound.root(p) == bound.root(q))
    assert len({bound.root(p) for p in range(len(sets))}) >= 5  # unrelated sets stay apart by their bitmaps alone


def brute_repeats(rows, length):
    count = Counter(b[s:s + length] for b in ((t or "").encode() for _, t in rows) for s in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("group_max", [2000, 1])
def test_repeats_match_brute_force(spark, monkeypatch, group_max):
    monkeypatch.setattr(suffix_dedup, "GROUP_MAX", group_max)
    passage = prose(50, 20)
    rows = [(r[0], (r[1] or "")[:4000] if r[1] else r[1]) for r in edge_rows()]
    rows += [(100 + k, prose(200 + k, 15) + passage[k % 4:len(passage) - k % 3] + prose(300 + k, 15)) for k in range(25)]
    rows += [(200, "ab" * 200), (201, passage + passage), (202, passage[:99]), (203, "z" + passage[:100]), (204, passage[:100] + "z")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, lo string, id int").repartition(4)
    got = suffix_dedup.remove_repeats(df, length=100, gram=40).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats(rows, 100)


def test_repeats_over_windows_of_a_very_long_text(spark):
    """Texts longer than the windows that they are looked at in, and a copy that is shifted against these."""
    long = np.random.default_rng(11).integers(97, 123, 1_300_000).astype(np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, long), (2, "x" * 77 + long + "y"), (3, long[1_040_000:1_041_000])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: (1_300_000, 1), 2: (1_300_000, 1), 3: (1000, 1)}


def test_repeats_of_one_very_common_anchor(spark, monkeypatch):
    """One anchor with most of the rows, in equal and in different contexts: no plan gathers its rows by a window, and nothing is lost."""
    plans, keep = [], suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df, label))[1])
    passage = prose(70, 18)[:110]
    rows = [(k, "-" * (150 + k) + prose(400 + k, 8)) for k in range(12)] + [(100 + k, f"{k} {passage}{k * 7}") for k in range(40)]
    df = spark.createDataFrame([*rows, (None, rows[20][1]), rows[21]], "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(df, length=100, gram=40).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_repeats([*rows, (None, rows[20][1]), rows[21]], 100)
    assert len(plans) > 4 and not [p for p in plans if "Window" in p]


def test_repeats_query_returns_what_is_left(spark, tmp_path):
    """Passages of over 50 words that documents share are gone from the query's text, and documents without one are left alone."""
    passage = prose(61, 70)
    rows = [(k, f"{prose(500 + k, 30)} {passage} {prose(600 + k, 30)}") for k in range(6)] + [(10 + k, prose(700 + k, 90)) for k in range(6)]
    rows += [(20, "é" + prose(62, 70) + " end"), (21, "ĩ" + prose(62, 70) + "!"), (22, None), (23, "")]  # the last bytes of é and ĩ are equal
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op10_suffix_dedup"](spark, str(tmp_path)).collect()}
    wanted = {r[0]: r for r in brute_repeats(rows, 400)}
    for i, t in rows:
        _, n, removed, spans, kept = wanted[i]
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
        assert got[i].text == kept.decode(errors="replace")
        assert (passage in t and passage not in got[i].text) if i < 10 else i >= 20 or got[i].text == t
    assert got[20].text == "\ufffd end" and got[21].text == "\ufffd!" and got[22].text == ""


def test_repeats_of_nothing(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_key_filter_is_gathered_as_bits(spark, monkeypatch):
    keys = spark.range(0, 4000, 2, 3).select((F.col("id") * 1_000_003).alias("k"))
    rows = spark.range(4000).select((F.col("id") * 1_000_003).alias("k"))
    gathered = []
    keep = common.any_of_bitmaps
    monkeypatch.setattr(common, "any_of_bitmaps", lambda parts: (gathered.append(keep(parts)), gathered[-1])[1])
    inside = {r.k for r in rows.mapInArrow(common.maybe_in(keys, "k"), "k long").collect()}
    outside = {r.k for r in rows.mapInArrow(common.maybe_in(keys, "k", invert=True), "k long").collect()}
    wanted = {r.k for r in keys.collect()}
    assert wanted <= inside and len(inside) < 2050 and not inside & outside and len(inside | outside) == 4000
    assert [x.nbytes for x in gathered] == [(1 << common.FILTER_BITS) // 8] * 2
    assert not rows.mapInArrow(common.maybe_in(keys.where("k < 0"), "k"), "k long").collect()


def test_schema_names_clash_on_purpose():
    assert {"part", "id", "uid", "node", "n"} <= {f.split()[0] for f in SCHEMA.split(", ")}


def test_digests_are_unpacked_by_the_worker_that_merged_them(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string").repartition(5)
    groups = exact_dedup.tree_merge(exact_dedup._slim(df, "doc_id", "text"))
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    last = plan[:plan.index("FlatMapGroupsInArrow")]
    assert "MapInArrow" not in last  # one Python worker in the last stage
    assert sorted((r.keep_id, r.group_size) for r in groups.collect()) == [(i, 6 if i < 5 else 5) for i in range(7)]
