"""Ranked lexical search against a brute-force scorer, edge rows and the registered query against its SQL twin."""

import math
import re
from collections import Counter

import duckdb
import pytest

from shirelens.llm import lexical_search as ls

from .conftest import SCHEMA, edge_rows, prose

TERM = re.compile(ls.TERM)


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(ls.UPPER, ls.LOWER)))


def brute(docs, queries, k=20):
    tfs = [Counter(terms(t)) for _, t in docs]
    have = [c for c in tfs if c]
    n_docs, n_all = len(have), sum(sum(c.values()) for c in have)
    df = Counter(t for c in have for t in c)
    out = []
    for item, qt in queries:
        qc = Counter(terms(qt))
        scored = []
        for (d, _), c in zip(docs, tfs):
            if not c:
                continue
            m = 75 + (25 * sum(c.values()) * n_docs) // n_all
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, n in qc.items() if t in c)
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(scored[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _got(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, prose(1, 12)), (2, "ONE two"), (3, None), (4, "été 日本語"), (5, ""), (None, "alpha3 beta7 one"), (6, prose(4, 30) + " one one")]
    return rows, spark.createDataFrame(rows, "item_id long, text string").repartition(2)


def test_against_brute_force(spark, edge, queries, monkeypatch):
    monkeypatch.setattr(ls, "DOC_BLOCK", 3)
    rows, q = queries
    docs = [(r[0], r[1]) for r in edge_rows()]
    for bins in (1, 7, 4096):
        assert _got(ls.rank(edge, q, k=4, bins=bins)) == brute(docs, rows, k=4)
    assert _got(ls.rank(edge, q, k=20)) == brute(docs, rows, k=20)


def test_query_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ls, "QUERY_BLOCK", 2)
    docs = [(i, "tie tie word" if i % 3 else f"other {i}") for i in range(60)] + [(None, "tie tie word"), (7, "tie tie word")]
    qrows = [(i, "tie word") for i in range(5)] + [(9, "other")]
    got = _got(ls.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                       spark.createDataFrame(qrows, "item_id long, text string"), k=20))
    assert got == brute(docs, qrows)


def test_empty_and_clashing_columns(spark, nothing, edge, queries):
    rows, q = queries
    assert ls.rank(nothing, q).count() == 0
    assert ls.rank(edge, q.limit(0)).count() == 0
    clash = edge.withColumnRenamed("n", "_rk").withColumn("term", edge["text"]).withColumn("score", edge["doc_id"])
    docs = [(r[0], r[1]) for r in edge_rows()]
    assert _got(ls.rank(clash, q.withColumn("_q", q["item_id"]), k=3)) == brute(docs, rows, k=3)


def test_registered_query_equals_sql(spark):
    from shirelens.llm import registry
    sf = "/root/testdata/sf0.001"
    got = _got(registry.QUERIES["op11_lexical_search"](spark, sf))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = sorted([tuple(r) for r in con.execute(registry.SQL["op11_lexical_search"]).fetchall()], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert len(got) > 0 and got == want
