"""Periodic runs against a brute force of the definition, the planted repetition, edge rows."""

import hashlib
import random

import pytest

from shirelens.llm import periodic_runs as pr

from .conftest import SCHEMA, edge_rows


def brute_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            a = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            start, length = a, k - a + q
            smallest = next(r for r in range(1, q + 1) if all(words[start + t] == words[start + t + r] for t in range(length - r)))
            if smallest == q and length >= max(6, 4 * q):
                out.add((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_describe(doc_id, text):
    words = pr.planted(pr.WORD.findall(text or ""), doc_id)
    runs = brute_runs(words)
    dropped = {i for s, l, p in runs for i in range(s + p, s + l)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    ratio = [r for r in runs if best and r[1] * best[2] == best[1] * r[2]]
    if ratio:
        best = min(ratio, key=lambda r: (r[0], r[2]))
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256("".join(f"{s},{l},{p}\n" for s, l, p in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_runs_match_brute_force():
    rng = random.Random(5)
    for trial in range(400):
        alphabet = "ab" if trial % 3 == 0 else "abc" if trial % 3 == 1 else "abcdefgh"
        n = rng.randint(0, 80)
        words = [rng.choice(alphabet) for _ in range(n)]
        if trial % 4 == 0 and n > 10:
            p, a = rng.randint(1, 5), rng.randint(0, n - 6)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert pr.runs_of(words) == brute_runs(words), words


def test_planted_repetition():
    hits = [d for d in range(400) if __import__("zlib").crc32(str(d).encode()) % 10 == 0]
    assert hits
    words = [f"w{i}" for i in range(50)]
    for d in hits[:5]:
        got = pr.planted(words, d)
        assert len(got) == 50 and pr.runs_of(got) == brute_runs(got)
    assert pr.planted(words, None) == words and pr.planted([], hits[0]) == []


def test_query_rows_on_edges(spark, edge, nothing):
    got = sorted(pr.find_runs(edge).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.collapsed_sha256))
    want = sorted([pr.describe(r[0], r[1]) for r in edge_rows()], key=lambda r: (r[0] is None, r[0] or 0, r[7]))
    assert [tuple(r) for r in got] == want
    for r in edge_rows():
        if len(pr.WORD.findall(r[1] or "")) <= 400:
            assert pr.describe(r[0], r[1]) == brute_describe(r[0], r[1])
    assert pr.find_runs(nothing).count() == 0
    empty = pr.describe(1, None)
    assert empty[1] == 0 and empty[2:6] == (None,) * 4 and empty[6] == hashlib.sha256(b"").hexdigest()


def test_long_periodic_text():
    words = ("x y z " * 3000).split() + ["end"] + ["a"] * 20
    runs = pr.runs_of(words)
    assert runs == [(0, 9000, 3), (9001, 20, 1)]
    assert pr.describe(7, " ".join(words))[2:6] == (0, 9000, 3, 3000000)


def test_windows_hold_every_run():
    rng = random.Random(11)
    for trial in range(300):
        n = rng.randint(6, 120)
        words = [f"w{rng.randint(0, 40)}" for _ in range(n)]
        for _ in range(rng.randint(1, 3)):  # plant runs of several periods
            p, a = rng.randint(1, 9), rng.randint(0, n - 1)
            end = min(n, a + p * rng.randint(3, 6))
            words[a:end] = [words[a + (i - a) % p] for i in range(a, end)]
        assert pr.runs_of(words) == brute_runs(words), words
