"""Periodic runs of words by suffix-tree LCE and Lyndon roots.

A document's words become integer symbols.  Ukkonen's algorithm builds the suffix trees of the symbol sequence and of its reversal, each
with a unique end symbol; an Euler tour of each tree with a minimum table over blocks answers the lowest common ancestor of two leaves,
and so the longest common extension of two positions forwards or backwards, in constant time.  By the runs theorem every run has a Lyndon
root that is the longest Lyndon word starting at its position, for one of the two orders of the symbols; the Lyndon arrays of both
orders come from suffix comparisons by the same extensions.  Each candidate (position, Lyndon length p) is extended both ways; a stretch
of period p of at least ``max(MIN_WORDS, MIN_EXPONENT * p)`` words is a run, with p its smallest period (a Lyndon word has no border).

Only windows that can hold a run go through the trees, an exact filter: in a run of period q every word after the first q has its
previous occurrence at most q words back, so [start + q, end) lies in a stretch of at least 3q words whose previous occurrences are at
most Q back, Q the power of two with Q/2 < q <= Q.  For each Q the stretches long enough give windows [stretch start - Q, stretch end);
no run reaches past the window of its own Q, so the runs of the merged windows are exactly the document's runs.

Spark deals documents to tasks in Arrow batches of bounded bytes; the work per document is linear in its words, apart from the sort of
its word ids.

Defined results: words are maximal runs of ``[^\\x20\\x09-\\x0D]`` code points, compared exactly (no case folding); a null or empty text has
no words and no runs; a null doc_id plants nothing (it has no crc32); repeated rows give repeated results; with no run, start, length,
period and exponent_milli are null and runs_sha256 is the sha256 of the empty text; collapsed_sha256 is never null.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

# Fixed values of the contract.
WORD = re.compile(r"[^\x20\x09-\x0d]+")
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Euler-tour positions per block of the minimum table; tours up to FULL_TABLE positions get a table of all ranges.
BLOCK = 32
FULL_TABLE = 1 << 16

RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words after the contract's planted repetition (if crc32 of the decimal id ends in 0)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


class SuffixTree:
    """Ukkonen's suffix tree of ``s`` (ints, the last one unique) with constant-time LCE of two suffixes by LCA of their leaves."""

    def __init__(self, s: list[int]):
        n = len(s)
        self.n = n
        start, end, link, child = [-1], [-1], [0], [{}]
        leaf_end = n  # every leaf edge runs to the end once all of s is in

        def new(st: int, en: int) -> int:
            start.append(st)
            end.append(en)
            link.append(0)
            child.append({})
            return len(start) - 1

        node, edge, length, remainder = 0, 0, 0, 0
        for i, c in enumerate(s):
            remainder += 1
            last = -1
            while remainder:
                if not length:
                    edge = i
                a = s[edge]
                nxt = child[node].get(a)
                if nxt is None:
                    child[node][a] = new(i, -1)
                    if last >= 0:
                        link[last] = node
                        last = -1
                else:
                    e = end[nxt] if end[nxt] >= 0 else i + 1
                    span = e - start[nxt]
                    if length >= span:
                        edge += span
                        length -= span
                        node = nxt
                        continue
                    if s[start[nxt] + length] == c:
                        if last >= 0 and node:
                            link[last] = node
                        length += 1
                        break
                    split = new(start[nxt], start[nxt] + length)
                    child[node][a] = split
                    child[split][c] = new(i, -1)
                    start[nxt] += length
                    child[split][s[start[nxt]]] = nxt
                    if last >= 0:
                        link[last] = split
                    last = split
                remainder -= 1
                if not node and length:
                    length -= 1
                    edge = i - remainder + 1
                elif node:
                    node = link[node]
        # string depths, Euler tour and the leaf of every suffix
        depth = [0] * len(start)
        leaf_of = [0] * n
        tour_node, tour_depth = [], []
        first = [0] * len(start)
        stack = [(0, iter(child[0].values()))]
        first[0] = 0
        tour_node.append(0)
        tour_depth.append(0)
        while stack:
            v, it = stack[-1]
            u = next(it, None)
            if u is None:
                stack.pop()
                if stack:
                    tour_node.append(stack[-1][0])
                    tour_depth.append(depth[stack[-1][0]])
                continue
            e = end[u] if end[u] >= 0 else leaf_end
            depth[u] = depth[v] + e - start[u]
            first[u] = len(tour_node)
            tour_node.append(u)
            tour_depth.append(depth[u])
            if not child[u]:
                leaf_of[n - depth[u]] = u
            stack.append((u, iter(child[u].values())))
        self.first = np.array([first[leaf_of[i]] for i in range(n)], np.int64)
        d = np.array(tour_depth, np.int64)
        self.d = d
        blocks = -(-len(d) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max, np.int64)
        padded[:len(d)] = d
        level = padded.reshape(blocks, BLOCK).min(axis=1)
        self.table = [level]
        k = 1
        while (1 << k) <= blocks:
            prev = self.table[-1]
            self.table.append(np.minimum(prev[:len(prev) - (1 << (k - 1))], prev[1 << (k - 1):]))
            k += 1
        self.full = None
        if len(d) <= FULL_TABLE:
            full = [d]
            k = 1
            while (1 << k) <= len(d):
                prev = full[-1]
                full.append(np.minimum(prev[:len(prev) - (1 << (k - 1))], prev[1 << (k - 1):]))
                k += 1
            self.full = [t.tolist() for t in full]
        self.firsts = self.first.tolist()
        self.dl = d.tolist()
        self.tables = [t.tolist() for t in self.table]

    def _min(self, lo: int, hi: int) -> int:
        """Smallest tour depth in positions lo..hi (inclusive)."""
        if self.full is not None:
            k = (hi - lo + 1).bit_length() - 1
            t = self.full[k]
            a, b = t[lo], t[hi - (1 << k) + 1]
            return a if a < b else b
        bl, bh = lo // BLOCK, hi // BLOCK
        d = self.dl
        if bl == bh:
            return min(d[lo:hi + 1])
        best = min(min(d[lo:(bl + 1) * BLOCK]), min(d[bh * BLOCK:hi + 1]))
        if bh - bl > 1:
            a, b = bl + 1, bh - 1
            k = (b - a + 1).bit_length() - 1
            t = self.tables[k]
            best = min(best, t[a], t[b - (1 << k) + 1])
        return best

    def lce(self, i: int, j: int) -> int:
        """Longest common prefix of the suffixes at i and j (i != j); never counts the end symbol."""
        a, b = self.firsts[i], self.firsts[j]
        return self._min(a, b) if a < b else self._min(b, a)


def lyndon_array(v: list[int], lce) -> list[int]:
    """Length of the longest Lyndon word starting at each position of v (v ends with a unique smallest symbol, not counted)."""
    n = len(v) - 1
    lam = [0] * n
    for i in range(n - 1, -1, -1):
        j = i + 1
        while j < n:
            l = lce(i, j)
            if v[i + l] < v[j + l]:
                j += lam[j]
            else:
                break
        lam[i] = j - i
    return lam


def windows(ids: np.ndarray) -> list[tuple[int, int]]:
    """Merged windows ``[a, b)`` that hold every run (see the module's text)."""
    n = len(ids)
    order = np.lexsort((np.arange(n), ids))
    back = np.full(n, n + 1, np.int64)
    same = ids[order][1:] == ids[order][:-1]
    later, earlier = order[1:][same], order[:-1][same]
    back[later] = later - earlier
    found = []
    q_top = 1
    while q_top <= max(1, n // MIN_EXPONENT) * 2:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (back <= q_top).astype(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        # the smallest q with this Q: 1 for Q = 1, else Q/2 + 1; the stretch holds at least max(MIN_WORDS, MIN_EXPONENT q) - q words
        q_low = 1 if q_top == 1 else q_top // 2 + 1
        need = max(MIN_WORDS, MIN_EXPONENT * q_low) - q_low
        keep = ends - starts >= need
        found += [(max(0, int(a) - q_top), int(b)) for a, b in zip(starts[keep], ends[keep])]
        q_top *= 2
    found.sort()
    merged: list[list[int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """Sorted ``(start, length, period)`` of every run (see the module's text)."""
    if len(words) < MIN_WORDS:
        return []
    # symbols numbered by first occurrence: any total order of the symbols serves the runs theorem
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    found = []
    for a, b in windows(ids):
        found += [(a + s, l, p) for s, l, p in window_runs(ids[a:b].tolist())]
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def window_runs(ids: list[int]) -> list[tuple[int, int, int]]:
    """Runs of one window of symbols, by the suffix trees of the window and its reversal."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    top = max(ids)
    fwd = SuffixTree(ids + [-1])
    back = SuffixTree(ids[::-1] + [-1])
    found = set()
    for order in (ids + [-1], [top - x for x in ids] + [-1]):
        lam = lyndon_array(order, fwd.lce)
        for i, p in enumerate(lam):
            right = fwd.lce(i, i + p) if i + p < n else 0
            left = back.lce(n - i, n - i - p) if i > 0 else 0
            size = p + right + left
            if size >= max(MIN_WORDS, MIN_EXPONENT * p):
                found.add((i - left, size, p))
    return list(found)


def describe(doc_id: int | None, text: str | None) -> tuple:
    words = planted(WORD.findall(text or ""), doc_id)
    runs = runs_of(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, l, p in runs:
        drop[s + p] += 1
        drop[s + l] -= 1
    keep = np.cumsum(drop)[:len(words)] == 0
    collapsed = " ".join(w for w, k in zip(words, keep) if k)
    listing = "".join(f"{s},{l},{p}\n" for s, l, p in runs)
    best = None
    for s, l, p in runs:
        if best is None or l * best[2] > best[1] * p or (l * best[2] == best[1] * p and (s, p) < (best[0], best[2])):
            best = (s, l, p)
    head = (best[0], best[1], best[2], (1000 * best[1]) // best[2]) if best else (None, None, None, None)
    return (doc_id, len(runs), *head, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RESULT.split(", ")]
    for batch in batches:
        rows = [describe(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if k.endswith("sha256") else pa.int64()) for k, c in zip(names, cols)], names)


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches, RESULT)
