"""Ranked lexical search by hashed max-sketches.

Every document gets the exact integer impact of each query term it holds, a BM25 form with global statistics (N documents with a term,
L terms in all, df per term) that Spark aggregates over all documents in a first scan.  In a second scan each task folds the impacts of
every term of a document into a sketch of ``bins`` coordinates: coordinate ``hash(term) mod bins`` holds the largest impact of the terms
hashed there (a term that no query holds enters with the largest impact any term could have, so the sketch is an index of the whole text).
For a query with term counts c, the sum of c times the sketch at the query's coordinates bounds the exact score from above.  A block of
queries is scored against a block of documents with one matrix product of bounds; documents are then rescored exactly in descending order
of bound until the bound falls below the k-th exact score.  The tasks' top k are merged per query by a window over at most k rows per task.

Only the query side travels to the tasks: the stated query set with its terms and their df, ``QUERY_BLOCK`` queries at a time.  Documents
are never shuffled, so a hot source or a term in every document costs nothing extra.

Defined results: terms are maximal runs of ``TERM`` after A-Z are lower-cased (nothing else is folded); a null text has no terms; a document
without terms counts in neither N nor L and is never ranked; only scores above 0 are ranked; equal scores go by ascending doc_id, a null
doc_id last; every row of ``documents`` is its own document (repeated rows and ids are ranked side by side); every row of the queries is
its own query, its item_id carried as given; a query without terms ranks nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches

# Fixed values of the contract: the term pattern, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
B_PERCENT = 25  # weight of the length in m: tf / (tf + 1.2 * (1 - 0.25 + 0.25 * n / avg n)), in integers

#: Coordinates of a document's sketch.
BINS = 4096
#: Documents whose sketches make one dense block of bounds in a task.
DOC_BLOCK = 512
#: Queries that go to the tasks together; a larger query set is run block by block.
QUERY_BLOCK = 512
#: Distinct terms whose coordinate and weight a task keeps at once.
CACHE = 1 << 20


_TERM = re.compile(TERM)
_FOLD = str.maketrans(UPPER, LOWER)


def terms_in(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_FOLD))


def coordinate(term: str, bins: int) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) % bins


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000.0 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _statistics(vocabulary: set[str]):
    """Partial sums per batch: a row per query term with the number of documents holding it, and a row with null term holding the
    number of documents with terms and the number of their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            n_docs = n_all = 0
            for text in batch.column("text").to_pylist():
                found = terms_in(text)
                if found:
                    n_docs += 1
                    n_all += len(found)
                    held.update(vocabulary.intersection(found))
            terms, counts = [None, *held], [n_docs, *held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64()),
                                              pa.array([n_all] + [0] * len(held), pa.int64())], ["t", "c", "l"])
    return run


def _search(block: list[tuple], df: dict[str, int], n_docs: int, n_all: int, bins: int, k: int):
    """A function for ``mapInArrow``: the task's k best documents for each query of ``block`` = [(q, item_id, [(term, c)])]."""
    n_q = len(block)
    weights = np.zeros((n_q, bins))
    for i, (_, _, terms) in enumerate(block):
        for term, c in terms:
            weights[i, coordinate(term, bins)] += c
    w_of = {t: weight(n_docs, d) for t, d in df.items()}
    w_top = weight(n_docs, 1) if n_docs else 0  # the largest weight any term can have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(n_q)]  # min-heaps of (score, -doc_id or -2**64 for null, doc_id)
        known: dict[str, tuple[int, int]] = {}  # term -> (coordinate, weight) seen in this task, cleared beyond CACHE terms

        def look(t: str) -> tuple[int, int]:
            got = known.get(t)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = known[t] = (coordinate(t, bins), w_of.get(t, w_top))
            return got

        for batch in batches:
            texts, all_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a in range(0, len(texts), DOC_BLOCK):
                ids = all_ids[a:a + DOC_BLOCK]
                sk = np.zeros((len(ids), bins))
                exact: list[dict[str, int]] = []
                rows, cells, values = [], [], []
                for j, text in enumerate(texts[a:a + DOC_BLOCK]):
                    tf = Counter(terms_in(text))
                    n = sum(tf.values())
                    mine = {}
                    if n:
                        m = 100 - B_PERCENT + (B_PERCENT * n * n_docs) // n_all
                        size = len(tf)
                        counts = np.fromiter(tf.values(), np.int64, size)
                        info = np.fromiter((v for t in tf for v in look(t)), np.int64, 2 * size)
                        rows.append(np.full(size, j, np.int64))
                        cells.append(info[0::2])
                        values.append(info[1::2] * ((1000000000 * counts) // (1000 * counts + 12 * m)))
                        for t in tf.keys() & w_of.keys():
                            c = tf[t]
                            mine[t] = w_of[t] * ((1000000000 * c) // (1000 * c + 12 * m))
                    exact.append(mine)
                if rows:
                    np.maximum.at(sk, (np.concatenate(rows), np.concatenate(cells)), np.concatenate(values).astype(float))
                bound = weights @ sk.T * (1 + 1e-12) + 1  # exact below 2**53; the margin covers rounding above
                for i, (_, _, qterms) in enumerate(block):
                    row = bound[i]
                    floor = best[i][0][0] if len(best[i]) == k else 0
                    cand = np.flatnonzero(row > floor)
                    for j in cand[np.argsort(-row[cand], kind="stable")]:
                        if len(best[i]) == k and row[j] < best[i][0][0]:
                            break
                        score = sum(c * exact[j].get(t, 0) for t, c in qterms)
                        if score <= 0:
                            continue
                        d = ids[j]
                        key = (score, -d if d is not None else -(1 << 64), d)  # larger is better: score, then smaller id, null last
                        if len(best[i]) < k:
                            heapq.heappush(best[i], key)
                        elif key > best[i][0]:
                            heapq.heapreplace(best[i], key)
        out = [(q, item, d, score) for i, (q, item, _) in enumerate(block) for score, _, d in best[i]]
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["_q", "item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, queries: DataFrame, k: int = 20, bins: int = BINS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query's k best documents with a score above 0 (see the module's text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the stated query set, numbered; it goes to the driver and to the tasks QUERY_BLOCK queries at a time
    q = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).collect()
    parsed = [(i, r["item_id"], sorted(Counter(terms_in(r["text"])).items())) for i, r in enumerate(q)]
    vocabulary = {t for _, _, ts in parsed for t, _ in ts}
    # one scan: df of the query terms and the totals, summed per batch in the tasks, then per term (bounded by the query set)
    stats = texts.mapInArrow(_statistics(vocabulary), "t string, c long, l long").groupBy("t").agg(
        F.sum("c").alias("c"), F.sum("l").alias("l")).collect()
    df = {r["t"]: r["c"] for r in stats if r["t"] is not None}
    whole = [r for r in stats if r["t"] is None]
    totals = {"n_docs": whole[0]["c"] if whole else 0, "n_all": whole[0]["l"] if whole else 0}
    parts = []
    for b in range(0, len(parsed), QUERY_BLOCK):
        block = [p for p in parsed[b:b + QUERY_BLOCK] if p[2]]
        if block and totals["n_docs"]:
            parts.append(texts.mapInArrow(_search(block, df, totals["n_docs"], totals["n_all"], bins, k),
                                          "_q long, item_id long, doc_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", F.col("rank").cast("int"), "doc_id", "score")
