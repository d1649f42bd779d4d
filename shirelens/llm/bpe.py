"""Byte-level BPE by replaying merges over a corpus of words.

The distinct words of a batch of documents are one long array of byte symbols with links to their neighbours.  An inverted index
from the rank of a token pair to its positions is built once; ranks are then applied in order, each at all its positions
in all words, and every merge looks up only the two pairs that it creates.  A pair whose joined bytes rank lower than the
merge just made (rank tables allow that) sends its word back to the lower rank first, so each word sees its merges in the
order of the lowest rank, leftmost first.  Words are independent of each other, so batches and tasks may be cut anywhere;
a bounded memory of words already encoded is kept by each Python worker.

Defined results: null and empty texts have no ids and decode to no bytes; a null id is kept; repeated rows are encoded each;
a word of any length takes time in proportion to length times its logarithm.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Distinct words whose ids a Python worker remembers.
WORD_CACHE = 500_000
#: Bytes of distinct new words replayed together.
REPLAY_BYTES = 1 << 21
_STATE: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one rank table and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    @classmethod
    def shared(cls, path: str, pattern: str) -> "Codec":
        if _STATE.get("key") != (path, pattern):
            _STATE.update(key=(path, pattern), codec=cls(path, pattern))
        return _STATE["codec"]

    def _rank(self, a: int, b: int) -> int:
        pair = (a, b)
        r = self.joined.get(pair)
        if r is None:
            r = self.joined[pair] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        ranks, rank = self.ranks, self._rank
        one = [ranks[bytes([b])] for b in range(256)]
        symbol = [one[b] for b in b"".join(words)]
        ends = np.cumsum([len(w) for w in words]).tolist()
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends:  # links stop at the ends of words
            if e:
                after[e - 1] = -1
            if e < n:
                before[e] = -1
        pair = [-1] * n  # rank of the pair that starts here
        index: dict[int, list[int]] = {}
        for p in range(n - 1):
            if after[p] >= 0:
                r = rank(symbol[p], symbol[p + 1])
                if r >= 0:
                    pair[p] = r
                    index.setdefault(r, []).append(p)
        queue = list(index)
        heapq.heapify(queue)
        ends_array = np.array(ends)
        while queue:
            r = heapq.heappop(queue)
            at = index.pop(r, None)
            if at is None:
                continue
            at.sort()
            wait_until = -1  # positions before this belong to a word that has a lower merge to do first
            for p in at:
                if pair[p] != r:
                    continue
                if p < wait_until:
                    if r not in index:
                        heapq.heappush(queue, r)
                    index.setdefault(r, []).append(p)
                    continue
                q = after[p]
                symbol[p], pair[q] = r, -1
                nxt = after[p] = after[q]
                after[q] = -2
                made = -1
                if nxt >= 0:
                    before[nxt] = p
                    made = rank(r, symbol[nxt])
                pair[p] = made
                lowest = made if made >= 0 else n + len(ranks)
                if made >= 0:
                    if made not in index:
                        heapq.heappush(queue, made)
                    index.setdefault(made, []).append(p)
                b = before[p]
                if b >= 0:
                    made = pair[b] = rank(symbol[b], r)
                    if made >= 0:
                        lowest = min(lowest, made)
                        if made not in index:
                            heapq.heappush(queue, made)
                        index.setdefault(made, []).append(b)
                if lowest <= r:
                    wait_until = int(ends_array[np.searchsorted(ends_array, p, "right")])
        out, start = [], 0
        for e in ends:
            ids, p = [], start if e > start else -1
            while p >= 0:
                ids.append(symbol[p])
                p = after[p]
            out.append(ids)
            start = e
        return out

    def _learn(self, new: list[str]) -> None:
        held, size = [], 0
        for i, w in enumerate(new):
            held.append(w)
            size += len(w)
            if size >= REPLAY_BYTES or i == len(new) - 1:
                for word, ids in zip(held, self.replay([x.encode() for x in held])):
                    self.known[word] = (array("I", ids).tobytes(), " ".join(map(str, ids)))
                held, size = [], 0

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, and the same as decimals joined by spaces."""
        split = [self.split(t) for t in texts]
        if len(self.known) > WORD_CACHE:
            self.known.clear()
            self.joined.clear()
        known = self.known
        new = set().union(*split).difference(known) if split else set()
        self._learn(sorted(new))
        out = []
        for words in split:
            got = [known[w] for w in words]
            out.append((np.frombuffer(b"".join([g[0] for g in got]), np.uint32), " ".join([g[1] for g in got])))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _texts(batch: pa.RecordBatch, rows: int = 512):
    for lo in range(0, batch.num_rows, rows):
        yield batch.column("id")[lo:lo + rows], [t or "" for t in batch.column("text")[lo:lo + rows].to_pylist()]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, ids array<int>)``."""
    def run(batches):
        codec = Codec.shared(path, pattern)
        for batch in batches:
            for ids, texts in _texts(batch):
                got = [e.astype(np.int32) for e, _ in codec.encode(texts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(got, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return _slim(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(<id_col>, bytes binary)``; null ids decode to no bytes."""
    def run(batches):
        codec = Codec.shared(path, pattern)
        for batch in batches:
            got = [codec.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(got, pa.binary())], names=[id_col, "bytes"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(run, f"`{id_col}` long, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_tokens, ids_sha256, decoded_sha256)``: encodes and decodes within one task, so that ids need not travel."""
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        codec = Codec.shared(path, pattern)
        for batch in batches:
            for ids, texts in _texts(batch):
                got = codec.encode(texts)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([len(e) for e, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in got], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(e)).hexdigest() for e, _ in got], pa.string())], names=names)

    return _slim(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
