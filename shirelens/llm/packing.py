"""Best-fit packing of token sequences by linear grouping.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.  What is planned afterwards is the histogram of piece
lengths: at most ``capacity`` counters, whatever the number of documents.

1. Large lengths (over ``capacity`` divided by a small number) are sorted and cut into ``GROUPS`` groups of equal cardinality; each length
   is rounded up to the largest of its group.
2. For these few sizes a configuration program (how many sequences of each pattern of sizes) is optimised by column
   generation: a linear program over the patterns found so far, and a knapsack that proposes the pattern most worth adding.
3. Actual lengths take the places of the rounded ones.  Places and lengths are runs (a pattern times a count, a length times
   a count), so this is a merge of runs, not a loop over documents.
4. What the rounded-down program left over and all small pieces go, longest first, each to the fullest sequence it fits.

The plan is a table of runs: "pieces of length l with ranks [a, b) fill sequences from s on, at offset o".  Its size depends on the
capacity and the number of groups alone, so it is small enough for every task.  Pieces are ranked within their length by
counts per bucket and a cumulative sum, so a length that a third of the pieces have is not ranked in one task.

Defined results: null and empty texts have no ids but still the separator, so they are one piece of one token; only
documents over the capacity are cut; repeated rows are packed as often as they occur; a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize

CAPACITY = 2048
SEPARATOR = 0
GROUPS = 24
#: Pieces longer than a capacity divided by this are large; each is tried and the plan with the fewest sequences stays.
SMALL_PARTS = (2, 3, 4)
#: Distinct words whose ids a Python worker remembers: those met lately, and as many met before them.
WORD_CACHE = 100_000
#: Pieces ranked together in a task.
RANK_ROWS = 100_000

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long")
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])
_STATE: dict = {}
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Byte-level vocabularies write bytes that are no printable Latin-1 character as characters from 256 on, in order.
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class WordTokenizer:
    """Ids of texts under a vocabulary whose words never span ASCII white space, word by word with a bounded memory.

    The vocabulary's own library encodes every distinct word; a text is the sequence of its words' ids.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> "WordTokenizer":
        """One per Python worker, which lives for many tasks."""
        if _STATE.get("path") != path:
            _STATE.update(path=path, tokenizer=cls(path))
        return _STATE["tokenizer"]

    def _learn(self, new: list[bytes]) -> None:
        """Ids of words not seen before.

        Normalising a word of Latin-1 letters is lower-casing it, and it is one piece under the vocabulary's split, so it goes
        to the merges directly, its bytes written as the vocabulary writes them; any other word takes the library's whole path.
        """
        other = []
        for w in new:
            text = w.decode("utf-8", "replace")
            if _LETTERS.fullmatch(text):
                text = text.lower()
                merged = self.lib.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARS))
                self.known[w] = array("I", [t.id for t in merged]).tobytes()
            else:
                other.append((w, text))
        got = self.lib.encode_batch_fast([t for _, t in other], add_special_tokens=False)
        self.known.update((w, array("I", e.ids).tobytes()) for (w, _), e in zip(other, got))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text.  ASCII letters are folded first, as the vocabulary does."""
        split = [t.lower().split() for t in texts]
        if len(self.known) > WORD_CACHE:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        missing = set().union(*split).difference(known) if split else set()
        again = missing & before.keys() if before else set()
        known.update((w, before[w]) for w in again)
        missing -= again
        # a final full stop or comma after a letter is a word of its own under the vocabulary: learn the stem once
        tails = {w: (w[:-1], w[-1:]) for w in missing if w[-1:] in (b".", b",") and w[-2:-1].isalpha()}
        need = (missing - tails.keys()) | {p for pair in tails.values() for p in pair}
        self._learn([w for w in need if w not in known])
        for w, (stem, tail) in tails.items():
            known[w] = known[stem] + known[tail]
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4") for ws in split]


def tokenize(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
             separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _PIECES

    def run(batches):
        tok = WordTokenizer.shared(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for lo in range(0, batch.num_rows, 256):
                part = [(x.as_py() or "").encode() for x in texts[lo:lo + 256]]
                out: list[list] = [[] for _ in schema]
                for doc, enc in zip(ids[lo:lo + 256].to_pylist(), tok.encode(part)):
                    enc = np.append(enc, np.uint32(separator)).astype("<u4")
                    for k, start in enumerate(range(0, len(enc), capacity)):
                        cut = enc[start:start + capacity]
                        row = [doc, k, start, len(cut), zlib.crc32(cut.tobytes())] + ([cut.astype(np.int32)] if with_ids else [])
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# --- the plan, over counts of lengths ----------------------------------------------------------------------------------

def linear_groups(counts: np.ndarray, smallest: int, groups: int) -> list[list[tuple[int, int]]]:
    """Large lengths, longest first, in ``groups`` runs of equal cardinality: lists of (length, count)."""
    left = [(int(n), int(counts[n])) for n in range(len(counts) - 1, smallest - 1, -1) if counts[n]]
    total = sum(c for _, c in left)
    out: list[list[tuple[int, int]]] = []
    for g in range(min(groups, total)):
        want = total * (g + 1) // min(groups, total) - total * g // min(groups, total)
        part = []
        while want:
            n, c = left[0]
            take = min(c, want)
            part.append((n, take))
            want -= take
            left[0] = (n, c - take)
            if left[0][1] == 0:
                left.pop(0)
        out.append(part)
    return out


def _simplex_master(patterns: np.ndarray, demand: np.ndarray, basis: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the basic patterns and the prices of the sizes."""
    b = patterns[:, basis].astype(float)
    return np.linalg.solve(b, demand), np.linalg.solve(b.T, np.ones(len(basis)))


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack: the pattern within the capacity whose sizes are worth most."""
    worth = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        worth[c], chosen[c] = worth[c - 1], -1
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            value = worth[c - sizes[fits]] + prices[fits]
            k = int(np.argmax(value))
            if value[k] > worth[c] + 1e-12:
                worth[c], chosen[c] = value[k], fits[k]
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            out[chosen[c]] += 1
            c -= int(sizes[chosen[c]])
    return worth[capacity], out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) for few sizes: column generation, rounded down; what is left of the demand is not covered."""
    k = len(sizes)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    basis = list(range(k))
    for _ in range(rounds):
        x, prices = _simplex_master(patterns, demand, basis)
        value, new = _best_pattern(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(patterns[:, basis].astype(float), new.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        patterns = np.column_stack([patterns, new])
        basis[leave] = patterns.shape[1] - 1
    x, _ = _simplex_master(patterns, demand, basis)
    return [(patterns[:, j], int(v + 1e-9)) for j, v in zip(basis, x) if int(v + 1e-9)]


class _Bins:
    """Runs of sequences alike: for each free room the runs (first sequence, count)."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.fullest = np.zeros(capacity + 1, bool)
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, pieces, sequence, pieces each, offset
        self.rank = np.zeros(capacity + 1, np.int64)

    def place(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((length, int(self.rank[length]), pieces, sequence, each, offset))
        self.rank[length] += pieces

    def keep(self, room: int, first: int, count: int) -> None:
        if room > 0 and count:
            self.by_room[room].append((first, count))
            self.fullest[room] = True

    def best_fit(self, length: int, pieces: int) -> None:
        while pieces:
            open_rooms = np.flatnonzero(self.fullest[length:])
            if len(open_rooms):
                room = int(open_rooms[0]) + length
                first, count = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.fullest[room] = False
            else:
                # new sequences only as far as they are needed
                room, first = self.capacity, self.next
                count = -(-pieces // (self.capacity // length))
                self.next += count
            each = room // length
            full = min(count, pieces // each)
            if full:
                self.place(length, full * each, first, each, self.capacity - room)
                self.keep(room - each * length, first, full)
                pieces -= full * each
            rest = pieces if full < count else 0
            if rest and rest < each:
                self.place(length, rest, first + full, rest, self.capacity - room)
                self.keep(room - rest * length, first + full, 1)
                pieces, full = 0, full + 1
            self.keep(room, first + full, count - full)


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, offset) and the number of sequences."""
    return min((_plan(counts, capacity, groups, capacity // part) for part in SMALL_PARTS), key=lambda x: x[1])


def _plan(counts: np.ndarray, capacity: int, groups: int, small: int) -> tuple[list[tuple], int]:
    bins = _Bins(capacity)
    left = counts.astype(np.int64).copy()
    if left[capacity]:
        bins.place(capacity, int(left[capacity]), 0, 1, 0)
        bins.next, left[capacity] = int(left[capacity]), 0
    grouped = linear_groups(left, small + 1, groups)
    if grouped:
        merged: dict[int, list[tuple[int, int]]] = {}
        for part in grouped:  # groups of one rounded size are one size
            merged.setdefault(part[0][0], []).extend(part)
        sizes = np.array(list(merged))
        demand = np.array([sum(c for _, c in p) for p in merged.values()], float)
        queues = [list(p) for p in merged.values()]
        for pattern, times in configurations(sizes, demand, capacity):
            while times > 0:
                # the longest run of sequences whose every place gets one and the same actual length
                slots, run = [], times
                for g in np.flatnonzero(pattern):
                    need, at, got = int(pattern[g]), 0, []
                    queue = queues[g]
                    while need and at < len(queue):
                        n, c = queue[at]
                        take = min(need, c)
                        got.append((n, take, c))
                        need -= take
                        at += 1
                    for n, take, c in got:
                        slots.append((g, n, take))
                        run = min(run, c // take)
                if not slots:
                    break
                room = capacity
                for g, n, take in slots:
                    bins.place(n, take * run, bins.next, take, capacity - room)
                    room -= n * take
                    left[n] -= take * run
                    want, kept = take * run, []
                    for m, c in queues[g]:
                        used = min(c, want) if m == n else 0
                        want -= used
                        if c - used:
                            kept.append((m, c - used))
                    queues[g] = kept
                bins.keep(room, bins.next, run)
                bins.next += run
                times -= run
    for n in range(capacity, 0, -1):
        if left[n]:
            bins.best_fit(n, int(left[n]))
    return bins.runs, bins.next


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (a column ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    rows = materialize(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    total = rows.count()
    buckets = max(1, -(-total // RANK_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_uid"), F.lit(buckets)).cast("int"))
    cells = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    runs, _ = plan(counts, capacity, groups)
    table = sorted(runs) or [(0, 0, 0, 0, 1, 0)]
    length, rank, number, sequence, each, offset = (np.array(x, np.int64) for x in zip(*table))
    key = length * (1 << 45) + rank

    # one row per length and bucket, so this window is far smaller than the pieces
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = cells.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("_uid")) - 1
    ranked = rows.withColumn("_place", place).join(starts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", (F.col("_place") + F.col("_before")).cast("long"))

    def locate(batches):
        for batch in batches:
            n, r = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            at = np.searchsorted(key, n * (1 << 45) + r, "right") - 1
            k = r - rank[at]
            seq, off = sequence[at] + k // each[at], offset[at] + k % each[at] * n
            keep = [c for c in batch.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(seq), pa.array(off)],
                                             names=keep + ["sequence_id", "offset"])

    columns = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*columns, "_rank").mapInArrow(locate, fields + ", sequence_id long, offset long")
