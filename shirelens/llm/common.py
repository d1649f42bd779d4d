"""Helpers shared by the text operators: columns of text as byte buffers, word and n-gram hashes, bounded tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

U64 = np.uint64
#: Bytes of text handled at once inside a task; a longer text is a chunk of its own.
CHUNK = 1 << 19
#: Bytes of a batch that goes to Python.
BATCH = 8 << 20

_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = U64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python hold a few megabytes, however long the texts; by default it is as many rows as there are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(id_col: str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all 64."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


#: One random value per byte, by rule; upper-case ASCII letters share the value of their lower-case form in FOLDED.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * _GOLD)
FOLDED = BYTE_VALUES.copy()
FOLDED[65:91] = BYTE_VALUES[97:123]
#: [\x20\x09-\x0D]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASES = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))


def powers(base: int | U64, n: int) -> np.ndarray:
    out = np.full(n, U64(base), U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of each hash base and of its inverse, grown on demand."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def get(cls, n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
        if family not in cls.known or len(cls.known[family][0]) < n:
            base, size = _BASES[family], max(n, CHUNK + 4096)
            cls.known[family] = powers(base, size), powers(pow(int(base), -1, 1 << 64), size)
        return cls.known[family]


def prefix_hashes(values: np.ndarray, family: int = 0) -> np.ndarray:
    """P[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    up, _ = _Powers.get(len(values) + 1, family)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """Position-independent polynomial hash of each [start, end)."""
    _, down = _Powers.get(len(prefix), family)
    return (prefix[end] - prefix[start]) * down[start]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
        kind = np.int64
    else:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct 64-bit hashes of ``width`` words in sequence, A-Z folded.

    A row with fewer words has one shingle, the whole sequence; a row without words has none.
    """
    start, end, row = words(data, offsets)
    h = mix(range_hash(prefix_hashes(FOLDED[data]), start, end) + U64(1)) if len(start) else np.zeros(0, U64)
    n_rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    m = len(h) - width + 1
    combined = np.zeros(max(m, 0), U64)
    for k in range(width):
        combined = (combined + h[k:k + m] if m > 0 else combined) * _BASES[0]
    combined = mix(combined)
    for i in range(n_rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            s = np.sort(combined[a:b - width + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield s
        elif b > a:
            acc = U64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    acc = (acc + x) * _BASES[0]
            yield mix(np.array([acc], U64))
        else:
            yield np.zeros(0, U64)


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of groups so that each holds about ``per_task`` rows, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def with_row_uid(df: DataFrame, name: str) -> DataFrame:
    """A number per row; the result must be written before it is read twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def sum_of_arrays(parts: DataFrame, size: int, pieces: int = 64) -> np.ndarray:
    """Element-wise sum of the ``counts`` (deflated int64 slices) of every ``piece``; ``size`` is fixed by a parameter.

    The slices of one piece are added up in a task, in the order they arrive, so that a task holds two slices at a time.
    """
    import zlib

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("counts"):
                x = np.frombuffer(zlib.decompress(raw.as_py()), np.uint32).astype(np.int64)
                total = x if total is None else total + x
        yield pa.RecordBatch.from_pydict({"piece": [key[0].as_py()], "counts": [total.tobytes()]},
                                         schema=pa.schema([("piece", pa.int32()), ("counts", pa.binary())]))

    out = np.zeros(size, np.int64)
    step = size // pieces
    for r in parts.groupBy("piece").applyInArrow(add, "piece int, counts binary").toLocalIterator():
        out[r["piece"] * step:(r["piece"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
    return out


def any_of_bitmaps(parts: DataFrame) -> np.ndarray:
    """Bitwise OR of the ``bits`` (deflated slices of a bitmap) of every ``piece``; only the packed bits go to the driver."""
    import zlib

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("bits"):
                x = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
                total = x if total is None else total | x
        yield pa.RecordBatch.from_pydict({"piece": [key[0].as_py()], "bits": [total.tobytes()]},
                                         schema=pa.schema([("piece", pa.int32()), ("bits", pa.binary())]))

    got = parts.groupBy("piece").applyInArrow(add, "piece int, bits binary").collect()
    return np.frombuffer(b"".join(bytes(r["bits"]) for r in sorted(got, key=lambda r: r["piece"])), np.uint8)


def bitmap_pieces(flags: np.ndarray, pieces: int = 64) -> pa.RecordBatch:
    """One task's flags as rows of ``any_of_bitmaps``."""
    import zlib

    rows = [zlib.compress(x.tobytes(), 1) for x in np.split(np.packbits(flags), pieces)]
    return pa.RecordBatch.from_pydict({"piece": pa.array(range(pieces), pa.int32()), "bits": pa.array(rows, pa.binary())})


def array_pieces(counts: np.ndarray, pieces: int = 64) -> pa.RecordBatch:
    """One task's counts as rows of ``sum_of_arrays``."""
    import zlib

    step = len(counts) // pieces
    rows = [zlib.compress(np.ascontiguousarray(counts[i * step:(i + 1) * step], np.uint32), 1) for i in range(pieces)]
    return pa.RecordBatch.from_pydict({"piece": pa.array(range(pieces), pa.int32()), "counts": pa.array(rows, pa.binary())})


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of complete groups, from batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        at = int(np.argmax(k == k[-1]))  # where the last group begins
        same = bool(held) and held[-1].column(key)[0].as_py() == k[-1]
        if at or (held and not same):
            yield pa.Table.from_batches([*held, *([batch.slice(0, at)] if at else [])])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def boundaries(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


class Links:
    """Union-find over positions; roots are the smallest positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def by_part(df: DataFrame, key: str = "part") -> DataFrame:
    """Rows dealt out by ``key``, equal keys one after the other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


#: Bits of the bitmap of ``maybe_in``.
FILTER_BITS = 22


def maybe_in(keys: DataFrame, column: str, invert: bool = False):
    """For ``mapInArrow``: passes every row whose ``column`` is among ``keys``, and few others; ``invert`` passes the rest.

    The keys become a bitmap of fixed size.  It thins a shuffle and decides nothing: what it lets through is joined as usual.
    """
    def run(batches):
        there = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            there[_cell(batch.column(0))] = True
        yield bitmap_pieces(there)

    def _cell(values: pa.Array) -> np.ndarray:
        return (mix(np.asarray(values).astype(np.int64).view(U64)) >> U64(64 - FILTER_BITS)).astype(np.int64)

    there = any_of_bitmaps(keys.select(column).mapInArrow(run, "piece int, bits binary"))
    # no keys: no task, no pieces
    bits = keys.sparkSession.sparkContext.broadcast(there if len(there) else np.zeros((1 << FILTER_BITS) // 8, np.uint8))  # 2**FILTER_BITS bits

    def passes(batches):
        seen = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(seen[_cell(batch.column(column))] != invert))

    return passes
