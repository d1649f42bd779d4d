"""Exact deduplication: sorted runs of digests, merged along a tree.

Every partition turns its rows into one sorted run per digest range: an entry per distinct digest with the row to keep
and the number of rows.  In round r the runs whose number agrees above the lowest r * FAN_BITS bits meet and are merged
many ways; entries of one digest become one, verified by the full digest and the length of the text.  The digest space is
split into ranges of a bounded number of entries beforehand, so the root of each tree is bounded too, and a digest that
a third of the rows share has one entry per run however many rows stand behind it.

Defined results: a null text counts as empty; empty texts equal each other; of tied rows the smallest id stays, rows with the
same id and length being interchangeable (one of them is reported as kept); a null id comes after all others, and where only null ids share a
text ``keep_id`` is null; an empty table gives no rows; other columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import tasks_for

#: Runs merged at once: 2**FAN_BITS.
FAN_BITS = 4
#: Entries of a range at the root of its tree, on average.
RANGE_ROWS = 200_000
#: Entry of a run: digest as four numbers (their order is that of its bytes), length of the compared text, then the row to
#: keep (code points, null flag, id, row number) and the rows counted.
ENTRY = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("size", "<i8"), ("cp", "<i8"), ("noid", "<i8"),
                  ("id", "<i8"), ("uid", "<i8"), ("n", "<i8")])
RUN = "range int, run long, entries binary"
_RUN = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("entries", pa.binary())])


def normalized(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def merge_runs(entries: np.ndarray) -> np.ndarray:
    """Entries of several runs as one sorted run; entries of one digest become one.

    The order is digest, compared length, then preference, so the first entry of each digest is the row to keep.
    """
    if not len(entries):
        return entries
    order = np.lexsort([entries[k] for k in ("uid", "id", "noid")] + [-entries["cp"], entries["size"]]
                       + [entries[k] for k in ("d3", "d2", "d1", "d0")])
    e = entries[order]
    new = np.ones(len(e), bool)
    # verified: all 256 bits and the length agree, not just the leading word that ranges are cut by
    new[1:] = np.logical_or.reduce([e[k][1:] != e[k][:-1] for k in ("d0", "d1", "d2", "d3", "size")])
    at = np.flatnonzero(new)
    out = e[at].copy()
    out["n"] = np.add.reduceat(e["n"], at)
    return out


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, ENTRY)
    if batch.num_rows:
        raw = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
        for k in range(4):
            out[f"d{k}"] = raw[:, k]
    ids = batch.column("id")
    out["noid"] = np.asarray(ids.is_null())
    out["id"] = np.asarray(ids.fill_null(0))
    for k in ("size", "cp", "uid"):
        out[k] = np.asarray(batch.column(k))
    out["n"] = 1
    return out


def _first_runs(ranges: int):
    """One task's rows as a run per digest range, numbered by the task's first row."""

    def make(batches):
        held, rows, number = np.zeros(0, ENTRY), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("uid")[0].as_py() >> 33 if number is None else number
            rows.append(_rows_of(batch))
            if sum(map(len, rows)) > RANGE_ROWS:
                held, rows = merge_runs(np.concatenate([held, *rows])), []
                if len(held) > 4 * RANGE_ROWS:  # a task's memory stays bounded: send what is there as runs
                    yield from _cut(held, ranges, number)
                    held = np.zeros(0, ENTRY)
        if rows or len(held):
            yield from _cut(merge_runs(np.concatenate([held, *rows])), ranges, number)

    return make


def _cut(run: np.ndarray, ranges: int, number: int):
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(run["d0"].astype(np.uint64), edges).tolist(), len(run)]
    parts = [(k, run[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    yield pa.RecordBatch.from_pydict({"range": [k for k, _ in parts], "run": [number] * len(parts), "entries": [e for _, e in parts]},
                                     schema=_RUN)


def _merge_round(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of a range whose numbers meet in this round, as one run."""
    held = np.zeros(0, ENTRY)
    for batch in batches:
        got = [np.frombuffer(x.as_py(), ENTRY) for x in batch.column("entries")]
        held = merge_runs(np.concatenate([held, *got]))
    yield pa.RecordBatch.from_pydict({"range": [key[0].as_py()], "run": [key[1].as_py()], "entries": [held.tobytes()]}, schema=_RUN)


_TABLE = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("keep_cp", pa.int64()),
                    ("group_size", pa.int64())])


def _unpack(batches):
    for batch in batches:
        for raw in batch.column("entries"):
            e = np.frombuffer(raw.as_py(), ENTRY)
            digests = np.stack([e[f"d{k}"] for k in range(4)], axis=1).astype(">u8")
            yield pa.RecordBatch.from_arrays([
                pa.array([d.tobytes() for d in digests], pa.binary()), pa.array(e["id"], pa.int64(), mask=e["noid"] == 1),
                pa.array(e["uid"], pa.int64()), pa.array(e["cp"], pa.int64()), pa.array(e["n"], pa.int64())], schema=_TABLE)


def _merge_last(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last round unpacks what it merged, so that a task needs one Python worker and not two."""
    yield from _unpack(_merge_round(key, batches))


def tree_merge(rows: DataFrame) -> DataFrame:
    """``(digest, keep_id, keep_uid, keep_cp, group_size)`` for ``(id, uid, digest, size, cp)`` of a written table."""
    spark = rows.sparkSession
    ranges = tasks_for(spark, rows.count(), RANGE_ROWS)
    runs = rows.mapInArrow(_first_runs(ranges), RUN)
    sources = 1 + (rows.agg(F.max(F.shiftright("uid", 33))).first()[0] or 0)
    while True:
        met = runs.withColumn("run", F.shiftright("run", FAN_BITS)).groupBy("range", "run")
        sources = -(-sources // (1 << FAN_BITS))
        if sources <= 1:
            return met.applyInArrow(_merge_last, "digest binary, keep_id long, keep_uid long, keep_cp long, group_size long")
        runs = met.applyInArrow(_merge_round, RUN)


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = normalized(F.col(text_col))
    return materialize(df.select(
        F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), F.unhex(F.sha2(plain, 256)).alias("digest"),
        F.octet_length(plain).cast("long").alias("size"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("cp")),
        "digests")


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, keep_id, group_size, kept, text_sha256)`` per row of ``df``, dropped rows too."""
    rows = _slim(df, id_col, text_col)
    groups = materialize(tree_merge(rows), "digest-groups")
    return rows.join(groups, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, one per normalised text.

    The join back is by digest, length and id together, so that the copies of one text are spread over the tasks.
    """
    best = tree_merge(_slim(df, id_col, text_col))
    key = ["_keep_digest", "_keep_cp", "_keep_id", "_keep_null"]
    ident = lambda c: [F.coalesce(c, F.lit(0)), c.isNull()]
    best = best.select(*[c.alias(k) for c, k in zip([F.col("digest"), F.col("keep_cp"), *ident(F.col("keep_id"))], key)])
    own = [F.unhex(F.sha2(normalized(F.col(text_col)), 256)), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"),
           *ident(F.col(id_col).cast("long"))]
    rows = df.select("*", *[c.alias(k) for c, k in zip(own, key)]).join(best, key, "left_semi")
    return rows.dropDuplicates(key).drop(*key)
