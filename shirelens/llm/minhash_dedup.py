"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Each document's set of distinct word shingles is hashed to 64 bits.  Its sketch of ``SKETCH`` coordinates is filled in rounds (Dahlgaard,
Knudsen and Thorup 2017): in round i every element is placed into one bin with the value ``i + u``, u uniform in [0, 1); an element's
bins over the first ``SKETCH`` rounds are a permutation, so every bin of a non-empty set is filled after at most ``SKETCH`` rounds, and the
rounds stop once no later round can lower a bin, after about one round for a large set.  Bands of ``ROWS`` coordinates are hashed; two sets
of Jaccard similarity s meet in some band with probability 1 - (1 - s^ROWS)^BANDS (at s = 0.8 all but 5e-8).

Documents with identical sets are first reduced to one representative (equal sets are those with equal SHA-256 digests of the whole
sorted set, so no set is shuffled for them).  In every
band bucket of representatives each member is first verified on the full sets against the bucket's smallest member (a star, so a bucket of a
third of all documents is n pairs, not n^2).  Two members may link although neither links with that member, so every bucket that still holds
several components after the stars is taken up again: all its pairs across components whose sizes and sketches allow the threshold form
families, and within a family these pairs are verified on the full sets, in blocks of ``BLOCK`` rows against ``BLOCK`` rows.  Members of
the largest component there meet only those outside it.  Verified
links and equal sets make a graph whose components come from ``connected_components``.

Defined results: words are maximal runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a document's set is its distinct ``width``-word
shingles, or the whole word sequence as one shingle when it has fewer words; a null or wordless text has an empty set, links with nothing
and is its own component; component_id is the smallest non-null doc_id of the component (null if it has none); kept is
``doc_id <=> component_id`` (so repeated rows of the smallest id are all kept); every row is its own document; an empty table gives an
empty result.  Links are found by banding: a pair at the threshold is missed with the probability above that it shares no band, and one of
``MISS`` that its sketches agree in too few coordinates; no verified link is ever dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..session import materialize
from .common import U64, Links, boundaries, bounded_batches, buffers, by_part, chunks, maybe_in, mix, shingles, whole_groups

#: Coordinates of a sketch (a power of two), and of one band.
SKETCH, ROWS = 128, 4
BANDS = SKETCH // ROWS
#: Rows of one side of a block of pairs.
BLOCK = 512
#: Probability that the sketches of a pair at the threshold agree in fewer coordinates than ``least_agreement``.
MISS = 1e-9
_SALT_BIN, _SALT_VALUE, _SALT_BAND = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0)


def sketch(h: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes: per bin the smallest ``round << 32 | u32`` placed there."""
    out = np.full(size, np.iinfo(np.uint64).max, U64)
    if not len(h):
        return out
    g = mix(h ^ _SALT_BIN)
    first = (g & U64(size - 1)).astype(np.int64)
    step = (((g >> U64(20)) | U64(1)) & U64(size - 1)).astype(np.int64)  # odd, so the first ``size`` rounds visit every bin
    with np.errstate(over="ignore"):
        for i in range(size):
            bins = (first + i * step) & (size - 1)
            vals = (U64(i) << U64(32)) | (mix(h ^ (_SALT_VALUE + U64(i))) >> U64(32))
            np.minimum.at(out, bins, vals)
            if out.max() < (U64(i + 1) << U64(32)):
                break
    return out


def band_keys(sk: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ``ROWS`` coordinates, its band number mixed in."""
    rows = sk.reshape(BANDS, ROWS)
    acc = np.arange(BANDS, dtype=U64) * _SALT_BAND
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            acc = mix(acc ^ rows[:, j]) + U64(j + 1)
    return acc.view(np.int64)


def least_agreement(percent: int) -> int:
    """Coordinates in which the sketches of two sets at the threshold agree, but for a probability of at most ``MISS``."""
    p, below, c = percent / 100, 0.0, 0
    while (below := below + comb(SKETCH, c) * p ** c * (1 - p) ** (SKETCH - c)) <= MISS:
        c += 1
    return c


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            sets, bands, digests, sketches = [], [], [], []
            for a, b in chunks(offsets):
                for s in shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width):
                    sets.append(s.view(np.int64))
                    digests.append(hashlib.sha256(s.tobytes()).digest())  # of the whole sorted set
                    sk = sketch(s)
                    bands.append(band_keys(sk) if len(s) else np.zeros(0, np.int64))
                    sketches.append((sk & U64(255)).astype(np.uint8).tobytes())  # a byte per coordinate tells them apart but for 1 in 256
            yield pa.RecordBatch.from_arrays([
                batch.column("_rk"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(sets, pa.list_(pa.int64())), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                pa.array(sketches, pa.binary())], ["_rk", "doc_id", "n_shingles", "shingles", "digest", "bands", "sketch"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of row keys whose full sets reach the threshold."""
    left = sets.select(F.col("_rk").alias("a"), F.col("shingles").alias("sa"), F.col("n_shingles").alias("na"))
    right = sets.select(F.col("_rk").alias("b"), F.col("shingles").alias("sb"), F.col("n_shingles").alias("nb"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(F.lit(100) * inter >= F.lit(percent) * (F.col("na") + F.col("nb") - inter)).select("a", "b")


def _blocks(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows of each group dealt so that every two of them in different components meet in one ``gid``, of at most about twice ``BLOCK`` rows;
    ``cross`` is set where only rows of different ``side`` are to be paired there.

    Rows of a group's largest component meet only the rows outside it, so a component of n rows among m others costs about n * m / BLOCK
    rows and not the square of the group."""
    per_comp = rows.groupBy(*group, "comp").agg(F.count(F.lit(1)).alias("n"))
    sized = per_comp.groupBy(*group).agg(F.max(F.struct("n", "comp")).alias("_m"), F.sum("n").alias("_n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sized = sized.select(*group, F.col("_m.comp").alias("_major"), blocks(F.col("_m.n")).alias("_nm"),
                         blocks(F.col("_n") - F.col("_m.n")).alias("_nr")).where("_nr > 0")  # no others: nothing to pair
    major = F.col("comp") == F.col("_major")
    dealt = rows.join(sized, group).withColumn("_major", major).withColumn(
        "_own", F.pmod(F.xxhash64("_rk"), F.when(F.col("_major"), F.col("_nm")).otherwise(F.col("_nr"))).cast("int"))
    own, to = F.col("_own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda mixed, i, j: F.struct(F.lit(mixed).alias("mixed"), i.alias("i"), j.alias("j"))
    places = F.when(F.col("_major"), F.transform(to("_nr"), lambda j: place(True, own, j))).otherwise(F.concat(
        F.transform(to("_nm"), lambda i: place(True, i, own)),
        F.transform(to("_nr"), lambda o: place(False, F.least(own, o), F.greatest(own, o)))))
    dealt = dealt.withColumn("_at", F.explode(places))
    # two groups whose hashes collide only compare more pairs
    return dealt.withColumn("gid", F.xxhash64(*group, "_at.mixed", "_at.i", "_at.j")).withColumn(
        "side", F.when(F.col("_at.mixed"), F.col("_major").cast("int")).otherwise(own)).withColumn(
        "cross", F.col("_at.mixed") | (F.col("_at.i") != F.col("_at.j"))).drop("_major", "_nm", "_nr", "_own", "_at", *group)


def _possible(t: pa.Table, percent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a block, across components, whose sizes and sketches allow the threshold."""
    comp, n, side, cross = (t.column(c).to_numpy() for c in ("comp", "n_shingles", "side", "cross"))
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(n), SKETCH)
    may = np.triu(comp[:, None] != comp[None, :], 1) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
    if cross.all():
        may &= side[:, None] != side[None, :]
    i, j = np.nonzero(may)
    step = 1 << 15
    good = [np.count_nonzero(sk[i[k:k + step]] == sk[j[k:k + step]], axis=1) >= least for k in range(0, len(i), step)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


def _block_links(percent: int, exact: bool):
    """For ``mapInArrow`` over rows of ``_blocks``: links ``(a, b)`` that hold together what the block's pairs join, after the full sets
    reach the threshold (``exact``) or where sizes and sketches allow it."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "gid"):
            table = table.combine_chunks()
            ends = boundaries(table.column("gid").to_numpy())
            found_a, found_b = [], []
            for lo, hi in zip(ends[:-1], ends[1:]):
                t = table.slice(lo, hi - lo)
                i, j = _possible(t, percent, least)
                if not len(i):
                    continue
                rk, sets, joined = t.column("_rk").to_numpy(), None, Links(hi - lo)
                if exact:
                    lists = t.column("shingles").chunk(0)
                    flat, at = lists.flatten().to_numpy().view(U64), np.concatenate([[0], np.cumsum(t.column("n_shingles").to_numpy())])
                    sets = [flat[x:y] for x, y in zip(at[:-1], at[1:])]
                for x, y in zip(i.tolist(), j.tolist()):
                    if joined.root(x) == joined.root(y):
                        continue
                    if exact:
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both < percent * (len(sets[x]) + len(sets[y]) - both):
                            continue
                    joined.join(x, y)
                    found_a.append(int(rk[x]))
                    found_b.append(int(rk[y]))
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])
    return run


def _beyond_stars(stars: DataFrame, comps: DataFrame, filled: DataFrame, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` between members of one bucket in different components after the stars, ``comps`` of ``_rk, component``."""
    placed = stars.where(F.col("n") > 2).join(comps, "_rk", "left").withColumn("comp", F.coalesce("component", "_rk")).drop("component")
    still_open = placed.groupBy("band", "key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").drop("_lo", "_hi")
    members = materialize(placed.join(still_open, ["band", "key"]).select("_rk", "band", "key", "comp"), "minhash-open")
    light = members.join(filled.select("_rk", "n_shingles", "sketch"), "_rk")
    possible = materialize(by_part(_blocks(light, ["band", "key"]), "gid").mapInArrow(_block_links(percent, False), "a long, b long"),
                           "minhash-possible")
    family = connected_components(possible, "a", "b").select(F.col("node").alias("_rk"), F.col("component").alias("family"))
    family = materialize(family.join(members.select("_rk", "comp").distinct(), "_rk"), "minhash-families")
    schema = "_rk long, shingles array<long>, n_shingles long, sketch binary"
    wanted = filled.select("_rk", "shingles", "n_shingles", "sketch").mapInArrow(maybe_in(family, "_rk"), schema)
    return materialize(by_part(_blocks(family.join(wanted, "_rk"), ["family"]), "gid").mapInArrow(
        _block_links(percent, True), "a long, b long"), "minhash-links")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (see the module's text)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "_rk", F.monotonically_increasing_id())
    sets = materialize(rows.mapInArrow(
        _sets(width), "_rk long, doc_id long, n_shingles long, shingles array<long>, digest binary, bands array<long>, sketch binary"),
        "minhash-sets")
    filled = sets.where(F.col("n_shingles") > 0)
    # equal sets: one representative each, equal by the SHA-256 of the whole sorted set (no set travels in a shuffle)
    keyed = filled.select("_rk", "digest", "n_shingles")
    reps = keyed.groupBy("digest", "n_shingles").agg(F.min("_rk").alias("rep"))
    equal = materialize(keyed.join(reps, ["digest", "n_shingles"]).where(F.col("_rk") != F.col("rep")).select(
        F.col("_rk").alias("a"), F.col("rep").alias("b")), "minhash-equal")
    # representatives (rows not confirmed equal to another) are banded; each bucket is a star around its smallest member
    heads = filled.select("_rk", "bands").join(equal.select(F.col("a").alias("_rk")), "_rk", "left_anti")
    buckets = heads.select("_rk", F.posexplode("bands").alias("band", "key"))
    centre = buckets.groupBy("band", "key").agg(F.min("_rk").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = materialize(buckets.join(centre, ["band", "key"]), "minhash-stars")
    pairs = stars.where(F.col("_rk") != F.col("c")).select(F.col("_rk").alias("a"), F.col("c").alias("b")).distinct()
    pairs = materialize(pairs, "minhash-pairs")
    # only documents of some candidate pair bring their sets to the verifying joins: a bitmap of their keys thins the table first
    ends = pairs.select(F.col("a").alias("_rk")).unionByName(pairs.select(F.col("b").alias("_rk")))
    wanted = filled.select("_rk", "shingles", "n_shingles").mapInArrow(
        maybe_in(ends, "_rk"), "_rk long, shingles array<long>, n_shingles long")
    near = materialize(_verified(pairs, wanted, percent), "minhash-near")
    joined = connected_components(near, "a", "b").select(F.col("node").alias("_rk"), "component")
    beyond = _beyond_stars(stars, joined, filled, percent)
    # what the stars joined enters as one edge per member
    within = joined.select(F.col("_rk").alias("a"), F.col("component").alias("b"))
    comps = connected_components(equal.unionByName(within).unionByName(beyond), "a", "b")
    ids = sets.select("_rk", "doc_id", "n_shingles")
    labelled = ids.join(comps.select(F.col("node").alias("_rk"), "component"), "_rk", "left").withColumn(
        "component", F.coalesce("component", "_rk"))
    smallest = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(smallest, "component").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
