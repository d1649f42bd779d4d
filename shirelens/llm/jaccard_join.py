"""Exact Jaccard join on word shingles with signature trees.

1. Counts of hashed shingles over the whole corpus, in an array of fixed size, order the shingles from rare to common.  Any order gives exact
   results; this one keeps what many documents share out of the prefixes.
2. Every document becomes a profile: set size, digest of its set, a bitmap of its shingles, and its prefix, the shingles of which two
   documents this similar share at least one.  Documents with equal sets are one class from here on.
3. Classes that share a prefix shingle form a block; blocks with the same members are one block.  In each block a signature tree is built:
   its nodes hold the OR and the AND of their members' bitmaps and the range of their sizes.  A dual traversal from the root follows only
   pairs of nodes whose greatest possible overlap could reach the threshold, and reports enough pairs to connect what may be connected.
4. Connected candidates are clusters.  Each cluster's texts meet once, and the same traversal, now with exact intersections at the
   leaves, finds the links.  Pairs that are connected already are skipped, so a cluster of n copies costs about n comparisons.

Blocks and clusters over LEAF_MAX members are cut into leaves, and each pair of leaves is a group of its own: no task
holds more than two leaves, whatever the size of a cluster.  A family's size enters as members times leaves.

Defined results: null, empty and white-space texts have an empty set and are their own component; repeated rows share one set; a null id takes
part, and its component is named by the smallest id that is not null (null if there is none); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.components import connected_components
from ..session import materialize
from .common import Links, U64, array_pieces, boundaries, buffers, by_part, chunks, maybe_in, mix, shingles, sum_of_arrays, whole_groups

WIDTH, PERCENT = 5, 80
SKETCH_BITS = 20
#: Bits of the shortest and the longest bitmap, as powers of two; in between a set has as many bits as elements, or up to twice as many.
LEAST_BITS, MOST_BITS = 8, 20
#: Members of a block or cluster that one task compares.
LEAF_MAX = 2048
#: Documents under a leaf node of the tree.
LEAF = 16


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection with 100 * intersection >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def resolution(sizes: np.ndarray) -> np.ndarray:
    """Power of two of a set's bitmap.  A bitmap with few bits for its set is full and tells nothing, so bits grow with sizes."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def bitmap_of(tokens: np.ndarray, power: int | None = None) -> np.ndarray:
    power = int(resolution(np.array(len(tokens)))) if power is None else power
    out = np.zeros(1 << power, bool)
    out[(tokens >> U64(64 - power)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(U64)


def halved(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits: neighbouring bits become one."""
    flags = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=-1, bitorder="little")
    return np.packbits(flags[..., 0::2] | flags[..., 1::2], axis=-1, bitorder="little").view(U64)


def connect(sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int, links: Links, accept=None) -> list[tuple[int, int]]:
    """Joins among members of any size: a tree per bitmap length, and one for the members on both sides of each change of length."""
    power = resolution(sizes)
    made = []
    for p in np.unique(power):
        own = np.flatnonzero(power == p)
        made += SignatureTree(sizes[own], np.stack([bitmaps[k] for k in own]), own).connect(percent, links, accept)
        edge = 1 << int(p)
        low = own[100 * sizes[own] >= percent * edge]
        high = np.flatnonzero((power == p + 1) & (percent * sizes <= 100 * edge))
        if len(low) and len(high):
            bits = [bitmaps[k] for k in low] + list(halved(np.stack([bitmaps[k] for k in high])))
            both = np.concatenate([low, high])
            made += SignatureTree(sizes[both], np.stack(bits), both).connect(percent, links, accept)
    return made


# --- signature tree ----------------------------------------------------------------------------------------------------

class SignatureTree:
    """Binary tree over members sorted by size; level 0 holds the leaves of LEAF members."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, names: np.ndarray | None = None):
        order = np.argsort(sizes, kind="stable")
        self.sizes, self.bits = sizes[order], bits[order]
        self.order = order if names is None else names[order]
        at = np.arange(0, len(sizes), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.bits, at, axis=0), np.bitwise_and.reduceat(self.bits, at, axis=0),
                        np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at))]
        while len(self.levels[-1][2]) > 1:
            o, a, lo, hi = self.levels[-1]
            at = np.arange(0, len(lo), 2)
            self.levels.append((np.bitwise_or.reduceat(o, at, axis=0), np.bitwise_and.reduceat(a, at, axis=0),
                                np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether any member of node i could reach the threshold with any member of node j."""
        o, a, lo, hi = self.levels[level]
        lost_i = np.bitwise_count(a[i] & ~o[j]).sum(axis=1, dtype=np.int64)
        lost_j = np.bitwise_count(a[j] & ~o[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(hi[i] - lost_i, hi[j] - lost_j)
        return (most >= least_overlap(lo[i], lo[j], percent)) & (100 * np.minimum(hi[i], hi[j]) >= percent * np.maximum(lo[i], lo[j]))

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (i <= j) that the traversal from the root reaches."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self._possible(level, i, j, percent)
            i, j = i[keep], j[keep]
            if level:
                n = len(self.levels[level - 1][2])
                i, j = (np.concatenate([2 * i + a for a, _ in ((0, 0), (0, 1), (1, 0), (1, 1))]),
                        np.concatenate([2 * j + b for _, b in ((0, 0), (0, 1), (1, 0), (1, 1))]))
                inside = (i < n) & (j < n) & (i <= j)
                i, j = i[inside], j[inside]
        return i, j

    def connect(self, percent: int, links: Links, accept=None) -> list[tuple[int, int]]:
        """Join members whose bound (and ``accept``, where given) reaches the threshold; returns the joins, by name."""
        made = []
        left, right = self.leaf_pairs(percent)
        near = np.argsort(right - left, kind="stable")  # neighbours in size first
        for a, b in zip(left[near].tolist(), right[near].tolist()):
            x = np.arange(a * LEAF, min((a + 1) * LEAF, len(self.sizes)))
            y = np.arange(b * LEAF, min((b + 1) * LEAF, len(self.sizes)))
            bx, by, sx, sy = self.bits[x][:, None], self.bits[y][None], self.sizes[x][:, None], self.sizes[y][None]
            most = np.minimum(sx - np.bitwise_count(bx & ~by).sum(axis=2, dtype=np.int64),
                              sy - np.bitwise_count(by & ~bx).sum(axis=2, dtype=np.int64))
            ok = most >= least_overlap(sx, sy, percent)
            for p, q in zip(*(k.tolist() for k in np.nonzero(ok))):
                p, q = int(self.order[x[p]]), int(self.order[y[q]])
                if p != q and links.root(p) != links.root(q) and (accept is None or accept(p, q)):
                    links.join(p, q)
                    made.append((p, q))
        return made


# --- profiles ----------------------------------------------------------------------------------------------------------

def _sets(column: pa.Array, width: int):
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        yield from shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width)


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many documents hold a shingle of each hash cell; the array's size is fixed by SKETCH_BITS."""
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            held, size = [], 0
            for s in _sets(batch.column("text"), width):
                held.append(s)
                size += len(s)
                if size > 1 << 17:
                    counts += np.bincount((np.concatenate(held) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                    held, size = [], 0
            if size:
                counts += np.bincount((np.concatenate(held) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        yield array_pieces(counts)

    return sum_of_arrays(texts.select("text").mapInArrow(run, "piece int, counts binary"), 1 << SKETCH_BITS)


def _profiles(rows: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    common = rows.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 24) - 1).astype(np.uint32))  # 2**SKETCH_BITS numbers

    def run(batches):
        seen = common.value
        for batch in batches:
            n, h1, h2, prefix, bits = [], [], [], [], []
            for s in _sets(batch.column("text"), width):
                n.append(len(s))
                spread = mix(s + U64(0x51ED270B))
                h1.append(int(spread.sum(dtype=U64).view(np.int64)) if len(s) else 0)
                h2.append(int(np.bitwise_xor.reduce(mix(spread)).view(np.int64)) if len(s) else 0)
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                key = (seen[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64) << U64(40)) | (s >> U64(24))
                prefix.append(s[np.argsort(key, kind="stable")[:keep]].tobytes())
                bits.append(bitmap_of(s).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("uid"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()),
                pa.array(h2, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())],
                names=["id", "uid", "text_hash", "n", "h1", "h2", "prefix", "bits"])

    return rows.mapInArrow(run, "id long, uid long, text_hash long, n long, h1 long, h2 long, prefix binary, bits binary")


# --- candidates --------------------------------------------------------------------------------------------------------

def _explode(batches):
    for batch in batches:
        lengths = [len(p) // 8 for p in batch.column("prefix").to_pylist()]
        tokens = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(np.asarray(batch.column("node")), lengths))],
                                         names=["token", "node"])


def _split(groups: DataFrame, size: str, keys: list[str]) -> DataFrame:
    """Groups as ``part`` numbers; a group over LEAF_MAX members becomes one part per pair of its leaves."""
    leaves = F.ceil(F.col(size) / F.lit(LEAF_MAX)).cast("int")
    own = F.pmod(F.xxhash64("node"), leaves).cast("int")
    other = F.explode(F.sequence(F.lit(0), leaves - 1))
    marked = groups.withColumn("_leaves", leaves).withColumn("_own", own).withColumn("_other", other)
    part = F.xxhash64(*keys, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return marked.withColumn("part", part).drop("_leaves", "_own", "_other")


def _bitmaps(table: pa.Table, a: int, b: int) -> list[np.ndarray]:
    return [np.frombuffer(x, U64) for x in table.column("bits").slice(a, b - a).to_pylist()]


def _candidate_edges(percent: int):
    def run(batches):
        for table in whole_groups(batches, "part"):
            part, node, n = (np.asarray(table.column(k)) for k in ("part", "node", "n"))
            cuts = boundaries(part)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a > 1:
                    made = connect(n[a:b], _bitmaps(table, a, b), percent, Links(b - a))
                    out += [(int(node[a + p]), int(node[a + q])) for p, q in made]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())],
                                             names=["src", "dst"])

    return run


def candidate_clusters(classes: DataFrame, percent: int) -> DataFrame:
    """``(node, component)`` of classes that may be linked, directly or through others."""
    postings = classes.select("node", "prefix").mapInArrow(_explode, "token long, node long")
    w = W.partitionBy("token")
    blocks = postings.withColumn("members", F.count(F.lit(1)).over(w)).where("members > 1").withColumn(
        "same", F.sum(F.xxhash64("node").bitwiseAND((1 << 40) - 1)).over(w))
    blocks = blocks.select("members", "same", "node").distinct()
    blocks = _split(blocks, "members", ["members", "same"]).select("part", "node").join(classes.select("node", "n", "bits"), "node")
    pairs = by_part(blocks).mapInArrow(_candidate_edges(percent), "src long, dst long")
    return connected_components(pairs)


# --- links -------------------------------------------------------------------------------------------------------------

def _verified_edges(width: int, percent: int):
    def run(batches):
        for table in whole_groups(batches, "part"):
            table = table.combine_chunks()
            part, node = np.asarray(table.column("part")), np.asarray(table.column("node"))
            text = table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())
            cuts = boundaries(part)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                _, first = np.unique(node[a:b], return_index=True)  # repeated rows of one class
                if len(first) < 2:
                    continue
                sets = list(_sets(text.slice(a, b - a).take(pa.array(first)), width))
                own = node[a:b][first]
                sizes = np.array([len(s) for s in sets], np.int64)

                def linked(p: int, q: int) -> bool:
                    x, y = (sets[p], sets[q]) if sizes[p] <= sizes[q] else (sets[q], sets[p])
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[at] == x).sum())
                    return 100 * common >= percent * (len(x) + len(y) - common)

                made = connect(sizes, [bitmap_of(s) for s in sets], percent, Links(len(own)), linked)
                out += [(int(own[p]), int(own[q])) for p, q in made]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())],
                                             names=["src", "dst"])

    return run


def _classes(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``(id, text_hash, n_shingles, component, component_id)`` per row of ``df``; ``component`` is null for an empty set."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    counts = shingle_counts(rows, width)
    profile = materialize(_profiles(rows.withColumn("uid", F.monotonically_increasing_id()), counts, width, percent), "profiles")
    key = ["h1", "h2", "n"]
    classes = materialize(profile.where("n > 0").groupBy(*key).agg(
        F.min("uid").alias("node"), F.min("id").alias("least_id"), F.min_by(F.struct("id", "text_hash", "prefix", "bits"), "uid").alias("r")).select(
        *key, "node", "least_id", "r.id", "r.text_hash", "r.prefix", "r.bits"), "classes")

    clusters = candidate_clusters(classes, percent)
    sized = clusters.join(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component")
    wanted = materialize(sized.join(classes.select("node", "id", "text_hash"), "node"), "clusters")
    texts = rows.mapInArrow(maybe_in(wanted, "text_hash"), "id long, text string, text_hash long")
    parts = _split(wanted, "members", ["component"]).select("part", "node", F.col("id").alias("_id"), F.col("text_hash").alias("_h"))
    met = texts.join(parts, (F.col("text_hash") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id"))).select("part", "node", "text")
    links = connected_components(by_part(met).mapInArrow(_verified_edges(width, percent), "src long, dst long"))

    named = classes.select(*key, "node", "least_id").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = materialize(named.join(names, "component").select(*key, "component", "component_id"), "components")
    return profile.select("id", "text_hash", *key).join(named, key, "left").select(
        "id", "text_hash", F.col("n").alias("n_shingles"), "component", "component_id")


def linked_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(<id_col>, n_shingles, component_id)`` per row of ``df``."""
    return _classes(df, id_col, text_col, width, percent).select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, all columns, one per component: that of the smallest id; rows with an empty set all stay.

    Rows are found again by id and text, so of rows that repeat both one stays.
    """
    key = ["_keep_id", "_keep_null", "_keep_hash"]
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.col(id_col).isNull(), text_hash]
    classes = _classes(df, id_col, text_col, width, percent)
    best = classes.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "text_hash")).alias("b"))
    dropped = classes.where("n_shingles > 0").select("component", "id", "text_hash").join(best, "component").where(
        (F.coalesce("id", F.lit(0)) != F.col("b.id")) | (F.col("id").isNull() != F.col("b.none")) | (F.col("text_hash") != F.col("b.text_hash")))
    dropped = dropped.select(F.coalesce("id", F.lit(0)).alias(key[0]), F.col("id").isNull().alias(key[1]), F.col("text_hash").alias(key[2]))
    rows = df.select("*", *[c.alias(k) for c, k in zip(own, key)]).join(dropped.distinct(), key, "left_anti")
    return rows.dropDuplicates(key).drop(*key)
