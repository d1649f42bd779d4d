"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

Each shingle of five words is hashed once.  The leading bits of the hash name one of BINS bins, the rest is its value, and
each bin keeps its smallest value.  A bin that stays empty borrows from a filled one, chosen by hashes of the pair of bins
(of all filled bins the one whose hash with the empty bin is smallest, that is, the first filled one along a random
order of the bins, as in optimal densification), so two texts with the same filled bins borrow alike.  The lowest BITS bits of every bin are
packed into a hex string.  Agreement of two fingerprints is corrected for values that agree by chance in so few bits.

Defined results: null and empty texts, and texts of white space only, have no shingles and the empty fingerprint, which is
like itself (1) and unlike all others (0); fewer than five words count as one shingle; equal texts have equal
fingerprints; words are compared without regard to case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BINS = 128
BITS = 8
WORDS = 5
_SHIFT = 64 - (BINS - 1).bit_length()
_HEX = BITS // 4
#: Rows of a bucket of neighbouring ids, and the most cells that the range of ids is cut into to make buckets.
BUCKET_ROWS = 5_000
CELLS = 1 << 16


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` in column ``out``.

    Each step is a column of its own that the next one uses more than once, so that none is evaluated within another's loop.
    """
    w, s, v = f"_{out}_w", f"_{out}_s", f"_{out}_v"
    df = df.withColumn(w, F.array_remove(F.split(F.lower(_text(text_col)), r"[\x20\x09-\x0D]+"), ""))
    n = F.size(w)
    at = F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1)))
    joined = F.when(n == 0, F.array().cast("array<bigint>")).when(n < WORDS, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
        F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(w), i + (k - 1)) for k in range(WORDS)])))
    df = df.withColumn(s, F.sort_array(joined))
    place = lambda x: F.shiftrightunsigned(x, _SHIFT)
    # sorted hashes lie bin by bin, so the first of each bin is its smallest (negative numbers come first: the order of bins is immaterial)
    firsts = F.filter(F.col(s), lambda x, i: (i == 0) | (place(x) != place(F.get(F.col(s), i - 1))))
    df = df.withColumn(v, F.when(F.size(s) > 0, firsts).otherwise(F.col(s)))
    code = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND((1 << BITS) - 1))), _HEX, "0")
    filled = F.map_from_arrays(F.transform(v, lambda x: place(x).cast("int")), F.col(v))
    m = f"_{out}_m"
    df = df.withColumn(m, filled)
    # what is borrowed is hashed with the empty bin, so that texts of one shingle do not agree in all bins by one chance
    nearest = lambda b: F.xxhash64(b, F.array_min(F.transform(F.col(v), lambda x: F.struct(
        F.xxhash64(b, place(x)).alias("h"), x.alias("x"))))["x"])
    values = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: code(F.coalesce(F.element_at(F.col(m), b), nearest(b))))
    return df.withColumn(out, F.when(F.size(m) == 0, F.lit("")).otherwise(F.array_join(values, ""))).drop(w, s, v, m)


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprint columns, 0 to 1, corrected for chance agreement."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda acc, i: acc + (
        F.substring(F.col(a), i * _HEX + 1, F.lit(_HEX)) == F.substring(F.col(b), i * _HEX + 1, F.lit(_HEX))).cast("int")) / float(BINS)
    chance = 2.0 ** -BITS
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0)).otherwise(corrected)


def _with_bucket(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_bucket``, numbers that rise as ``order`` falls, each of about BUCKET_ROWS rows; null comes last.

    The range of ids is cut into at most CELLS equal cells, and cells in a row make a bucket, so the table that maps them is bounded.
    Where ids lie so close that a cell holds more rows than a bucket should, that bucket is larger and is sorted with spilling.
    """
    spark = df.sparkSession
    low, high, rows = df.agg(F.min(order).cast("double"), F.max(order).cast("double"), F.count(F.lit(1))).first()
    if low is None:
        return df.withColumn("_bucket", F.lit(0))
    cells = max(1, min(CELLS, 8 * rows // BUCKET_ROWS))
    step = max((high - low) / cells, 1.0)
    df = df.withColumn("_cell", F.floor((F.lit(high) - F.col(order).cast("double")) / F.lit(step)).cast("int"))
    counts = df.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most CELLS + 2 rows
    total, pairs = 0, []
    for r in sorted(counts, key=lambda r: (r["_cell"] is None, r["_cell"])):
        pairs.append((-1 if r["_cell"] is None else r["_cell"], total // BUCKET_ROWS))
        total += r["n"]
    table = spark.createDataFrame(pairs, "_known int, _bucket long")
    return df.join(F.broadcast(table), F.coalesce("_cell", F.lit(-1)) == F.col("_known")).drop("_cell", "_known")


def with_next(df: DataFrame, order: str, content: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``derive(df)`` with column ``_next``: a struct of ``content`` and the derived columns of the next row by descending ``order``.

    The row after the last is the first.  Neighbours are found within buckets of ids, and only the first row of each bucket travels
    to the bucket before it.  Null ids come last; ties follow the hash of the content.
    """
    df = _with_bucket(df, order)
    tie = F.xxhash64(content)
    rows = derive(df)
    made = [content, *[c for c in rows.columns if c not in df.columns]]
    following = F.lead(F.struct(*made)).over(W.partitionBy("_bucket").orderBy(F.col(order).desc_nulls_last(), tie))

    first = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("k"), (-tie.cast("decimal(20,0)")).alias("t"))
    heads = df.groupBy("_bucket").agg(F.max_by(content, first).alias(content))
    present = df.select("_bucket").distinct()
    # the bucket before each, that before the first being the last; one row per bucket
    order_of = W.orderBy(F.col("_bucket"))
    before = present.withColumn("_to", F.coalesce(F.lag("_bucket").over(order_of), F.max("_bucket").over(W.partitionBy(F.lit(0)))))
    heads = derive(heads.join(before, "_bucket").drop("_bucket")).select("_to", F.struct(*made).alias("_head"))
    got = rows.withColumn("_next", following).join(heads, F.col("_bucket") == F.col("_to"), "left")
    return got.withColumn("_next", F.coalesce("_next", "_head")).drop("_head", "_to", "_bucket")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n/2) characters replaced by the first as many (or all) of the next document's.
    """
    base = df.select(F.col(id_col), _text(text_col).alias("_text"))
    pairs = with_next(base, id_col, "_text", lambda d: with_fingerprint(d, "_text", "fingerprint"))
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next")["_text"], F.lit(1), half))
    pairs = pairs.select(id_col, n.cast("long").alias("n_chars"), edited.alias("edited_text"), "fingerprint",
                         F.col("_next")["fingerprint"].alias("_next_fp"))
    out = with_fingerprint(pairs, "edited_text", "edited_fingerprint")
    # always true, but not for the planner: it would copy this long expression, once per use, into every filter on the result
    apart = F.monotonically_increasing_id() >= 0
    out = out.withColumn("edited_fingerprint", F.when(apart, F.col("edited_fingerprint")))
    return out.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).withColumn(
        "near_next", likeness("fingerprint", "_next_fp")).drop("_next_fp")
