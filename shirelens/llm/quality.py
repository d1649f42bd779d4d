"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its hashed words and character trigrams; a softmax over the two
classes follows.  The vectors and the output layer are trained by stochastic gradient descent in numpy, on a bounded sample of
labelled rows (``max_rows``, those with the smallest hash of their id), whose features are computed by Spark tasks and
trained on in one.  Averaging and the output layer are linear, so a trained model scores a text by the mean of one number
per feature; scoring reads every whole text.

Defined results: null and empty texts have no features and get the score of the output layer's bias; without labelled rows every
score is 0.5; rows with a null label teach nothing; of several labels for an id each teaches; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BYTE_VALUES, U64, buffers, chunks, mix, prefix_hashes, range_hash, words

BUCKET_BITS = 17
DIM = 16
EPOCHS = 10
RATE = 0.6
MAX_ROWS = 6000
_BUCKETS = 1 << BUCKET_BITS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of a chunk of texts and where each text's features begin."""
    start, end, row = words(data, offsets)
    prefix = prefix_hashes(BYTE_VALUES[data])
    word = mix(range_hash(prefix, start, end)) >> U64(64 - BUCKET_BITS)
    at = np.arange(max(len(data) - 2, 0))
    owner = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[owner + 1]
    at, owner = at[inside], owner[inside]
    gram = mix(range_hash(prefix, at, at + 3) ^ U64(0x5BF03635)) >> U64(64 - BUCKET_BITS)
    n = len(offsets) - 1
    kinds = [(word, row), (_recurrence(word, row), row), (gram, owner)]
    first = [np.searchsorted(r, np.arange(n + 1)) for _, r in kinds]
    out = np.empty(sum(len(x) for x, _ in kinds), np.int64)
    for k, (x, r) in enumerate(kinds):  # texts in order, and each text's features by kind
        out[np.arange(len(x)) + sum(f[r + 1] for f in first[:k]) + sum(f[r] for f in first[k + 1:])] = x
    return out, sum(first)


def _recurrence(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram "this word, and the same word so many words ago", the words left out and the gap on a log scale.

    Averages of word vectors alone do not tell a text from one that says the same again and again.
    """
    order = np.lexsort((word, row))
    same = (word[order][1:] == word[order][:-1]) & (row[order][1:] == row[order][:-1])
    gap = np.zeros(len(word), np.int64)
    gap[order[1:][same]] = np.diff(order)[same]
    code = np.where(gap > 0, np.ceil(np.log2(np.maximum(gap, 1))) + 1, 0).astype(U64)
    return mix(code + U64(0x7265)) >> U64(64 - BUCKET_BITS)


def _weights(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(bucket, minlength=0)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(len(bucket), 1)).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output layer and bias from rows of (label, buckets, weights)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (_BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    total, step = EPOCHS * max(len(rows), 1), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            label, at, weight = rows[k]
            rate = RATE * (1 - step / total)
            step += 1
            own = vectors[at]
            v = weight @ own
            z = v @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= rate * np.outer(v, p)
            bias -= 0.02 * rate * p
            # fastText's update: every feature of the text moves by the whole gradient, in proportion to its count
            vectors[at] = own - (rate * len(at)) * (weight[:, None] * back) * _SPREAD
    return vectors, layer, bias


#: Share of the gradient that reaches a feature.
_SPREAD = np.float32(0.05)


class Model:
    def __init__(self, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.vectors, self.layer, self.bias = vectors, layer, bias

    @property
    def per_feature(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the difference of the two classes, and the bias."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_rows: int = MAX_ROWS) -> Model:
    """Train on at most ``max_rows`` labelled rows.  ``labels`` holds only rows that may be learned from."""
    sample = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows))
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "_label", "_text")  # at most max_rows numbers are broadcast

    def extract(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            for i, j in chunks(offsets):
                bucket, where = features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                got = [_weights(bucket[where[k]:where[k + 1]]) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id")[i:j], batch.column("_label")[i:j], pa.array([a.tobytes() for a, _ in got], pa.binary()),
                    pa.array([w.tobytes() for _, w in got], pa.binary())], names=["id", "label", "bucket", "weight"])

    def learn(batches):
        rows = []
        for batch in batches:
            for i, y, b, w in zip(*(batch.column(k).to_pylist() for k in ("id", "label", "bucket", "weight"))):
                rows.append((i, y, np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        if rows:
            model = train([r[1:] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in model],
                                             names=["vectors", "layer", "bias"])

    made = rows.mapInArrow(extract, "id long, label int, bucket binary, weight binary").coalesce(1)
    got = made.mapInArrow(learn, "vectors binary, layer binary, bias binary").first()  # a model of fixed size
    if got is None:
        return Model(np.zeros((_BUCKETS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    return Model(np.frombuffer(got["vectors"], np.float32).reshape(_BUCKETS, DIM),
                 np.frombuffer(got["layer"], np.float32).reshape(DIM, 2), np.frombuffer(got["bias"], np.float32))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``(<id_col>, score)``, the probability of class 1, and the columns of ``keep``."""
    per_feature, bias = model.per_feature
    shared = df.sparkSession.sparkContext.broadcast((per_feature.astype(np.float64), bias))  # 2**BUCKET_BITS numbers
    slim = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), *(keep or []))
    out = [f for f in slim.schema if f.name != "_text"]

    def run(batches):
        worth, base = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            z = np.full(batch.num_rows, base)
            for i, j in chunks(offsets):
                bucket, where = features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                sums = np.concatenate([[0.0], np.cumsum(worth[bucket])])
                n = np.diff(where)
                z[i:j] += (sums[where[1:]] - sums[where[:-1]]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in out], pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))],
                                             names=[f.name for f in out] + ["score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return slim.mapInArrow(run, f"{fields}, score double")
