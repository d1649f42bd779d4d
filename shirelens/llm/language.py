"""Language identification as inference of a mixture.

Every language's model is the distribution of hashed letter trigrams (a letter with what stands before and after it) over all
its labelled documents.  A document is a mixture: each word comes from one of the languages, with unknown proportions.
Expectation-maximisation over the words' likelihoods estimates the proportions; nested sets of the strongest languages are
refitted, and the set with the best penalised likelihood (2 * log-likelihood minus PENALTY * log(words) per language) is kept.
The prediction is the strongest language of that set, the score its proportion in the unrestricted fit.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing was there to learn from;
ties go to the language first in order; rows without a language or a text teach nothing; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import CHUNK, U64, array_pieces, mix, sum_of_arrays

BUCKET_BITS = 16
ROUNDS = 12
MAX_SET = 4
PENALTY = 3.0
#: No word speaks more than this much against a language, so that a single odd word decides nothing.
FLOOR = 1e-4
UNKNOWN = "und"
_BUCKETS = 1 << BUCKET_BITS
_SPACE = 32


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


_LETTERS: list[np.ndarray] = []


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each letter's trigram and whether the letter begins a word."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    s = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(s, 0xFFFF)
    letter = _LETTERS[0][low]
    far = np.flatnonzero(s > 0xFFFF)
    if len(far):
        letter[far] = [chr(c).isalpha() for c in s[far]]
    s = np.where(letter, s, _SPACE).astype(U64)
    at = np.flatnonzero(letter)
    code = (s[at - 1] << U64(42)) | (s[at] << U64(21)) | s[at + 1]
    return (mix(code) >> U64(64 - BUCKET_BITS)).astype(np.int64), ~letter[at - 1]


class Model:
    """Log-probabilities of every bucket under every language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.log_p = np.ascontiguousarray(np.log((counts + 0.5) / (total + 0.5 * _BUCKETS)).T.astype(np.float32))


def count_trigrams(labelled: DataFrame, languages: list[str], lang_col: str, text_col: str) -> np.ndarray:
    """Counts (language x bucket) over all rows; the array's size depends on the number of languages only."""
    place = {v: i for i, v in enumerate(languages)}
    size = len(languages) * _BUCKETS

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for lo in range(0, len(text), CHUNK):
                    bucket, _ = trigrams(text[lo:lo + CHUNK])
                    if len(bucket):
                        k = place[lang] * _BUCKETS
                        counts[k:k + _BUCKETS] += np.bincount(bucket, minlength=_BUCKETS)
        yield array_pieces(counts)

    rows = labelled.where(F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return sum_of_arrays(rows.mapInArrow(run, "piece int, counts binary"), size).reshape(len(languages), _BUCKETS)


def fit(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn from every row that has a language and a text."""
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    languages = sorted(r[0] for r in known.select(lang_col).distinct().collect())  # as many as there are languages
    return Model(languages, count_trigrams(known, languages, lang_col, text_col) if languages else np.zeros((0, _BUCKETS), np.int64))


def word_likelihoods(text: str, model: Model) -> np.ndarray:
    """Relative likelihood of each word under each language, the best being 1."""
    sums = []
    for lo in range(0, max(len(text), 1), CHUNK):
        bucket, begins = trigrams(text[lo:lo + CHUNK])
        if len(bucket):
            sums.append(np.add.reduceat(model.log_p[bucket], np.flatnonzero(begins), axis=0))
    if not sums:
        return np.zeros((0, len(model.languages)), np.float32)
    ll = np.concatenate(sums)
    return np.maximum(np.exp(ll - ll.max(axis=1, keepdims=True)), FLOOR)


def mixtures(u: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest language of the selected set, and its share, for documents whose words begin at ``first``."""
    n_docs, n_lang = len(first), u.shape[1]
    words = np.diff(np.append(first, len(u)))

    def em(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for k in range(rounds + 1):
            r = np.repeat(share, words, axis=0) * u
            s = r.sum(axis=1)
            if k == rounds:
                return share, np.add.reduceat(np.log(s), first)
            r /= s[:, None]
            share = np.add.reduceat(r, first, axis=0) / words[:, None]

    full, _ = em(np.full((n_docs, n_lang), 1 / n_lang), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    best, chosen = np.full(n_docs, -np.inf), np.zeros((n_docs, n_lang))
    for k in range(1, min(MAX_SET, n_lang) + 1):
        mask = np.zeros((n_docs, n_lang))
        np.put_along_axis(mask, order[:, :k], 1.0, axis=1)
        start = np.maximum(full, 1e-6) * mask
        share, ll = em(start / start.sum(axis=1, keepdims=True), 0 if k == 1 else 4)
        worth = 2 * ll - PENALTY * k * np.log(words + 1.0)
        better = worth > best
        best[better], chosen[better] = worth[better], share[better]
    top = np.argmax(chosen, axis=1)
    return top, full[np.arange(n_docs), top]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``(<id_col>, lang_pred, score)`` and the columns of ``keep``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x 2**BUCKET_BITS numbers
    slim = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), *(keep or []))
    out = [f for f in slim.schema if f.name != "_text"]

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column("_text")
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            held, rows, size = [], [], 0

            def settle():
                u = np.concatenate(held)
                first = np.cumsum([0] + [len(x) for x in held[:-1]])
                for row, top, share in zip(rows, *mixtures(u, first)):
                    pred[row], score[row] = m.languages[top], min(max(float(share), 0.0), 1.0)

            for i in range(batch.num_rows if m.languages else 0):
                u = word_likelihoods(texts[i].as_py() or "", m)
                if len(u):
                    held.append(u)
                    rows.append(i)
                    size += len(u)
                if held and size > 60_000:
                    settle()
                    held, rows, size = [], [], 0
            if held:
                settle()
            columns = [batch.column(f.name) for f in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score)],
                                             names=[f.name for f in out] + ["lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return slim.mapInArrow(run, f"{fields}, lang_pred string, score double")
