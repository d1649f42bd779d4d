"""Corpus pipeline: language ID, exact dedup, near dedup, redaction, packing.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's
``docs``.  All stages but the last return the columns of ``documents``.

Defined results, beside those of the operators: a document without a predicted language (null text, no letter, nothing to learn from)
is rejected; ``lang`` becomes the predicted language; redaction brings ``n_chars`` up to date; extra columns travel through every stage but the last; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shirelens.llm import exact_dedup, jaccard_join, language, packing, pii
from shirelens.llm.common import bounded_batches, crc_of_id
from shirelens.session import materialize

#: Shingles of five words, similarity of 0.8 or more.
NEAR = {"width": 5, "percent": 80}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, labelled with it; the others go."""
    bounded_batches(spark)
    model = language.fit(docs.where(crc_of_id("doc_id") % 4 != 2))
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    got = language.predict(docs, model, keep=[F.col("text"), F.col("lang"), *[F.col(f"`{c}`") for c in rest]])
    return got.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; rows without an id stay only where no row of the group has one."""
    bounded_batches(spark)
    return jaccard_join.keep_one(docs, **NEAR)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    bounded_batches(spark)
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates),
    ("redact", redact_personal_data), ("pack", pack_sequences)]

#: Trained models and packing cannot be stated in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
