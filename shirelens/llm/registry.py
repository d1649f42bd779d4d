"""Registered queries of the text operators and, where SQL can state them, their twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from . import (bpe, exact_dedup, fingerprints, jaccard_join, language, lexical_search, minhash_dedup, packing, periodic_runs, pii, quality,
               suffix_dedup, warc)
from .common import crc_of_id, table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark, sf_dir):
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


SQL["op3_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY cp DESC, doc_id)
"""


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id("doc_id") % 4 == 2
    model = language.fit(docs.where(~held))
    got = language.predict(docs, model, keep=[held.alias("held_out")])
    return got.select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_of_id("doc_id") % 5 == 0
    model = quality.fit(docs, labels.where(~held))
    got = quality.score(docs, model, keep=[held.alias("held_out")])
    return got.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_fingerprints(spark, sf_dir):
    got = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next")


@query
def op2_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query
def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.linked_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


@query
def op10_suffix_dedup(spark, sf_dir):
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    # beside the contract's columns the text that is left; where a cut fell inside a character, its rest reads as U+FFFD
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query
def op4_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


@query
def op11_lexical_search(spark, sf_dir):
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL["op11_lexical_search"] = rf"""
WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{lexical_search.TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
nd AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY ALL),
tot AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM nd),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{lexical_search.TERM}')) AS term FROM benchmark),
qc AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
imp AS (SELECT tf.doc_id, tf.term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT)
          * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS impact
        FROM tf JOIN dfs USING (term) JOIN nd USING (doc_id), tot),
s AS (SELECT item_id, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM qc JOIN imp USING (term) GROUP BY ALL HAVING sum(c * impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s QUALIFY rank <= 20
"""


@query
def op12_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
