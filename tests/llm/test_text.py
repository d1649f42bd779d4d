"""Packing, archives, personal data, language, tokens, quality and fingerprints."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from shirelens.llm import bpe, fingerprints, language, packing, pii, quality, warc

from .conftest import edge_rows, prose

WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
BYTE_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


# --- packing -----------------------------------------------------------------------------------------------------------

def check_layout(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end = o + n
        assert end <= capacity
    return len(at)


def test_packing_edges(edge, nothing):
    lib = Tokenizer.from_file(WORD_PATH)
    lib.encode_special_tokens = True
    got = packing.pack(packing.tokenize(edge, WORD_PATH)).collect()
    check_layout(got, packing.CAPACITY)
    want = Counter()
    for r in edge_rows():
        ids = np.array(lib.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[(r[0], k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.pack(packing.tokenize(nothing, WORD_PATH)).count() == 0


def test_tokenizer_takes_words_apart_as_the_library_does():
    lib, own = Tokenizer.from_file(WORD_PATH), packing.WordTokenizer(WORD_PATH)
    lib.encode_special_tokens = True
    random.seed(5)
    parts = ["it's", "'S", "Été", "É́", "ÿ", "ß.", "<|endoftext|>", "a.b,c.", "...", "x,", "12,5", "ΑΣ.", "日本", "🙂", "\x1c", "\x85", " ", " ", "\n", "İ", "﷽", "µ", "Ĳ", "x̌"]
    for _ in range(500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert own.encode([text.encode()])[0].tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_piece_and_stays_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    np.add.at(counts, rng.integers(1, 257 if seed % 2 else 140, 4000), 1)
    runs, used = packing.plan(counts, 256, 12)
    ranks, load = defaultdict(list), Counter()
    for length, rank, pieces, sequence, each, offset in runs:
        ranks[length].append((rank, pieces))
        for k in range(pieces):
            load[sequence + k // each] += length
    for length, got in ranks.items():
        assert sorted(got)[0][0] == 0 and sum(n for _, n in got) == counts[length]
    assert max(load.values()) <= 256 and len(load) == used
    assert used <= 1.12 * (counts * np.arange(257)).sum() / 256 + 2


def test_configurations_meet_demand_of_few_sizes():
    got = packing.configurations(np.array([60, 50, 40, 30]), np.array([100.0, 100, 100, 100]), 100)
    assert all((p * [60, 50, 40, 30]).sum() <= 100 for p, _ in got) and sum(n for _, n in got) <= 184  # the optimum is 183.33


# --- archives ----------------------------------------------------------------------------------------------------------

def pages_of(spark):
    rows = [(1, "http://a", "x" * 5000), (2, "http://b", "x" * 5000), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "été"), (6, "u", "x" * 5000),
            (7, "u", "été"), (8, "u", "\r\n\r\nbody\r\n\r\n"), (None, "u", "nobody"), (9, "long", prose(3, 50_000))]
    return rows, spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, last string, sha1 int")


def test_archive_round_trip(spark):
    rows, df = pages_of(spark)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "") or -1, -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        top = None if last[h or ""] == -1 else last[h or ""]
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top == i else "revisit", None if top == i else top)] += 1
    assert Counter(tuple(r) for r in warc.archive_round_trip(df).collect()) == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    none = warc.archive_round_trip(df, min_bytes=10_000).collect()
    assert all(r.record_type == "response" for r in none if r.payload_bytes < 10_000)


def test_pages_crawled_twice_keep_all_rows(spark):
    rows = [(9, "A"), (9, "B"), (3, "A"), (4, "B"), (9, "A"), (5, "A"), (None, "B"), (None, "C"), (None, "D"), (4, "E"), (2, "E")]
    top = {"A": 9, "B": 9, "C": None, "D": None, "E": 4}
    want = Counter((i, base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if top[h] == i else "revisit", None if top[h] == i else top[h])
                   for i, h in rows)
    got = warc.archive_round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_reader_pushes_predicates_and_splits_files(spark, tmp_path):
    _, df = pages_of(spark)
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.with_digest(warc.page_records(df)).coalesce(1), path)
    whole, cut = warc.read_warc(spark, path), warc.read_warc(spark, path, partitionBytes="3000")
    assert cut.rdd.getNumPartitions() > 3
    key = lambda d: sorted((r.record_id, bytes(r.payload), r.warc_type) for r in d.collect())
    assert key(whole) == key(cut) and len(key(whole)) == 10
    revisits = whole.where((F.col("warc_type") == "revisit") & (F.col("content_length") < 100))
    assert revisits.count() == 4 and "Filter" not in revisits._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert whole.where(F.col("target_uri").startswith("http://")).count() == 2
    file = next(p for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz"))
    assert gzip.open(file).read().count(b"WARC/1.1\r\n") == 10
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc.gz").write_bytes(b"".join(gzip.compress(  # members without stated lengths, as other writers make them
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" % k) for k in range(3)))
    got = warc.read_warc(spark, f"{tmp_path}/plain").collect()
    assert [bytes(r.payload) for r in got] == [b"hello"] * 3


def foreign(k, payload):
    """A record as other writers make it: a gzip member that does not state its length."""
    return gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (k, len(payload), payload))


def test_large_files_of_other_writers_are_split_without_loss(spark, tmp_path):
    rng = random.Random(2)
    nested = b"".join(foreign(1000 + k, rng.randbytes(700)) for k in range(400))  # an archive inside of a record, stored as it is
    payloads = [rng.randbytes(rng.randint(0, 20_000)) for _ in range(60)]
    payloads[20] = nested
    payloads[40] = b"\x1f\x8b\x08" * 5000
    own = lambda k: warc.member({"WARC-Type": "resource", "WARC-Record-ID": f"<r{k}>"}, payloads[k])
    for name, write in (("plain", lambda k: foreign(k, payloads[k])), ("mixed", lambda k: own(k) if k < 10 or k % 2 else foreign(k, payloads[k]))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(b"".join(map(write, range(60))))
        for size in ("4000", "50000", "100000000"):
            got = warc.read_warc(spark, f"{tmp_path}/{name}", partitionBytes=size)
            assert Counter((r.record_id, bytes(r.payload)) for r in got.collect()) == Counter((f"<r{k}>", payloads[k]) for k in range(60)), (name, size)
        bare = warc.read_warc(spark, f"{tmp_path}/{name}", "record_id string", partitionBytes="30000")
        assert bare.rdd.getNumPartitions() > 10 and sorted(r[0] for r in bare.collect()) == sorted(f"<r{k}>" for k in range(60))
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.warc.gz").write_bytes(gzip.compress(b"".join(gzip.decompress(foreign(k, b"hello")) for k in range(3))))
    with pytest.raises(Exception, match="more than one record"):
        warc.read_warc(spark, f"{tmp_path}/one").collect()


# --- personal data -----------------------------------------------------------------------------------------------------

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    def good(k, s):
        d = [int(c) for c in s if c in "0123456789"]
        if k == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if k == 2:
            return 14 <= len(d) <= 19 and sum(sum(divmod(v * (1 + i % 2), 10)) for i, v in enumerate(d[::-1])) % 10 == 0
        return k == 0 or 10 <= len(d) <= 15
    return sorted((m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if good(k, m.group()))


def test_base_spans_match_the_patterns():
    random.seed(8)
    parts = ["a", "B", "@", ".", "1", "23", "+", "-", " ", "(", "%", "c@d.e", "255", "4", "é", "4111 1111 1111 1111 ", "+1 (499) 555-6503", "0255.1.1.1"]
    for _ in range(6000):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 25)))
        assert sorted(pii.base_spans(text)) == brute_base(text), repr(text)


def learning_docs(spark):
    rows = []
    for k in range(260):
        rows.append((k, f"{prose(k, 20)} call +1 ({200 + k}) 555-{1000 + k * 7} or mail ann{k}@host{k % 9}.example.com now, build {k}.{k + 1}.{k + 2}.9999 "
                        f"part {k:04d}-{k * 3:05d} item {k * 991:09d}-77"))
    rows += [(900, "reach me at (499) 555-6503 today"), (901, "write to joe at mail dot example dot com please"), (902, "ratio 3.14 in 2021-22")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_trees_add_spans_and_base_stays(spark, edge, nothing):
    docs = learning_docs(spark)
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    for r in docs.collect():
        base = brute_base(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(got[r.doc_id].spans.split(","))
    assert "phone:" in got[900].spans and "email:" in got[901].spans and got[902].spans == ""
    assert sum(len(got[k].spans.split(",")) for k in range(260)) <= 2.1 * 260
    clean = pii.redact(docs.withColumn("spans", F.lit("clash")), model)
    assert clean.columns == ["doc_id", "text", "spans"] and not clean.where(F.col("text").contains("@")).count()
    assert pii.find(edge, model).count() == len(edge_rows()) and pii.redact(edge, model).where("text is null").count() == 2
    assert pii.find(nothing, pii.fit(nothing)).count() == 0


def test_search_is_linear_in_odd_texts():
    text = "1" * 200_000 + " " + "a." * 100_000 + "@" * 1000 + "+1" + "(" * 50_000 + "1.2.3." * 20_000 + " at " * 20_000
    assert pii.search(text, pii.Trees())[0] is not None


# --- language and quality ----------------------------------------------------------------------------------------------

def test_language_learns_and_rejects(spark, edge, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = __spark_entry__.queries()["op5_language_id"](spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and len(got) == docs.count()
    crc = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (crc == got.held_out).all()
    model = language.fit(docs)
    out = {(r.doc_id, r.lang_pred) for r in language.predict(edge, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (None, "und")} <= out and language.predict(edge, model).count() == len(edge_rows())
    assert {r.lang_pred for r in language.predict(edge, language.fit(nothing)).collect()} == {"und"}
    assert language.predict(nothing, model).count() == 0


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs)
    part = {r.lang: r.text for r in docs.where("length(text) > 3000").collect()}
    if {"de", "fr"} <= part.keys():
        u = language.word_likelihoods(part["de"][:2000] + " . " + part["fr"][:1000], model)
        top, share = language.mixtures(u, np.array([0]))
        assert model.languages[top[0]] == "de" and 0.4 < share[0] < 0.9


def test_quality_on_held_out_rows(spark, edge, nothing):
    big = "/root/testdata/sf0.01"
    got = __spark_entry__.queries()["op8_quality"](spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    both = got.join(labels, "doc_id").toPandas()
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and both.score.between(0, 1).all()
    assert ((both.score >= 0.3).astype(int) == both.predicted).all() and got.count() == 1000
    model = quality.fit(edge, spark.createDataFrame([(3, 1), (7, 0), (3, None), (None, 1)], "doc_id long, quality int"))
    assert quality.score(edge, model).count() == len(edge_rows()) and quality.score(nothing, model).count() == 0
    assert {r.score for r in quality.score(edge, quality.fit(nothing, labels)).collect()} == {0.5}


# --- tokens ------------------------------------------------------------------------------------------------------------

def reference_encoder(pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(BYTE_PATH), special_tokens={})


def test_bpe_matches_the_library(edge, nothing):
    enc = reference_encoder()
    got = bpe.encode(edge, BYTE_PATH, public_tokenizers.PATTERN)
    want = Counter((r[0], tuple(enc.encode_ordinary(r[1] or ""))) for r in edge_rows())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    back = bpe.decode(got, BYTE_PATH, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((r[0], (r[1] or "").encode()) for r in edge_rows())
    trip = bpe.round_trip(edge, BYTE_PATH, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in trip) == Counter(
        {(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()): n for (i, ids), n in want.items()})
    assert bpe.round_trip(nothing, BYTE_PATH, public_tokenizers.PATTERN).count() == 0


def test_replay_of_odd_words():
    random.seed(2)
    words = [bytes(random.choice(b'abetinsr \n"1\xc3\xa9') for _ in range(random.randint(1, 40))) for _ in range(3000)] + [b"a" * 5000, b"ab" * 3000]
    enc, codec = reference_encoder(), bpe.Codec(BYTE_PATH, public_tokenizers.PATTERN)
    for word, ids in zip(words, codec.replay(words)):
        assert ids == enc._core_bpe.encode_single_piece(word)


# --- fingerprints ------------------------------------------------------------------------------------------------------

def five_words(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text.lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("rows", [5000, 4])
def test_fingerprints_against_true_similarity(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", rows)
    texts = [prose(k, 40 + k * 3) for k in range(60)] + ["", "one", prose(7, 61), prose(7, 61) + " more"]
    docs = [(k * k * 3 + k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.edited_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    docs.sort(reverse=True)
    errors = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_text) == (len(t), edited)
        for value, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = five_words(t), five_words(other)
            errors.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02
    prints = defaultdict(set)
    for i, t in docs:
        prints[t].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_edges(edge, nothing):
    got = fingerprints.edited_pairs(edge)
    assert got.count() == len(edge_rows()) and fingerprints.edited_pairs(nothing).count() == 0
    assert got.where("near_edited is null or near_next is null or near_edited < 0 or near_edited > 1").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_filters_on_fingerprints_stay_small(edge):
    got = fingerprints.edited_pairs(edge)
    plain = len(got._jdf.queryExecution().optimizedPlan().toString())
    for condition in ("near_edited > 0.5", "near_next > 0.5", "edited_fingerprint <> ''", "near_edited is null or near_next < 0 or near_edited > 1"):
        assert len(got.where(condition)._jdf.queryExecution().optimizedPlan().toString()) < 2 * plain


# --- pipeline ----------------------------------------------------------------------------------------------------------

def test_pipeline_stages_keep_columns(spark, edge, nothing, tmp_path):
    for start in (edge, nothing):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            path = f"{tmp_path}/{name}-{start is edge}"
            out.write.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == edge.columns
            docs = spark.read.parquet(path)
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_one_of_each_copy_and_redacts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact_dedup"](spark, docs, SMALL)
    near = stages["near_dedup"](spark, exact, SMALL)
    from .test_dedup import brute_components, brute_exact

    assert exact.count() == len({k[3] for k in brute_exact([(r.doc_id, r.text) for r in docs.collect()])})
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    assert {r.doc_id for r in near.select("doc_id").collect()} == {c for _, n, c in brute_components(rows, 5, 80)}
    clean = stages["redact"](spark, docs, SMALL).collect()
    assert not any(brute_base(re.sub(r"\[[A-Z]+\]", "", r.text)) for r in clean if "@" in r.text) and all(r.n_chars == len(r.text) for r in clean)


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names} and "pipeline" in names


def test_word_memory_stays_bounded(monkeypatch):
    """Words met lately and as many before them; a word met again is not forgotten, and ids do not depend on it."""
    monkeypatch.setattr(packing, "WORD_CACHE", 50)
    own, plain = packing.WordTokenizer(WORD_PATH), packing.WordTokenizer(WORD_PATH)
    learned, keep = [], own._learn
    own._learn = lambda new: (learned.extend(new), keep(new))[1]
    for k in range(40):
        text = b"steady " + b" ".join(b"rare%d" % (k * 20 + i) for i in range(20))
        plain.known, plain.before = {}, {}
        assert own.encode([text])[0].tolist() == plain.encode([text])[0].tolist()
        assert len(own.known) + len(own.before) <= 2 * (50 + 21)
    assert learned.count(b"steady") == 1
