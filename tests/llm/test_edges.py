"""Nulls, empty tables, ties, repeated rows, long texts and clashing columns for every operator."""

import gzip
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import classlm, kmeanstree, language, minhash, mixing, pieces, pipeline, suffix_dedup, topk, toxicity, vectors, warc
from spanforge.llm.common import importable, shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k * 7919 % 1013}" for k in range(20_000))
ODD = [
    (None, "one two three four five six", "en", "s"),
    (1, None, "en", None),
    (2, "", None, "s"),
    (3, " \n\t", "de", ""),
    (4, "same text here for both of them", "en", "s"),
    (4, "same text here for both of them", "en", "s"),
    (5, "same text here for both of them", "en", "t"),
    (6, LONG, "en", "t"),
    (7, "x", "en", "s"),
    (8, "123 456", "en", None),
]
CLASHING = ["size", "score", "spans", "sha256", "copies", "row", "row_key", "cid", "grp", "kept_key", "kept_id", "taken", "whole", "part", "ids", "decoded", "found", "predicted", "held_out", "tid", "rank"]


@pytest.fixture(scope="module")
def odd(spark):
    importable(spark)
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    importable(spark)
    return spark.createDataFrame([], DOCS)


def clashing(df):
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_stages_take_odd_rows_and_keep_columns(spark, odd, none, tmp_path):
    labels(spark, [(4, 1, None), (6, 0, 1), (None, 0, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (clashing(odd), none):
        n = {}
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path)).persist()
            n[name] = out.count()
            if name != "encoding":
                assert out.columns == docs.columns
                if n[name] and docs.columns != none.columns:
                    assert out.select(*CLASHING).distinct().collect() == [tuple(range(len(CLASHING)))]
            out.unpersist()
        rows = docs.count()
        assert n["toxicity"] == n["repeated_strings"] == n["encoding"] == rows
        # doc 4 is there twice and equals doc 5
        assert n["near_duplicates"] == max(0, rows - 2)


def test_one_row_per_document(odd, none):
    lexicon = toxicity.Lexicon({"bad": 0.9}, {})
    for docs in (odd, none):
        n = docs.count()
        assert toxicity.score_texts(docs, lexicon).count() == n
        assert language.predict(docs, language.learn(docs.select("text", "lang"))).count() == n
        assert minhash.near_duplicates(docs).count() == n
        assert pieces.encode_digests(docs).count() == n
        assert suffix_dedup.removed_spans(docs)[0].count() == n
        held = docs.withColumn("held_out", F.lit(False)).select("doc_id", "held_out", "text")
        counts = classlm.word_counts(docs)
        scored = classlm.score(held, classlm.train(docs, counts), counts)
        assert scored.count() == n and scored.filter("score IS NULL OR base_score IS NULL").count() == 0
        assert mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).count() == n


def test_null_and_letterless_texts_are_und(odd):
    got = {(r.doc_id, r.lang_pred) for r in language.predict(odd, language.learn(odd.select("text", "lang"))).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und"), (7, "en")} <= got


def test_empty_sets_link_with_nothing(odd):
    got = {r.doc_id: r for r in minhash.near_duplicates(odd, 3, 85).collect()}
    assert [got[k].component_id for k in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 4]
    assert got[1].n_shingles == got[3].n_shingles == 0 and got[7].n_shingles == 1
    assert got[None].component_id is None


def test_nothing_learned(spark, odd):
    lexicon = toxicity.learn(spark.createDataFrame([], "text string, toxic int"))
    assert lexicon == toxicity.Lexicon({}, {})
    assert {r.predicted for r in toxicity.score_texts(odd, lexicon).collect()} == {0}
    got = language.predict(odd, language.learn(spark.createDataFrame([], "text string, lang string")))
    assert {(r.lang_pred, r.score) for r in got.collect()} == {("und", 0.0)}
    counts = classlm.word_counts(odd.filter("false"))
    model = classlm.train(odd.filter("false"), counts)
    scored = classlm.score(odd.withColumn("held_out", F.lit(True)).select("doc_id", "held_out", "text"), model, counts)
    assert {(r.n_known, r.base_score, r.score, r.train_tokens) for r in scored.collect()} == {(0, 0.0, 0.0, 0)}


VECTORS = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0]), (8, [-1.0, 2.0])]


def test_vector_searches(spark):
    importable(spark)
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    usable = vectors.usable(rows)
    assert sorted(r.vec_id for r in usable.collect()) == [0, 1, 2, 7, 8, 100]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(usable, usable.filter("vec_id % 100 = 0"), 3).collect()]
    assert sorted(got) == [(0, 1, 1, 1), (0, 2, 2, 1), (0, 3, 100, 1), (100, 1, 0, 1), (100, 2, 1, 1), (100, 3, 2, 1)]
    kept = vectors.usable(rows, allow_zero=False)
    index = kmeanstree.build(kept, kept.filter("vec_id = 0"), 3)
    got = [(r["rank"], r.vec_id, r.score) for r in kmeanstree.search(index, kept.filter("vec_id = 0"), 3).collect()]
    assert sorted(got) == [(1, 1, 1.0), (2, 2, 1.0), (3, 100, 1.0)]
    empty = usable.filter("false")
    assert topk.search(empty, empty, 3).count() == 0 and kmeanstree.build(empty, empty, 3) is None


def test_clashing_columns_are_passed_on_or_unread(spark, odd):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    plain, more = vectors.usable(rows), vectors.usable(clashing(rows))
    found = [sorted(map(str, topk.search(v, v.filter("vec_id % 100 = 0"), 3).collect())) for v in (plain, more)]
    assert found[0] == found[1]
    found = []
    for v in (vectors.usable(rows, allow_zero=False), vectors.usable(clashing(rows), allow_zero=False)):
        index = kmeanstree.build(v, v.filter("vec_id = 0"), 3)
        found.append(sorted(map(str, kmeanstree.search(index, v.filter("vec_id = 0"), 3).collect())))
    assert found[0] == found[1]
    filters = language.learn(clashing(odd.select("text", "lang")))
    named = language.predict(clashing(odd.drop("lang")), filters)
    assert [c for c in CLASHING if c not in ("score",)] == [c for c in named.columns if c in CLASHING and c != "score"] and named.columns[-2:] == ["lang_pred", "score"]
    assert sorted(map(str, named.select("doc_id", "lang_pred").collect())) == sorted(map(str, language.predict(odd, filters).select("doc_id", "lang_pred").collect()))
    held = odd.withColumn("held_out", F.col("doc_id") % 2 == 0).select("doc_id", "held_out", "text")
    extra = held.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING) if c != "held_out"))
    counts = classlm.word_counts(held.filter("NOT held_out"))
    model = classlm.train(held.filter("NOT held_out"), counts)
    assert sorted(map(str, classlm.score(extra, model, counts).select("doc_id", "n_tokens", "n_known").collect())) == sorted(map(str, classlm.score(held, model, counts).select("doc_id", "n_tokens", "n_known").collect()))


def test_archives_of_odd_pages(spark):
    importable(spark)
    rows = [(1, "http://a.org/x", "same"), (2, "http://b.a.org/", "same"), (3, None, None), (4, "", ""), (4, "", ""), (5, "not a url", "é" * 400_000), (None, "http://c.org", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("key", F.lit(2))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_and_read(pages).collect()}
    assert warc.archive_and_read(pages).count() == len(rows)
    assert got == {(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 800_000), (None, "response", None, 1)}
    assert warc.archive_and_read(pages.filter("false")).count() == 0
    key = pages.select(warc.url_key(F.lit("http://www.A.org:80/x?y")).alias("k")).first().k
    assert key == "org,a,www):80/x?y"
    texts = {(r.page_id, r.url, None if r.payload is None else bytes(r.payload).decode()) for r in warc.archive_and_read(pages, payloads=True).collect()}
    assert texts == {(i, u, None if i in (1, 3) else t or "") for i, u, t in rows}


def test_a_lookup_reads_what_it_needs(spark):
    """Ten records of 8 MB: the bytes that the file system gave, and the records as any reader of archives sees them."""
    importable(spark)
    rng = np.random.default_rng(4)
    rows = [(k, f"http://h{k}.org/ü", rng.integers(97, 123, 4_000, dtype=np.uint8).tobytes().decode()) for k in range(3_000)]
    archives = warc.write_archives(warc.with_record_types(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)), shared_path(spark, "warc-test"))
    index = warc.write_index(warc.captures(archives), shared_path(spark, "warc-test-index"))
    size = archives.agg(F.sum(F.length("data"))).first()[0]
    assert size > 6_000_000

    def read():
        stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
        return sum(x.getBytesRead() for x in stats if x.getScheme() == "file")

    before = read()
    wanted = spark.createDataFrame([(f"org,h7)/ü", 7)], "key string, page_id long")
    found = warc.read_records(warc.lookup(wanted, index), archives, payloads=True).collect()
    assert [(r.page_id, r.url, bytes(r.payload).decode()) for r in found] == [rows[7]] and read() - before < size / 2
    member = next(bytes(r.data) for r in archives.filter("name = '000000-000000'").collect())
    records = gzip.decompress(member).split(b"WARC/1.1\r\n")[1:]
    names = [re.search(rb"WARC-Record-ID: <urn:uuid:[0-9a-f-]{36}>", r)[0] for r in records]
    assert len({*names}) == len(records) and all(rb"%C3%BC" in r and b"\r\n\r\nHTTP/1.1 200 OK\r\n" in r for r in records)


def test_texts_beyond_24_bits_of_places(spark):
    importable(spark)
    rng = np.random.default_rng(5)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    tail, edge = letters(5_000), "ab" * 400
    long = letters((1 << 24) - 400) + edge + letters(100_000) + tail
    rows = [(1, long), (2, letters(300) + tail + letters(300)), (3, letters(300) + edge + letters(300))]
    info, partly = suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: suffix_dedup._cover(len(r.text), r.low, r.high) for r in partly.collect()}
    assert got == {1: [((1 << 24) - 400, (1 << 24) + 400), (len(long) - 5_000, len(long))], 2: [(300, 5_300)], 3: [(300, 1_100)]} and info.count() == 3


def test_slices_give_the_anchors_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 99, n, dtype=np.uint8).tobytes() + b"x" * 500 for n in (0, 10, 3_000, 9_000)]
    whole = [[x.tolist() for x in parts] for parts in suffix_dedup.anchors(texts)]
    for size in (1, 333, 5_000):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        assert [[x.tolist() for x in parts] for parts in suffix_dedup.anchors(texts)] == whole
