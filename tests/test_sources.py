"""Sources, sinks and lookups on files in a temporary folder."""

import json
import random
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from spanforge.functions import text
from spanforge.queries import QUERIES
from spanforge.session import BATCH_BYTES, importable, table
from spanforge.sources import files, labels, lookups, sinks


def test_csv_exports_check_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n1, \n")
    (tmp_path / "b.csv").write_text('x,y\n2,"q, r"\n')
    got = files.csv_exports(spark, f"{tmp_path}/b.csv", ["x", "y"]).collect()
    assert [(r.x, r.y, r.source_file) for r in got] == [("2", "q, r", "b.csv")]
    with pytest.raises(files.SchemaDrift):
        files.csv_exports(spark, f"{tmp_path}/b.csv", ["x", "z"])


def test_missing_json_is_empty(spark, tmp_path):
    assert files.json_array(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "some.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.json_array(spark, f"{tmp_path}/some.json", "a int").count() == 2


def test_vintage_tables(spark, tmp_path):
    (tmp_path / "ACSDT5Y2019.B1.csv").write_text("GEO_ID,M\nGeography,Label\n860Z200US10001,5\n")
    got = files.vintage_table(spark, f"{tmp_path}/*.csv", {"M": "m"}).collect()
    assert [(r.year, r.place, r.m) for r in got] == [(2019, "10001", 5.0)]


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "T5Y2019.csv").write_text("GEO_ID,M,N\nGeography,a,b\n860Z200US10001,5,7\n")
    (tmp_path / "T5Y2020.csv").write_text('GEO_ID,X,N,M\nGeography,a,b,c\n860Z200US10001,0,"250,000+",-\n')
    got = files.vintage_table(spark, f"{tmp_path}/*.csv", {"M": "m", "N": "n"}).orderBy("year").collect()
    assert [(r.year, r.m, r.n) for r in got] == [(2019, 5.0, 7.0), (2020, None, 250000.0)]
    (tmp_path / "T5Y2021.csv").write_text("GEO_ID,M\n860Z200US10001,5\n")
    with pytest.raises(files.SchemaDrift):
        files.vintage_table(spark, f"{tmp_path}/*.csv", {"M": "m", "N": "n"})


def test_offsets_point_into_the_text(spark):
    body = "word " * 50
    text = f"banner\nDocument 1 of 2\n  First {body}\nDocument 2 of 2\nSecond {body}"
    for r in files.split_documents(spark.createDataFrame([("k", text)], "k string, t string"), "k", "t").collect():
        assert text[r.offset : r.offset + len(r.block)] == r.block
    linked = f"Head one\nBy A\nhttp://x/1\n{body}\nA | B | C |\nHead two\nhttp://x/2\n{body}\nD | E |\n"
    got = files.split_at_links(spark.createDataFrame([("k", linked)], "k string, t string"), "k", "t").orderBy("position").collect()
    assert [r.block.split("\n")[0] for r in got] == ["Head one", "Head two"] and all(linked[r.offset : r.offset + len(r.block)] == r.block and r.kept for r in got)


def test_repeated_rows_show_in_the_digest(spark, tmp_path):
    once = files.snapshot(spark.createDataFrame([(1,), (2,)], "k int"), f"{tmp_path}/a", "q", "now")
    thrice = files.snapshot(spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int"), f"{tmp_path}/b", "q", "now")
    assert once["digest"] != thrice["digest"] and thrice["rows"] == 4


def test_a_resumed_lookup_gives_every_key_once(spark, tmp_path):
    importable(spark)
    wanted, path = spark.createDataFrame([(1,), (2,), (3,)], "k long"), f"{tmp_path}/answers"
    none = spark.createDataFrame([], "k long, state string, v string")

    def fails(k):
        if k == 3:
            raise OSError("down")
        return {"v": "x"}

    lookups.enriched(wanted, none, "k", fails, "v string", path)
    done = spark.read.parquet(path)
    got = [(r.k, r.state) for r in lookups.enriched(wanted, done, "k", lambda k: {"v": "y"}, "v string", path).orderBy("k").collect()]
    assert got == [(1, "found"), (2, "found"), (3, "found")]


def test_snapshot_and_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    manifest = files.snapshot(df, str(tmp_path / "s"), "select", "2020-01-01")
    rows, again = files.load_snapshot(spark, str(tmp_path / "s"))
    assert rows.count() == 2 and again == manifest and manifest["rows"] == 2
    sinks.write_split(df.withColumn("tag", F.when(F.col("v").isNull(), "reject").otherwise("keep")), "tag", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_folder_to_articles(spark, tmp_path):
    importable(spark)
    body = "word " * 60
    (tmp_path / "one.txt").write_text(f"Document 1 of 2\nTitle: First\nSource: Paper\nDate: March 3, 2020\nBody: {body}\nDocument 2 of 2\nshort\n")
    (tmp_path / "copy.txt").write_text((tmp_path / "one.txt").read_text())
    (tmp_path / "odd.doc").write_bytes(b"\0\1")
    (tmp_path / "page.html").write_text("<p>hello</p>")
    found = files.collected_files(spark, str(tmp_path), ["txt", "html", "rtf", "docx", "pdf"])
    assert sorted((r.name, r.outcome) for r in found.collect()) == [("copy.txt", "copied"), ("odd.doc", "skipped"), ("one.txt", "duplicate"), ("page.html", "copied")]
    texts = files.texts_of(found)
    assert texts.filter("error IS NOT NULL").count() == 0
    blocks = files.split_documents(texts.filter("path LIKE '%txt'"), "path", "text")
    article = files.parse_documents(blocks.filter("kept"), "block").first()
    assert (article.title, article.publication, str(article.date)) == ("First", "Paper", "2020-03-03") and article.problems == []
    assert blocks.filter("NOT kept").count() == 2


def test_inline_entries(spark):
    got = spark.createDataFrame([("Big Dome | Erie, PA | 2004",), ("Only",)], "e string").select(files.inline_entry(F.col("e")).alias("x")).collect()
    assert tuple(got[0].x) == ("Big Dome", "Erie", "PA", 2004) and tuple(got[1].x) == ("Only", None, None, None)


def test_lookups_resume_and_keep_failures(spark):
    importable(spark)
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    done = spark.createDataFrame([(1, "found", "x"), (2, "failed", None)], "k long, state string, v string")

    def look(k):
        if k == 3:
            return None
        if k == 4:
            raise RuntimeError
        return {"v": "new"}

    got = {r.k: (r.state, r.v) for r in lookups.enriched(wanted, done, "k", look, "v string").collect()}
    assert got == {1: ("found", "x"), 2: ("found", "new"), 3: ("not found", None), 4: ("failed", None)}
    chunks = lookups.chunked(spark, wanted, "k", 2, lambda ks: [{"k": k, "n": len(ks)} for k in ks], "k long, n int")
    assert chunks.count() == 4


def test_mirrors_fail_over(spark):
    importable(spark)

    def broken(box):
        raise OSError

    got = lookups.partitioned(spark, [(0, 0, 1, 1), (1, 1, 2, 2)], [broken, lambda box: [{"id": 1, "v": box[0]}]], "id long, v double", ["id"])
    assert [(r.id, r.v) for r in got.collect()] == [(1, 1.0)]


def test_extraction_repairs(spark):
    articles = spark.createDataFrame([(1, "T")], "article_id int, title string")
    offered = spark.createDataFrame([(1, ["v1"])], "article_id int, venue_ids array<string>")
    answers = spark.createDataFrame([(1, "v2", "X", "op")], "article_id int, venue_id string, title string, operator string")
    got = lookups.checked_extraction(articles, offered, answers).first()
    assert got.venue_id is None and got.title == "T" and got.repairs == ["venue_id not offered", "title restored"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None, ["a"]), (2, 3.0, 4.0, [])], "k int, x double, y double, l array<string>")
    counters = sinks.write_features(df, str(tmp_path / "g"), "x", "y", ["k"])
    assert counters == {"rows": 2, "without_coordinates": 1}
    assert json.loads(spark.read.text(str(tmp_path / "g/features")).first().value)["geometry"]["coordinates"] == [3.0, 4.0]
    assert sinks.flat(df, ["k", "l"]).first().l == '["a"]'
    assert len(sinks.nested_profile(a=df.select("k"), b=df.select("x")).first().a) == 2
    assert sinks.publish({"t": df}, ["t", "u"], str(tmp_path / "p")) == ["t"]


def test_points_of_a_feature_collection_and_rows_not_loaded(spark, tmp_path):
    (tmp_path / "f.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"a": "x", "n": 3}}, {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"a": null}}]}')
    got = [tuple(r) for r in files.feature_collection(spark, f"{tmp_path}/f.geojson", "a string, n long").collect()]
    assert got == [(1.5, 2.0, "x", 3), (None, None, None, None)]
    (tmp_path / "p.csv").write_text('a,b\n1,"two\nlines"\n3,4\n')
    assert files.row_count(spark, f"{tmp_path}/*.csv") == 2 and files.row_count(spark, f"{tmp_path}/none*.csv") == 0


def test_labels_over_lines(spark):
    written = "Title: A long\n  headline of\n\tthree lines\n\n  lost\nSource : Paper\nTITLE: second\n  not taken\nDate: \n 2001\nplain\n  more\nFull text: Begins here\nTitle: of the body\n\nends"
    rows = spark.createDataFrame([(1, written), (2, ""), (3, None), (4, "a line: with: colons\r\n  and more\r\nx")], "k long, t string").repartition(3)
    found = labels.labels(spark, labels.lines_of(rows, "k", "t").repartition(5))
    got = {(r.document, r.label): (r.value, r.first_line, r.n_lines) for r in found.collect()}
    assert got == {("1", "title"): ("A long headline of three lines", 0, 3), ("1", "source"): ("Paper", 5, 1), ("1", "date"): ("2001 more", 8, 3), ("1", "body"): ("Begins here\nTitle: of the body\n\nends", 12, 4), ("4", "a line"): ("with: colons and more", 0, 2)}
    with pytest.raises(Exception, match="document, line_no"):
        F.udtf(labels.LabelledLines)(rows.asTable()).collect()


def test_labels_of_packed_texts_need_no_shuffle(spark):
    written = "Title: A long\n  headline of\n\tthree lines\n\n  lost\nSource : Paper\nTITLE: second\n  not taken\nDate: \n 2001\nplain\n  more\nFull text: Begins here\nTitle: of the body\n\nends\n"
    rows = spark.createDataFrame([(1, written), (2, ""), (3, None), (4, "a line: with: colons\r\n  and more\r\rx"), (None, "B: c\rbody:\n"), (6, "body: x\u2028y\n\x85")], "k long, t string").repartition(3)
    found = labels.labels_of(rows, "k", "t")
    assert sorted(map(str, found.collect())) == sorted(map(str, labels.labels(spark, labels.lines_of(rows, "k", "t")).collect()))
    plan = QUERIES["wrapped_labels"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_rows_go_to_python_by_bytes(spark):
    """Batches of long texts have a bound in bytes after a table is opened; a lower one of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for set_, want in ((1 << 28, BATCH_BYTES), (1 << 20, 1 << 20)):
            spark.conf.set(key, set_)
            table(spark, SMALL, "documents")
            assert int(spark.conf.get(key)) == want
        spark.conf.set(key, 1 << 28)
        table(spark, SMALL, "documents")
        held = F.pandas_udf(lambda t: pd.Series([int(t.str.len().sum())] * len(t)), "long")
        long = spark.range(300).coalesce(1).select(F.repeat(F.lit("text "), 10_000).alias("text"))
        assert all(r.n <= BATCH_BYTES + 100_000 for r in long.select(held("text").alias("n")).collect())
    finally:
        spark.conf.set(key, before)


def test_texts_are_composed_as_unicode_says(spark):
    importable(spark)
    every = [chr(c) for c in range(0x20, 0x11_0000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[k : k + 3_000]) for k in range(0, 60_000, 3_000)] + ["".join(every[k : k + 1_000]) for k in range(110_000, 140_000, 1_000)]
    marks = [chr(c) for c in range(0x300, 0x370)] + list("aeoAzs한ᄒ") + ["ᅡ", "ᆫ", "ཱ", "ི", "ে", "া"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(marks) for _ in range(40)) for _ in range(300)] + ["", "plain", "\u00e9", "e\u0301"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    got = {r.k: (r.c, r.n) for r in df.select("k", text.composed(F.col("t")).alias("c"), text.normal_text(F.col("t")).alias("n")).collect()}
    assert all(got[k][0] == unicodedata.normalize("NFC", t) for k, t in enumerate(texts)) and got[len(texts)] == (None, None)
    signs = "\u00a0\u2007\u202f\u2060\ufeff\u200b\u200c\u200d"
    one = spark.createDataFrame([(f"{signs}a{signs}b \t\r\n\r\r\n\n  c\n",)], "t string").select(text.normal_text(F.col("t")).alias("n")).first().n
    assert one == "a        b\n\n  c"


def test_headers_of_many_files_are_read_by_one_job(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"a{k:02}.csv").write_text(("x,y\n" if k % 2 else "y,x\n") + "".join(f"{k},{n}\n" for n in range(k * 50)))
    (tmp_path / "b.csv").write_text('"x","odd\nname",y\n1,2,3\n')
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        lines = files.first_lines(spark, f"{tmp_path}/a*.csv")
        assert len(lines) == 12 and set(lines.values()) == {"x,y", "y,x"} and len(tracker.getJobIdsForGroup("headers")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = files.csv_exports(spark, f"{tmp_path}/*.csv", ["x", "y"]).collect()
    assert len(rows) == 50 * sum(range(12)) + 1 and all((r.x if int(r.source_file[1:3]) % 2 else r.y) == str(int(r.source_file[1:3])) for r in rows if r.source_file != "b.csv")
    assert [(r.x, r.y) for r in rows if r.source_file == "b.csv"] == [("1", "3")]
    (tmp_path / "c.csv").write_text("")
    with pytest.raises(files.SchemaDrift, match="c.csv"):
        files.csv_exports(spark, f"{tmp_path}/*.csv", ["x"])
