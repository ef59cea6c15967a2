"""Operators on small hand-made tables."""

import io
import zipfile
import datetime as dt
import random

from pyspark.sql import functions as F

from spanforge.functions import dates, documents, geometry, numbers, text
from spanforge.operators import aggregates, classify, joins, validate, windows
from spanforge.plans import tenure
from spanforge.session import importable


def one(spark, column):
    importable(spark)
    return spark.range(1).select(column.alias("x")).first().x


def day(s):
    return None if s is None else dt.date.fromisoformat(s)


def test_anchor_moves_with_a_finer_member(spark):
    rows = [(1, 0, 1, 1), (1, 40, 2, 1), (1, 80, 3, 1), (2, 0, 4, 1), (2, 40, 5, 0), (2, 80, 6, 1)]
    df = spark.createDataFrame(rows, "k int, d long, i long, p int")
    got = {(r.k, r["at"]): r.members for r in windows.collapse_duplicates(df, ["k"], "d", "i", "p", 45).collect()}
    assert got == {(1, 0): [1, 2], (1, 80): [3], (2, 40): [4, 5, 6]}


def test_spans_close_and_reopen(spark):
    rows = [(1, 1, "won"), (1, 2, "presence"), (1, 3, "lost"), (1, 4, "renewed"), (2, 1, "presence"), (2, 2, "expired")]
    df = spark.createDataFrame(rows, "v int, d int, kind string").withColumn("o", F.col("d"))
    got = sorted((r.v, r.span_no, r.start, r.end, r.opened, r.n_events) for r in windows.build_spans(df, ["v"], "d", "o", "kind", ["won", "renewed"], ["lost", "expired"]).collect())
    assert got == [(1, 0, 1, 3, True, 3), (1, 1, 4, None, True, 1), (2, 0, 1, 2, False, 2)]


def test_tenures_account_for_every_event(spark):
    rows = [(1, "a", 1, "signup", day("2020-01-01")), (1, "a", 2, "signup", day("2020-01-20")), (1, "b", 3, "signup", day("2021-05-01")), (1, None, 4, "view", day("2021-05-01")), (1, "b", 5, "odd", day("2021-06-01")), (2, "a", 6, "view", None)]
    df = spark.createDataFrame(rows, "venue_id int, operator string, event_id long, event_type string, event_date date").withColumn("date_precision", F.lit("exact"))
    spans = tenure.tenures(df, F.lit("2022-01-01").cast("date"))
    got = {r.operator: r for r in spans.collect()}
    assert got["a"].end == day("2021-05-01") and got["a"].end_inferred_from == "succession" and got["a"].succeeded_by == "b"
    assert got["a"].derived_from == [1, 2] and got["b"].end_status == "ongoing"
    assert tenure.accounting(df, spans).first().asDict() == {"n": 6, "unusable": 2, "undated": 1, "paired": 3, "unaccounted": 0}


def test_dates_of_many_forms(spark):
    for written, wanted in [("March 3, 2020", "2020-03-03"), ("3 Mar 2020", "2020-03-03"), ("2020-03-03", "2020-03-03"), ("3/3/2020", "2020-03-03"), ("March 2020", None), ("2020-03", None), ("2020-02-31", None), ("", None)]:
        assert one(spark, dates.flexible_date(F.lit(written))) == day(wanted)
    assert one(spark, dates.knowledge_base_date(F.lit("+1999-00-00T00:00:00Z"))) == day("1999-01-01")
    assert one(spark, dates.knowledge_base_date(F.lit("+0000-00-00T00:00:00Z"))) is None


def test_numbers(spark):
    cases = [("250,000+", 250000.0), ("2,500-", 2500.0), ("-", None), ("-666666666", None), ("", None), ("12", 12.0)]
    for written, wanted in cases:
        assert one(spark, numbers.coded_number(F.lit(written))) == wanted
    low, high = numbers.wilson(F.lit(14), F.lit(20))
    assert (one(spark, low), one(spark, high)) == (0.481, 0.855)
    assert [one(spark, x) for x in numbers.wilson(F.lit(0), F.lit(0))] == [0.0, 1.0]
    assert one(spark, numbers.bucket_of(F.lit(5.0), [1, 5, 9])) == 2
    assert one(spark, numbers.share(F.lit(1.0), F.lit(0.0))) is None


def test_text_keys(spark):
    assert one(spark, text.match_key(F.lit("The Café – “Étoile” No. 5"))) == "cafe etoile no 5"
    assert one(spark, text.company_key(F.lit("Bon Appétit Group, Inc."))) == "bon appetit"
    assert one(spark, text.packed_parts(F.lit("Big Arena, Old Dome; x"))) == ["Big Arena, Old Dome; x", "Big Arena", "Old Dome"]
    assert one(spark, text.strict_parts(F.lit("Big Arena, Old Dome Arena"), ("arena",))) == ["Big Arena", "Old Dome Arena"]
    assert one(spark, text.rewritten_forms(F.lit("a x x"), [("x$", "")])) == ["a x x", "a x", "a"]
    assert one(spark, text.name_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert one(spark, text.compact_money(F.lit(5.04e9))) == "$5.0B"
    assert one(spark, text.host(F.lit("no url"))) is None


def test_documents_to_text():
    assert documents.html_text("<head><title>x</title></head><p>a&amp;b</p><script>no</script><p>c") == "a&b\n\nc"
    assert documents.rtf_text(rb"{\rtf1{\fonttbl x}a\bin3 }}}b\par c}") == "ab\nc"
    assert documents.decoded("é".encode("cp1252")) == "é" and documents.decoded("\ufeffé".encode()) == "é" and documents.decoded(b"\xe9\x81") == "é\x81"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one &amp; </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    assert documents.docx_text(packed.getvalue()) == "one & two\n\nthree"


def test_capitalised_within_a_sentence(spark):
    df = spark.createDataFrame([("We met at Paradise today.", "paradise"), ("Paradise. It was paradise.", "paradise")], "t string, w string")
    importable(spark)
    assert [r.x for r in df.select(documents.appears_capitalised(F.col("t"), F.col("w")).alias("x")).collect()] == [True, False]


def test_phrases_alias_and_crosswalk(spark):
    docs = spark.createDataFrame([(1, "at the red dome now".split()), (2, "red red dome".split()), (3, [])], "d int, w array<string>")
    keys = spark.createDataFrame([("red dome", ["red", "dome"]), ("dome now here", ["dome", "now", "here"])], "k string, t array<string>")
    got = sorted((r.d, r.k, r.n, r.first_at) for r in joins.phrase_join(docs, "d", "w", keys, "k", "t").collect())
    assert got == [(1, "red dome", 1, 2), (2, "red dome", 1, 1)]
    names = spark.createDataFrame([("acme west",), ("the acme",), ("other",)], "name string")
    aliases = spark.createDataFrame([("acme", "A", False, 0), ("west", "W", True, 1)], "alias string, operator string, distinctive boolean, ord int")
    assert {r.name: r.operator for r in joins.alias_match(names, "name", aliases).collect()} == {"acme west": "A", "the acme": None, "other": None}


def test_overrides_keep_nulls_of_the_right_side(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted((r.k, r.v, r.overridden) for r in joins.override_join(left, right, "k", ["v"]).collect()) == [(1, None, True), (2, "b", False)]


def test_narrowing_required_and_optional(spark):
    rows = [("q", 1, True, False), ("q", 2, True, False), ("q", 3, False, True), ("r", 1, False, True)]
    df = spark.createDataFrame(rows, "q string, v int, state boolean, city boolean")
    got = sorted((r.q, r.v, r.n_left) for r in joins.narrowed(df, "q", [("state", False), ("city", True)]).collect())
    assert got == [("q", 1, 2), ("q", 2, 2)]


def test_first_match_and_bands(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,)], "v double")
    assert [r.state for r in classify.band_filter(df, "v", [0, 5], [1]).collect()] == ["matched", "unknown", "out"]
    assert one(spark, classify.first_match([(F.lit(None).cast("boolean"), "a"), (F.lit(True), "b")], "c")) == "b"


def test_greedy_proximity_is_not_transitive(spark):
    rows = [("n", 1, 0.0, 0.0), ("n", 2, 0.006, 0.0), ("n", 3, 0.012, 0.0)]
    importable(spark)
    got = windows.greedy_proximity(spark.createDataFrame(rows, "k string, i long, lat double, lng double"), "k", "i", "lat", "lng", "i", 1.0)
    assert {r.i: r.kept_id for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_validation(spark):
    fields = [validate.Field("a", "enum", True, ("x",)), validate.Field("d", "date")]
    df = spark.createDataFrame([("x", "2020-01-01", 1), ("y", "2020", 1), (None, None, 1)], "a string, d string, z int")
    assert [r.p for r in df.select(validate.problems(df, fields).alias("p")).collect()] == [["z: unknown field"], ["a: not in list", "d: not a date", "z: unknown field"], ["a: missing", "z: unknown field"]]
    assert validate.json_schema(fields)["additionalProperties"] is False
    assert aggregates.invariants(df, {"a": F.col("z") == 1}).first().a is True


def test_geometry(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4)]))
    assert one(spark, geometry.signed_area(ring)) == 16.0
    assert one(spark, geometry.ring_contains(ring, F.lit(1.0), F.lit(1.0))) is True
    assert one(spark, geometry.distance_to_ring(ring, F.lit(6.0), F.lit(2.0))) == 2.0
    assert len(one(spark, geometry.simplified(geometry.closed_ring(ring), 0.1))) == 5


def test_succession_of_runs_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.choice([None, *range(12)]), k) for k in range(150)]
    rows += [("run", "x", k, 1_000 + k) for k in range(30)] + [("run", "y", 30, 2_000), ("run", "x", 30, 1_999)]
    got = {r.o: (r.next_start, r.next_holder) for r in joins.succession(spark.createDataFrame(rows, "e string, h string, s int, o int"), "e", "h", "s", "o").collect()}
    for e, h, s, o in rows:
        later = [(t, p, g) for f, g, t, p in rows if None not in (e, h, s, g, t) and f == e and t > s and g != h]
        best = min(later, default=(None, None, None))
        assert got[o] == (best[0], best[2]), (e, h, s, o)
    assert len(got) == len(rows)


def test_succession_gathers_no_rows(spark):
    """A row for each start is all that one entity's rows become, so that none holds them all."""
    spans = spark.range(20).selectExpr("1 AS e", "CAST(id % 3 AS string) AS h", "id AS s", "id AS o")
    plan = joins.succession(spans, "e", "h", "s", "o")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_dates_written_in_texts(spark):
    cases = {
        "Erie, March 3rd, 2001 Thursday": ("2001-03-03", False), "on 03 Sept. 2001: B.1": ("2001-09-03", False), "3rd may, 2001": ("2001-05-03", False), "dec. 25 1999": ("1999-12-25", False),
        "2001-02-03 10:00": ("2001-02-03", False), "(printed 2/3/2001)": ("2001-02-03", False), "2/3/2001, then June 1, 2000": ("2000-06-01", False), "June 1, 2000 and May 2, 2000": ("2000-06-01", False),
        "June 2001": (None, True), "Marchand 2001": (None, False), "maybe 2001": (None, False), "Marchand 3, 2001": (None, False), "xMay 3, 2001": (None, False), "éMay 3, 2001": (None, False),
        "February 31, 2001 or 2001-02-03": (None, False), "13/45/2001": (None, False), "May 3, 20011": (None, False), "a2001-02-03": (None, False), "2001-02-03_x": (None, False), "": (None, False), "no date": (None, False),
        "June. 2001 and 5/6/2002": ("2002-05-06", False), "January 5 th, 2001": (None, False), "12 dec 1999st": (None, False),
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", dates.date_within(F.col("t")).alias("d"), dates.month_only(F.col("t")).alias("m"))
    got = {r.t: (None if r.d is None else str(r.d), r.m) for r in df.collect()}
    assert {t: v for t, v in got.items() if t is not None} == cases and got[None][0] is None


def test_full_folding_drops_all_marks(spark):
    importable(spark)
    cases = {"ﬁne": "fine", "été": "ete", "Ångström": "Angstrom", "①": "1", "": "", None: None, "plain": "plain"}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", documents.nfkd_fold(F.col("t")).alias("f"))
    assert {r.t: r.f for r in df.collect()} == cases


def test_rows_are_numbered_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), k) for k in rng.sample(range(5_000), 600)]
    got = windows.numbered(spark.createDataFrame(rows, "k string, o int"), ["k"], "o")
    want = {(k, o): n for key in ("a", "b", None) for n, (k, o) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]))}
    assert {(r.k, r.o): r.place for r in got.collect()} == want


def test_article_beside_letters_outside_ascii_is_no_part_of_a_key(spark):
    assert one(spark, text.match_key(F.lit("\u03a9the b_the \u00e6The\u00e6 soothe"))) == "b the soothe"


def test_marks_beside_their_letter_leave_a_key(spark):
    assert one(spark, text.match_key(F.lit("Cafe\u0301 Zu\u0308rich"))) == "cafe zurich"
