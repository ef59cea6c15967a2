"""The compositions that SQL does not state, against plain versions."""

import datetime as dt
import math
import random
from collections import defaultdict

from conftest import SMALL
from pyspark.sql import functions as F

from spanforge.functions import geometry
from spanforge.operators import joins, mentions, windows
from spanforge.plans.tenure import CLOSERS, EVENT_KINDS, OPENERS, tenures
from spanforge.queries import QUERIES
from spanforge.session import importable, table


def plain_tenures(events, as_of, days=45, recent=3 * 365):
    """(venue, operator, start, end, status, derived, overlapping spans' derived) of (venue, operator, id, type, date) events."""
    by = defaultdict(list)
    for venue, operator, key, kind, day in events:
        if operator is not None and kind in EVENT_KINDS and day is not None:
            by[venue, operator, EVENT_KINDS[kind]].append((day, key))
    once = defaultdict(list)
    for (venue, operator, kind), rows in by.items():
        groups = []
        for day, key in sorted(rows):  # one precision here, so an occurrence keeps its first date
            if groups and (day - groups[-1][0]).days <= days:
                groups[-1][1].append(key)
            else:
                groups.append((day, [key]))
        once[venue, operator] += [(day, keys[0], kind, keys) for day, keys in groups]
    spans = []
    for (venue, operator), rows in once.items():
        now = []
        for row in sorted(rows):
            now.append(row)
            if row[2] in CLOSERS:
                spans.append((venue, operator, now))
                now = []
        if now:
            spans.append((venue, operator, now))
    made = []
    for venue, operator, rows in spans:
        closed = rows[-1][2] in CLOSERS
        made.append({"venue": venue, "operator": operator, "start": rows[0][0], "end": rows[-1][0] if closed else None, "known": rows[-1][0], "derived": sorted(k for r in rows for k in r[3]), "opened": rows[0][2] in OPENERS})
    for s in made:
        later = sorted(o["start"] for o in made if o["venue"] == s["venue"] and o["operator"] != s["operator"] and o["start"] > s["start"])
        s["final"] = s["end"] or (later[0] if later else None)
        s["status"] = "ended" if s["final"] else "ongoing" if (as_of - s["known"]).days <= recent else "unknown"
    far = dt.date(9999, 12, 31)
    meets = lambda a, b: a is not b and a["venue"] == b["venue"] and a["operator"] != b["operator"] and a["start"] < (b["final"] or far) and b["start"] < (a["final"] or far)
    return sorted((s["venue"], s["operator"], s["start"], s["final"], s["status"], tuple(s["derived"]), tuple(sorted(tuple(o["derived"]) for o in made if meets(s, o)))) for s in made)


def test_tenures(spark):
    rng = random.Random(7)
    events = [(rng.randrange(4), rng.choice(["a", "b", None, "c"]), k, rng.choice([*EVENT_KINDS, "other"]), dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(1500)) if rng.random() < 0.95 else None) for k in range(160)]
    rows = spark.createDataFrame([(*e, "exact") for e in events], "venue_id long, operator string, event_id long, event_type string, event_date date, date_precision string")
    got = tenures(rows, F.lit("2024-03-01").cast("date")).collect()
    derived = {r.tenure_id: tuple(r.derived_from) for r in got}
    mine = sorted((r.venue_id, r.operator, r.start, r.end, r.end_status, tuple(r.derived_from), tuple(sorted(derived[o] for o in r.overlaps_with))) for r in got)
    assert mine == plain_tenures(events, dt.date(2024, 3, 1))


def test_streamed_spans(spark):
    importable(spark)
    events = table(spark, SMALL, "events").orderBy("ts", "event_id").collect()
    want, open_ = [], {}
    for r in events:
        n, started = open_.get(r.user_id, (0, r.ts))
        if r.event_type in ("purchase", "error"):
            want.append((r.user_id, n + 1))
            open_.pop(r.user_id, None)
        else:
            open_[r.user_id] = (n + 1, started)
    got = sorted((r.user_id, r.n_events) for r in QUERIES["streamed_spans"](spark, SMALL).collect() if r.status == "ended")
    assert got == sorted(want)


def test_spine_merges_near_places_of_one_name(spark):
    found = QUERIES["spine_build"](spark, SMALL).collect()
    parts, suppliers = table(spark, SMALL, "part").collect(), table(spark, SMALL, "supplier").count()
    entities = {r.p_partkey % 500 for r in parts}
    unseen = sum(9 * k not in entities for k in range(1, suppliers + 1))
    assert len(found) + sum(r.merged for r in found) == len(entities) + unseen and len({r.venue_id for r in found}) == len(found)


def test_pages_as_text(spark):
    importable(spark)
    got = QUERIES["html_to_text"](spark, SMALL).collect()
    assert len(got) == table(spark, SMALL, "pages").count() and not any("<p>" in (r[-1] if isinstance(r[-1], str) else "") for r in got)


def test_simplified_rings(spark):
    rng = random.Random(3)
    points = [(math.cos(a) * (1 + rng.random() / 5), math.sin(a) * (1 + rng.random() / 5)) for a in [k / 10 for k in range(60)]]

    def plain(p, tolerance):
        def away(q, a, b):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0, min(1, ((q[0] - a[0]) * dx + (q[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
            return math.dist(q, (a[0] + t * dx, a[1] + t * dy))

        if len(p) < 3:
            return p
        far = [away(q, p[0], p[-1]) for q in p[1:-1]]
        k = far.index(max(far)) + 1
        return plain(p[: k + 1], tolerance)[:-1] + plain(p[k:], tolerance) if far[k - 1] > tolerance else [p[0], p[-1]]

    for ring in (points, [*points, points[0]], points[:2], points[:1]):
        assert [(q["x"], q["y"]) for q in geometry._thin(ring, 0.1)] == plain(ring, 0.1)


def test_no_operator_broadcasts_the_documents(spark):
    docs = spark.range(100).select(F.lit("a text").alias("text"))
    names = spark.createDataFrame([("text",), ("none",), ("text",)], "name string")
    counts = joins.mention_counts(docs, "text", names, "name")
    assert {r.name: r.n_docs for r in counts.collect()} == {"text": 100, "none": 0}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_mentions_of_many_names(spark):
    importable(spark)
    rng = random.Random(6)
    piece = lambda: "".join(rng.choice(["a", "b", "é", " ", "ß", "x\n", "😀"]) for _ in range(rng.randint(1, 12)))
    texts = ["".join(piece() for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "a" * 50_000]
    names = [piece() for _ in range(400)] + ["", "a" * 60, None, "a"] + [t[k : k + 20] for t in texts[:60] for k in (0, 3)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.size: r.n_docs for r in mentions.mention_counts(docs, "text", spark.createDataFrame([(n,) for n in names], "size string"), "size").collect()}
    assert got == {n: sum(1 for t in texts if t is not None and n in t) for n in names if n is not None}
    for few in ([], ["x"], [""]):
        found = mentions.mention_counts(docs, "text", spark.createDataFrame([(n,) for n in few], "n string"), "n").collect()
        assert {r.n: r.n_docs for r in found} == {n: sum(1 for t in texts if t is not None and n in t) for n in few}


def test_collapse_between_gaps(spark):
    rng = random.Random(5)
    rows = [("k", rng.randrange(400), n, rng.randrange(3)) for n in range(80)]
    got = windows.collapse_duplicates(spark.createDataFrame(rows, "k string, at long, o long, p int"), ["k"], "at", "o", "p", 6)
    want = []
    for _, at, o, p in sorted(rows, key=lambda r: (r[1], r[2])):
        if want and abs(at - want[-1][0]) <= 6:
            d, q, m = want[-1]
            want[-1] = (at if p < q else d, min(p, q), [*m, o])
        else:
            want.append((at, p, [o]))
    assert sorted((r.at, r["rank"], list(r.members)) for r in got.collect()) == sorted(want)


def test_collapse_of_dense_keys_spreads_over_ranges(spark):
    importable(spark)
    rng = random.Random(8)
    rows = [(key, rng.randrange(span), n, rng.randrange(3)) for n, (key, span) in enumerate(rng.choices([("dense", 300), ("dense", 300), ("wide", 9_000), (None, 200), ("é", 40)], k=900))]
    rows += [("dense", None, 5_000, 1), ("dense", None, 5_001, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        df = spark.createDataFrame(rows, "k string, at long, o long, p int")
        found = windows.collapse_duplicates(df, ["k"], "at", "o", "p", 6)
        got = sorted(((str(r.k), r["at"], r["rank"], list(r.members)) for r in found.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = [(str(k), None, p, [o]) for k, at, o, p in rows if at is None]
    for key in ("dense", "wide", None, "é"):
        mine = []
        for _, at, o, p in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2])):
            if mine and abs(at - mine[-1][1]) <= 6:
                _, d, q, m = mine[-1]
                mine[-1] = (str(key), at if p < q else d, min(p, q), [*m, o])
            else:
                mine.append((str(key), at, p, [o]))
        want += mine
    assert got == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert windows.collapse_duplicates(df.limit(0), ["k"], "at", "o", "p", 6).count() == 0


def test_proximity_by_parts_is_that_of_the_whole(spark):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), k, rng.choice([10.0, 40.0, 40.2]) + rng.random() / 40, rng.choice([-75.0, -70.0, 179.99]) + rng.random() / 40) for k in range(150)] + [("a", 200, None, None), ("a", 201, None, 1.0)]
    got = {r.k: r.kept_id for r in windows.greedy_proximity(spark.createDataFrame(rows, "name string, k long, lat double, lng double"), "name", "k", "lat", "lng", "k", 1.0).collect()}

    def km(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    kept, want = [], {}
    for row in rows:
        near = [o for o in kept if o[0] == row[0] and None not in (row[2], row[3], o[2], o[3]) and km(o, row) < 1]
        want[row[1]] = near[0][1] if near else row[1]
        kept += [] if near else [row]
    assert got == want


def test_collapse_of_number_keys_goes_on_over_range_borders(spark):
    """One occurrence of a whole-number key lies over all ranges; what is open at a range's end is carried into the next."""
    df = spark.createDataFrame([(7, i * 10, i, 1 + (i + 1) % 2) for i in range(400)], "k int, at long, o long, p int")
    previous = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [r.members for r in windows.collapse_duplicates(df, ["k"], "at", "o", "p", 4000).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", previous)
    assert found == [list(range(400))]


def test_shared_keys_are_counted_without_a_guessed_broadcast(spark):
    from spanforge.queries import QUERIES

    plan = QUERIES["spine_keys"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == plan.count("LeftOuter")  # the names of places; the owners of keys come by shuffle
