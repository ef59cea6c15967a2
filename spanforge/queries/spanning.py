"""Dedupes, duplicate collapse, span folding and what is read from spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import numbers
from spanforge.operators import classify, joins, windows
from spanforge.plans.tenure import EVENT_KINDS, tenures
from spanforge.queries.joining import order_spans
from spanforge.queries.registry import query
from spanforge.session import table

SIX_HOURS = 6 * 3600 * 1_000_000
COLLAPSED = f"""
    WITH l AS (SELECT user_id, event_type, list([{{'d': epoch_us(ts), 'p': (floor(value)::BIGINT % 4)::INT, 'm': [event_id]}}] ORDER BY epoch_us(ts), event_id) AS l FROM events GROUP BY 1, 2),
    f AS (SELECT user_id, event_type, list_reduce(l, lambda a, x: CASE WHEN abs(x[1].d - a[-1].d) <= {SIX_HOURS}
        THEN list_concat(a[:-2], [{{'d': CASE WHEN x[1].p < a[-1].p THEN x[1].d ELSE a[-1].d END, 'p': least(a[-1].p, x[1].p), 'm': list_concat(a[-1].m, x[1].m)}}]) ELSE list_concat(a, x) END) AS o FROM l)
    SELECT user_id, event_type, x.d AS "at", x.p AS rank, array_to_string(x.m, ',') AS members FROM (SELECT user_id, event_type, unnest(o) AS x FROM f)"""


@query("duplicate_collapse_anchored", COLLAPSED)
def duplicate_collapse_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("p", (F.floor("value") % 4).cast("int"))
    found = windows.collapse_duplicates(events, ["user_id", "event_type"], "us", "event_id", "p", SIX_HOURS)
    return found.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


MACHINE = """
    WITH e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d, CASE event_type WHEN 'signup' THEN 'won' WHEN 'view' THEN 'renewed' WHEN 'click' THEN 'presence' WHEN 'purchase' THEN 'expired' ELSE 'lost' END AS kind FROM events),
    n AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('expired', 'lost') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span_no FROM e),
    s AS (SELECT user_id, span_no::BIGINT AS span_no, min(d) AS start, max(CASE WHEN kind IN ('expired', 'lost') THEN d END) AS "end", arg_min(kind, {'d': d, 'i': event_id}) IN ('won', 'renewed') AS opened, max(d) AS known_through, count(*) AS n_events, arg_max(kind, {'d': d, 'i': event_id}) AS last_kind FROM n GROUP BY user_id, span_no)"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [F.lit(x) for item in EVENT_KINDS.items() for x in item]
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.to_date("ts").alias("d"), F.create_map(*pairs)[F.col("event_type")].alias("kind"))


@query("span_state_machine", MACHINE + """ SELECT user_id, span_no, start, "end", opened, known_through, n_events, last_kind,
    CASE WHEN "end" IS NOT NULL THEN 'ended' WHEN date_diff('day', known_through, DATE '2024-03-01') <= 45 THEN 'ongoing' ELSE 'unknown' END AS status FROM s""")
def span_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = windows.build_spans(kinds(spark, sf_dir), ["user_id"], "d", "event_id", "kind", ["won", "renewed"], ["expired", "lost"])
    return spans.withColumn("status", windows.end_status(F.col("end"), F.col("known_through"), F.lit("2024-03-01").cast("date"), 45))


@query("render_windows", MACHINE + """ SELECT user_id, span_no, year(start)::INT AS y0, (CASE WHEN "end" IS NOT NULL THEN year("end") WHEN date_diff('day', known_through, DATE '2024-03-01') <= 45 THEN 9999 ELSE year(known_through) END)::INT AS y1 FROM s""")
def render_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = span_state_machine(spark, sf_dir)
    low, high = classify.render_window(F.col("start"), F.col("end"), F.col("known_through"), F.col("status"))
    return spans.select("user_id", "span_no", low.alias("y0"), high.alias("y1"))


TENURES = """
    WITH e AS (SELECT user_id % 40 AS venue_id, 'op' || (user_id % 3)::VARCHAR AS operator, event_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS d,
        CASE event_type WHEN 'signup' THEN 'won' WHEN 'view' THEN 'renewed' WHEN 'click' THEN 'presence' WHEN 'purchase' THEN 'expired' ELSE 'lost' END AS kind FROM events),
    l AS (SELECT venue_id, operator, kind, list([{'d': d, 'm': [event_id]}] ORDER BY d, event_id) AS l FROM e GROUP BY ALL),
    o AS (SELECT venue_id, operator, kind, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1].d - a[-1].d <= 45 THEN list_concat(a[:-2], [{'d': a[-1].d, 'm': list_concat(a[-1].m, x[1].m)}]) ELSE list_concat(a, x) END)) AS x FROM l),
    n AS (SELECT *, coalesce(sum((kind IN ('expired', 'lost'))::INT) OVER (PARTITION BY venue_id, operator ORDER BY x.d, x.m[1] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span_no FROM o),
    g AS (SELECT venue_id, operator, min(x.d) AS s, max(CASE WHEN kind IN ('expired', 'lost') THEN x.d END) AS e, arg_min(kind, {'d': x.d, 'i': x.m[1]}) IN ('won', 'renewed') AS opened, max(x.d) AS known, count(*) AS n_events,
        array_to_string(list_sort(flatten(list(x.m))), ',') AS derived_from FROM n GROUP BY venue_id, operator, span_no),
    i AS (SELECT *, 'sp-' || left(sha256(venue_id::VARCHAR || '|' || operator || '|' || derived_from), 10) AS tenure_id FROM g),
    f AS (SELECT i.*, (SELECT min({'s': b.s, 't': b.tenure_id, 'o': b.operator}) FROM i b WHERE b.venue_id = i.venue_id AND b.operator <> i.operator AND b.s > i.s) AS nx FROM i),
    w AS (SELECT * EXCLUDE (e), e IS NULL AND nx IS NOT NULL AS inferred, coalesce(e, nx.s) AS e FROM f),
    v AS (SELECT a.tenure_id, array_to_string(list(DISTINCT b.tenure_id ORDER BY b.tenure_id), ',') AS overlaps_with FROM w a JOIN w b ON a.venue_id = b.venue_id AND a.operator <> b.operator AND a.tenure_id <> b.tenure_id
        AND a.s < coalesce(b.e, 9999999) AND b.s < coalesce(a.e, 9999999) GROUP BY 1)
    SELECT tenure_id, venue_id, operator, DATE '1970-01-01' + s::INT AS start, DATE '1970-01-01' + e::INT AS "end",
        CASE WHEN e IS NOT NULL THEN 'ended' WHEN date_diff('day', DATE '1970-01-01' + known::INT, DATE '2024-03-01') <= 1095 THEN 'ongoing' ELSE 'unknown' END AS end_status, DATE '1970-01-01' + known::INT AS known_through, n_events,
        CASE WHEN inferred THEN 'succession' END AS end_inferred_from, CASE WHEN inferred THEN nx.o END AS succeeded_by, coalesce(overlaps_with, '') AS overlaps_with, derived_from,
        concat_ws('; ', CASE WHEN NOT opened THEN 'start inferred' END, CASE WHEN inferred THEN 'end inferred' END, CASE WHEN overlaps_with IS NOT NULL THEN 'overlap' END) AS review_reasons
    FROM w LEFT JOIN v USING (tenure_id)"""


@query("tenure_end_to_end", TENURES)
def tenure_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("venue_id"), F.concat(F.lit("op"), F.col("user_id") % 3).alias("operator"), "event_id", "event_type", F.to_date("ts").alias("event_date"), F.lit("exact").alias("date_precision"))
    return tenures(events, F.lit("2024-03-01").cast("date")).withColumn("derived_from", F.array_join(F.transform("derived_from", lambda x: x.cast("string")), ",")).withColumn("overlaps_with", F.array_join("overlaps_with", ","))


@query("first_wins_dedupe", "SELECT min(doc_id) AS doc_id, count(*) - 1 AS duplicates FROM documents GROUP BY text")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("duplicates")).drop("digest")


@query("last_wins_dedupe", "SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM orders GROUP BY 1")
def last_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_wins(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("best_alias_search", """
    WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, CASE WHEN name = 'red' THEN 0 WHEN starts_with(name, 'red') THEN 1 WHEN contains(' ' || name, ' red') THEN 2 WHEN contains(name, 'red') THEN 3 END AS score FROM n)
    SELECT name, score, row_number() OVER (ORDER BY score, name)::INT AS rank FROM s WHERE score IS NOT NULL ORDER BY score, name LIMIT 8""")
def best_alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    from spanforge.functions.text import expanded

    needle = expanded(F.lit("rd"), {"rd": "red"})
    name = F.col("name")
    score = F.when(name == needle, 0).when(name.startswith(needle), 1).when(F.concat(F.lit(" "), name).contains(F.concat(F.lit(" "), needle)), 2).when(name.contains(needle), 3)
    best = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("score", score).filter("score IS NOT NULL").orderBy("score", "name").limit(8)
    return best.withColumn("rank", F.row_number().over(W.orderBy("score", "name")))


@query("handoff_or_contested", """
    WITH s AS (SELECT o_custkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS st, (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem WHERE l_orderkey = o_orderkey) AS en FROM orders),
    m AS (SELECT *, coalesce(coalesce(en, DATE '9999-12-31') > lead(st) OVER (PARTITION BY o_custkey ORDER BY st, o_orderkey), false) AS past FROM s),
    g AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_holders, bool_or(past) AS past, arg_max(o_orderpriority, {'s': st, 'k': o_orderkey}) AS last FROM m GROUP BY 1)
    SELECT o_custkey, CASE WHEN NOT (n_holders > 1 AND past) THEN last END AS holder, n_holders, n_holders > 1 AND past AS contested FROM g""")
def handoff_or_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.handoff_or_contested(order_spans(spark, sf_dir), "o_custkey", "o_orderpriority", "start", "end", "o_orderkey")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on a grid of invented coordinates."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.lit(40.0) + F.col("c_custkey") % 13 / 400).alias("lat"), (F.lit(-75.0) + F.col("c_custkey") % 7 / 300).alias("lng"))


@query("greedy_proximity")
def greedy_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.greedy_proximity(places(spark, sf_dir), "c_nationkey", "c_custkey", "lat", "lng", "c_custkey", 1.0)


@query("pairwise_distance", """
    WITH p AS (SELECT c_custkey, c_nationkey, 40.0::DOUBLE + (c_custkey % 13) / 400.0::DOUBLE AS lat, -75.0::DOUBLE + (c_custkey % 7) / 300.0::DOUBLE AS lng FROM customer)
    SELECT a.c_custkey AS a, b.c_custkey AS b, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))), 3) AS km
    FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND b.c_custkey = a.c_custkey + 25""")
def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = places(spark, sf_dir).select(F.col("c_custkey").alias("a"), "c_nationkey", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), (F.col("c_custkey") + 25).alias("b"))
    b = places(spark, sf_dir).select(F.col("c_custkey").alias("b"), "c_nationkey", "lat", "lng")
    km = numbers.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat"), F.col("lng"))
    return a.join(b, ["c_nationkey", "b"]).select("a", "b", F.round(km, 3).alias("km"))


@query("fill_forward_labels", """
    SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS label FROM events""")
def fill_forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("label"))
    return windows.fill_forward(marked, ["user_id"], "event_id", "label")


@query("labels_until_reset", """
    WITH c AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS s, max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS e FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, CASE WHEN e IS NULL OR s >= e THEN s END AS label FROM c""")
def labels_until_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup, until an error forgets it."""
    marked = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("label"))
    return windows.fill_forward(marked, ["user_id"], "event_id", "label", F.col("event_type") == "error").drop("event_type")


@query("boundary_pairs", "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders")
def boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_next(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("visible_at_years", """
    WITH s AS (SELECT year(o_orderdate) AS y0, (SELECT year(max(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey) AS y1 FROM orders)
    SELECT y::INT AS year, count(y0) AS n FROM (VALUES (1990), (1997), (2001)) v(y) LEFT JOIN s ON y0 <= y AND coalesce(y1, 9999) >= y GROUP BY 1""")
def visible_at_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.createDataFrame([(1990,), (1997,), (2001,)], "year int")
    spans = order_spans(spark, sf_dir).select(F.year("start").alias("y0"), F.year("end").alias("y1"))
    counts = joins.holders_by_year(spans, years, "y0", "y1").groupBy("year").agg(F.count("*").alias("n"))
    return years.join(counts, "year", "left").fillna(0, ["n"])
