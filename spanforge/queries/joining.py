"""Joins: overrides, phrases, narrowing, intervals, tolerances, nearest, crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import dates, text
from spanforge.operators import joins, windows
from spanforge.queries.registry import query
from spanforge.session import spread, table



@query("left_join_override", """
    SELECT c_custkey, CASE WHEN n.n_nationkey IS NOT NULL THEN CASE WHEN n_regionkey = 2 THEN NULL ELSE n_name END ELSE c_mktsegment END AS place, n.n_nationkey IS NOT NULL AS overridden
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 0) n ON c_nationkey = n_nationkey""")
def left_join_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "nation").filter("n_regionkey > 0").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("place"))
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("place"))
    return joins.override_join(left, right, "k", ["place"]).select("c_custkey", "place", "overridden")


@query("anti_join_seen", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("semi_join_rings", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("children_array", """
    SELECT n_nationkey, coalesce(array_to_string(list_transform(list_sort(list({'k': s_suppkey, 'n': s_name}) FILTER (WHERE s_suppkey IS NOT NULL)), lambda x: x.n), ','), '') AS suppliers
    FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1""")
def children_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    found = joins.children_join(table(spark, sf_dir, "nation"), suppliers, "n_nationkey", F.col("s_name"), "suppliers", ["s_suppkey"])
    return found.select("n_nationkey", F.array_join("suppliers", ",").alias("suppliers"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of any length: each benchmark item as a whole, and its first three words."""
    items = table(spark, sf_dir, "benchmark").select(F.split(text.match_key(F.col("text")), " ").alias("w")).filter(F.size("w") >= 3)
    both = items.select(F.explode(F.array("w", F.slice("w", 1, 3))).alias("key_tokens")).distinct()
    return both.withColumn("key", F.array_join("key_tokens", " "))


def phrase_hits(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, key, n, first_at) of (doc_id, tokens): longer phrases for each document, counted apart, and those of three words for each id."""
    each = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("no")).alias("row"), "tokens")
    hits = joins.phrase_join(each, "row", "tokens", keys, "key", "key_tokens", apart=3)
    own = F.when(F.size(F.split("key", " ")) > 3, F.col("row.no")).alias("no")
    return hits.groupBy("row.doc_id", "key", own).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at")).drop("no")


PHRASE_SQL = """
    WITH b AS (SELECT DISTINCT string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '\\bthe\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS k FROM benchmark),
    k AS (SELECT DISTINCT array_to_string(k[1:3], ' ') AS key FROM b WHERE len(k) >= 3), l AS (SELECT DISTINCT array_to_string(k, ' ') AS key FROM b WHERE len(k) > 3),
    d AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '\\bthe\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
    e AS (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c, generate_subscripts(w, 1) AS i FROM d),
    f AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d), x AS (SELECT doc_id, key, string_split(replace(t, ' ', '  '), replace(' ' || key || ' ', ' ', '  ')) AS p FROM f JOIN l ON contains(t, ' ' || key || ' ')),
    h AS (SELECT doc_id, key, count(*) AS n, min(i - 1)::INT AS first_at FROM e JOIN k ON concat(a, ' ', b, ' ', c) = key AND c IS NOT NULL GROUP BY 1, 2
      UNION ALL SELECT doc_id, key, len(p) - 1, len(regexp_extract_all(p[1], '\\S+'))::INT FROM x)"""


@query("phrase_join_candidates", PHRASE_SQL + """
    SELECT doc_id, key, n, first_at, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, n DESC, key) AS rank FROM h) WHERE rank <= 25""")
def phrase_join_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.split(text.match_key(F.col("text")), " ").alias("tokens"))
    hits = phrase_hits(docs, phrases(spark, sf_dir))
    return windows.best_rows(hits, ["doc_id"], [F.desc(F.length("key")), F.desc("n"), F.col("key")], 25)


@query("three_gate_match", PHRASE_SQL + """
    SELECT doc_id, lang, key FROM (SELECT doc_id, lang, key, row_number() OVER (PARTITION BY doc_id ORDER BY first_at, key) AS rn FROM h JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') AND substr(key, 1, 1) IN ('t', 'a', 'e')) WHERE rn = 1""")
def three_gate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de")).select("doc_id", "lang", "text"))
    tokens = docs.select("doc_id", F.split(text.match_key(F.col("text")), " ").alias("tokens"))
    allowed = phrases(spark, sf_dir).filter(F.substring("key", 1, 1).isin("t", "a", "e"))
    hits = phrase_hits(tokens, allowed).join(docs.select("doc_id", "lang"), "doc_id")
    return windows.first_wins(hits, ["doc_id"], ["first_at", "key"]).select("doc_id", "lang", "key")


@query("gated_venue_match", PHRASE_SQL + """,
    v AS (SELECT key, key || '/' || (k % 3)::VARCHAR AS venue, [(length(key) + k) % 7, (length(key) + 2 * k) % 7] AS zips, (length(key) + k) % 2 = 0 AS recorded FROM (SELECT DISTINCT key FROM h), range(3) t(k)),
    g AS (SELECT doc_id, venue, key, row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, n DESC, key, venue) AS rn FROM h JOIN v USING (key) WHERE recorded AND list_contains(zips, doc_id % 7))
    SELECT doc_id, venue, key FROM g WHERE rn = 1""")
def gated_venue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, place and recorded name: every phrase names three venues, each with two places, and some are recorded under it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", (F.col("doc_id") % 7).alias("zip"), F.split(text.match_key(F.col("text")), " ").alias("tokens"))
    named = phrases(spark, sf_dir)
    size, k = F.length("key"), F.col("k")
    venues = named.select("key", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select("key", F.concat_ws("/", "key", "k").alias("venue"), F.array((size + k) % 7, (size + 2 * k) % 7).alias("zips"), F.array(F.when((size + k) % 2 == 0, F.col("key")).otherwise("-")).alias("aliases"))
    hits = phrase_hits(docs, named).join(venues.select("key", "venue"), "key")
    order = [F.desc(F.length("key")), F.desc("n"), F.col("key")]
    return joins.gated_match(hits, "doc_id", "venue", "key", order, docs, "zip", venues, "zips", "aliases")


@query("staged_disambiguation", """
    WITH q AS (SELECT DISTINCT p_name, p_brand AS b, p_size % 3 AS s FROM part), c AS (SELECT q.*, p_partkey, p_brand = b AS same_brand, p_size % 3 = s AS same_size FROM q JOIN part USING (p_name)),
    r AS (SELECT * FROM c WHERE same_brand), z AS (SELECT *, bool_or(same_size) OVER (PARTITION BY p_name, b, s) AS has_any FROM r),
    k AS (SELECT *, count(*) OVER (PARTITION BY p_name, b, s) AS n_left FROM z WHERE same_size OR NOT has_any)
    SELECT p_name, b, s, p_partkey, n_left, CASE WHEN n_left = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM k""")
def staged_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    asked = parts.select("p_name", F.col("p_brand").alias("b"), (F.col("p_size") % 3).alias("s")).distinct().withColumn("query", F.concat_ws("|", "p_name", "b", "s"))
    left = joins.staged_match(asked, "query", parts, {"p_name": "p_name", "b": "p_brand"}, {"same_size": F.col("p_size") % 3 == F.col("s")})
    return left.select("p_name", "b", "s", "p_partkey", "n_left", F.when(F.col("n_left") == 1, "matched").otherwise("ambiguous").alias("outcome"))


@query("succession_inferred_end", f"""
    SELECT o_orderkey, next_start, next_holder FROM (SELECT a.o_orderkey, CAST(b.o_orderdate AS DATE) AS next_start, b.o_orderpriority AS next_holder, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate, b.o_orderkey) AS rn
      FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderpriority <> a.o_orderpriority) WHERE rn = 1""")
def succession_inferred_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "orders").withColumn("start", F.to_date("o_orderdate"))
    return joins.succession(spans, "o_custkey", "o_orderpriority", "start", "o_orderkey").select("o_orderkey", "next_start", "next_holder")


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans from the order to its last shipment."""
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("end"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("start"))
    return orders.join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


SPANS_SQL = "WITH s AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS st, (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem WHERE l_orderkey = o_orderkey) AS en FROM orders)"


@query("overlap_pairs", SPANS_SQL + """
    SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderpriority <> b.o_orderpriority
      AND a.st < coalesce(b.en, DATE '9999-12-31') AND b.st < coalesce(a.en, DATE '9999-12-31')""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlaps(order_spans(spark, sf_dir), "o_custkey", "o_orderkey", "o_orderpriority", "start", "end")


@query("entity_year_series", """
    SELECT n_nationkey, y::INT AS year, CASE WHEN y <= 1998 THEN n_regionkey ELSE n_nationkey % 5 END AS vintage_key, coalesce(round(t, 2), 0) AS total, t IS NOT NULL AS has_row
    FROM nation, (VALUES (1997), (1998), (1999)) v(y) LEFT JOIN (SELECT c_nationkey, year(o_orderdate) AS yy, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) ON c_nationkey = n_nationkey AND yy = y""")
def entity_year_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumn("newer", F.col("n_nationkey") % 5)
    series = joins.entity_years(nations, [1997, 1998, 1999], 1998, "n_regionkey", "newer")
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    totals = joined.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("t"))
    return series.join(totals, ["n_nationkey", "year"], "left").select("n_nationkey", "year", "vintage_key", F.coalesce(F.round("t", 2), F.lit(0.0)).alias("total"), F.col("t").isNotNull().alias("has_row"))


@query("first_in_array_lookup", """
    SELECT c_custkey, o_orderkey, (o_orderkey - c_custkey * 10 + 5)::INT AS position FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS rn FROM customer JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o_orderkey BETWEEN c_custkey * 10 - 5 AND c_custkey * 10 + 4) WHERE rn = 1""")
def first_in_array_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "customer").select("c_custkey", F.sequence(F.col("c_custkey") * 10 - 5, F.col("c_custkey") * 10 + 4).alias("ids"))
    return joins.first_listed(lists, "c_custkey", "ids", table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "o_orderkey")


@query("exact_or_coarse_key", """
    WITH j AS (SELECT o_orderkey, s_suppkey, c_mktsegment = CASE s_suppkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'HOUSEHOLD' ELSE 'FURNITURE' END AS exact
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey),
    m AS (SELECT *, bool_or(exact) OVER (PARTITION BY o_orderkey) AS has_any FROM j)
    SELECT o_orderkey, s_suppkey, exact FROM m WHERE exact OR NOT has_any""")
def exact_or_coarse_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    left = orders.select(F.col("o_orderkey").alias("row_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    kind = F.col("s_suppkey") % 5
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(kind == 0, "BUILDING").when(kind == 1, "MACHINERY").when(kind == 2, "HOUSEHOLD").otherwise("FURNITURE").alias("segment"))
    return joins.exact_or_coarse(left, right, ["nation"], ["segment"]).select(F.col("row_id").alias("o_orderkey"), "s_suppkey", "exact")


PRECISION_SQL = "CASE WHEN o_orderpriority = '1-URGENT' THEN 31 WHEN o_orderpriority = '2-HIGH' THEN 62 WHEN o_orderpriority = '3-MEDIUM' THEN 366 ELSE 30 END"


@query("tolerance_join", f"""
    SELECT o_orderkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))::INT AS apart FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= {PRECISION_SQL}""")
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"), F.when(F.col("o_orderpriority") == "1-URGENT", "exact").when(F.col("o_orderpriority") == "2-HIGH", "month").when(F.col("o_orderpriority") == "3-MEDIUM", "unknown").otherwise("day").alias("precision"))
    right = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("shipped"))
    allowed = dates.tolerance_days(F.col("precision"), dates.TOLERANCE | {"day": 30})
    found = joins.tolerance_join(left, right, ["o_orderkey"], "ordered", "shipped", allowed, max(dates.TOLERANCE.values()))
    return found.select("o_orderkey", "l_linenumber", dates.days_apart(F.col("ordered"), F.col("shipped")).alias("apart"))


@query("recall_metrics", f"""
    WITH m AS (SELECT o_orderkey, o_orderpriority, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) <= {PRECISION_SQL}) AS hit FROM orders)
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE hit) AS found, CASE WHEN count(*) = 0 THEN NULL ELSE round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 3) END AS recall FROM m GROUP BY 1""")
def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.functions.numbers import share

    hits = tolerance_join(spark, sf_dir).select("o_orderkey").distinct().withColumn("hit", F.lit(True))
    joined = table(spark, sf_dir, "orders").join(hits, "o_orderkey", "left")
    found = F.count_if(F.col("hit"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), found.alias("found"), F.round(share(found, F.count("*")), 3).alias("recall"))


@query("substring_mentions", """
    SELECT name, count(doc_id) AS n_docs FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part) LEFT JOIN documents ON contains(text, name) GROUP BY 1""")
def substring_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return joins.mention_counts(table(spark, sf_dir, "documents"), "text", names, "name")


@query("full_outer_lens", """
    SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, coalesce(balance, 0) AS balance
    FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_nationkey > 3 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier WHERE s_nationkey < 20 GROUP BY 1) ON c_nationkey = s_nationkey
    ORDER BY balance DESC, customers DESC""")
def full_outer_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_nationkey < 20").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return joins.outer_merge([customers, suppliers], "nation", ["customers", "suppliers", "balance"]).orderBy(F.desc("balance"), F.desc("customers"))


@query("holders_at_year", SPANS_SQL + """
    SELECT y::INT AS year, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM s, (VALUES (1996), (1998), (2000)) v(y) WHERE year(st) <= y AND coalesce(year(en), 9999) >= y GROUP BY 1, 2""")
def holders_at_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = order_spans(spark, sf_dir).withColumn("y0", F.year("start")).withColumn("y1", F.year("end"))
    years = spark.createDataFrame([(1996,), (1998,), (2000,)], "year int")
    return joins.holders_by_year(spans, years, "y0", "y1").groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("name_at_year", """
    SELECT p_partkey, y::INT AS year, CASE WHEN p_size % 4 > 0 AND 1990 + p_size % 10 <= y AND (p_size % 3 = 0 OR 1995 + p_size % 10 >= y) THEN p_brand WHEN p_size % 4 > 1 AND 2000 <= y THEN p_type ELSE p_name END AS name FROM part, (VALUES (1994), (2003)) v(y)""")
def name_at_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    alias = lambda name, start, end, dated: F.struct(name.alias("name"), start.alias("start_year"), end.alias("end_year"), dated.alias("dated"))
    first = alias(F.col("p_brand"), 1990 + size % 10, F.when(size % 3 != 0, 1995 + size % 10), size % 4 > 0)
    second = alias(F.col("p_type"), F.lit(2000), F.lit(None).cast("int"), size % 4 > 1)
    rows = table(spark, sf_dir, "part").withColumn("year", F.explode(F.array(F.lit(1994), F.lit(2003))))
    return rows.select("p_partkey", "year", joins.name_in_year(F.array(first, second), F.col("p_name"), F.col("year")).alias("name"))


@query("nearest_year", """
    WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), w AS (SELECT c_custkey, 1995 + c_custkey % 7 AS want FROM customer)
    SELECT c_custkey, want, y::INT AS y, n FROM (SELECT w.*, y, n, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(y - want), y) AS rn FROM w LEFT JOIN s ON c_custkey = o_custkey) WHERE rn = 1""")
def nearest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    wanted = table(spark, sf_dir, "customer").select("c_custkey", (F.lit(1995) + F.col("c_custkey") % 7).alias("want"))
    return joins.nearest(wanted, series, "c_custkey", "want", "y")


@query("key_inversion", "SELECT p_brand, arg_min(p_retailprice, p_partkey) AS value, count(*) AS n FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1")
def key_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_retailprice IS NOT NULL").groupBy("p_brand").agg(F.min_by("p_retailprice", "p_partkey").alias("value"), F.count("*").alias("n"))


ALIASES = [("small", "Small Co", True, 0), ("red", "Red Inc", False, 1), ("red widget", "Widget Inc", False, 2), ("ring", "Ring Ltd", True, 3), ("gear", "Gear Ltd", False, 4), ("small ring", "Small Co", True, 5), ("bolt", "Bolt", True, 6)]
ALIAS_VALUES = ", ".join(f"('{a}', '{o}', {str(d).lower()}, {k})" for a, o, d, k in ALIASES)


@query("alias_priority_match", f"""
    WITH a AS (SELECT * FROM (VALUES {ALIAS_VALUES}) v(alias, operator, distinctive, ord)), n AS (SELECT DISTINCT p_name FROM part),
    h AS (SELECT p_name, alias, operator, CASE WHEN p_name = alias THEN 0 WHEN starts_with(p_name, alias || ' ') THEN 1 WHEN distinctive AND contains(' ' || p_name || ' ', ' ' || alias || ' ') THEN 2 END AS tier, ord FROM n, a),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY tier, -length(alias), ord) AS rn FROM h WHERE tier IS NOT NULL)
    SELECT p_partkey, alias, operator, tier FROM part LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (p_name)""")
def alias_priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "alias string, operator string, distinctive boolean, ord int")
    return joins.alias_match(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", aliases).select("p_partkey", "alias", "operator", "tier")


RELATIONS = [("automobile", "exact", "Automobile", 1), ("building", "rename", "Construction", 2), ("machinery", "sub_brand", "Industry", 3), ("machinery", "acquired", "Holding", 4), ("household", "acquired", "Home", 4)]
RELATION_VALUES = ", ".join(f"('{k}', '{r}', '{p}', {n})" for k, r, p, n in RELATIONS)


@query("crosswalk_cascade", f"""
    WITH t AS (SELECT * FROM (VALUES {RELATION_VALUES}) v(k, relation, parent, pr)), f AS (SELECT k, arg_min(relation, pr) AS relation, arg_min(parent, pr) AS parent FROM t GROUP BY 1)
    SELECT c_custkey, lower(c_mktsegment) AS key, coalesce(relation, 'unknown') AS relation, coalesce(parent, lower(c_mktsegment)) AS parent FROM customer LEFT JOIN f ON k = lower(c_mktsegment)""")
def crosswalk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = spark.createDataFrame(RELATIONS, "key string, relation string, parent string, priority int")
    names = table(spark, sf_dir, "customer").select("c_custkey", text.company_key(F.col("c_mktsegment")).alias("key"))
    return joins.crosswalk(names, "key", relations).select("c_custkey", "key", "relation", "parent")


@query("crosswalk_self_operated", f"""
    WITH t AS (SELECT * FROM (VALUES {RELATION_VALUES}) v(k, relation, parent, pr)), f AS (SELECT k, arg_min(relation, pr) AS relation, arg_min(parent, pr) AS parent FROM t GROUP BY 1),
    n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'in house' WHEN 1 THEN 'inhouse' ELSE lower(c_mktsegment) END AS key FROM customer)
    SELECT c_custkey, key, CASE WHEN c_custkey % 4 < 2 THEN 'self_op' ELSE coalesce(relation, 'unknown') END AS relation, CASE WHEN c_custkey % 4 < 2 THEN 'Self-operated' ELSE coalesce(parent, key) END AS parent FROM n LEFT JOIN f ON k = key""")
def crosswalk_self_operated(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = spark.createDataFrame([*RELATIONS, ("inhouse", "exact", "Never", 1)], "key string, relation string, parent string, priority int")
    own = F.when(F.col("c_custkey") % 4 == 0, "In-House").when(F.col("c_custkey") % 4 == 1, "inhouse").otherwise(F.col("c_mktsegment"))
    names = table(spark, sf_dir, "customer").select("c_custkey", text.company_key(own).alias("key"))
    return joins.crosswalk(names, "key", relations, ("in house", "self operated")).select("c_custkey", "key", "relation", "parent")


@query("agreement_of_sources", """
    WITH a AS (SELECT o_orderkey AS k, year(o_orderdate) AS v FROM orders), b AS (SELECT l_orderkey AS k, year(min(l_shipdate)) AS v FROM lineitem GROUP BY 1), j AS (SELECT a.v = b.v AS same FROM a JOIN b USING (k))
    SELECT count(*) AS shared, count(*) FILTER (WHERE same) AS equal, count(*) = count(*) FILTER (WHERE same) AND count(*) >= 100 AS agrees FROM j""")
def agreement_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("v"))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.year(F.min("l_shipdate")).alias("v"))
    return joins.agreement(ordered, shipped, "k", "v", 100)


@query("source_agreement", """
    SELECT CASE WHEN l_orderkey IS NULL THEN 'deleted' WHEN o_orderkey IS NULL THEN 'created' WHEN o_orderstatus = st THEN 'same' ELSE 'modified' END AS change, count(*) AS n
    FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT l_orderkey, max(l_linestatus) AS st FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""")
def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a snapshot of the settled orders against one of all orders by their lines
    before = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    after = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"))
    return joins.snapshot_diff(before, after, "k", "v").groupBy("change").agg(F.count("*").alias("n"))


@query("colour_precedence", """
    SELECT coalesce(a.p_brand, b.p_brand) AS brand, coalesce(a.colour, b.colour) AS colour FROM (SELECT DISTINCT p_brand, 'red' AS colour FROM part WHERE p_size > 48) a FULL JOIN (SELECT DISTINCT p_brand, 'grey' AS colour FROM part WHERE p_size < 45) b ON a.p_brand = b.p_brand""")
def colour_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    strong = part.filter("p_size > 48").select("p_brand").distinct().withColumn("a", F.lit("red"))
    weak = part.filter("p_size < 45").select("p_brand").distinct().withColumn("b", F.lit("grey"))
    return strong.join(weak, "p_brand", "full_outer").select(F.col("p_brand").alias("brand"), F.coalesce("a", "b").alias("colour"))


@query("vintage_differences", """
    SELECT n_nationkey, a AS older, b AS newer FROM (SELECT n_nationkey, n_regionkey AS a, n_nationkey % 5 AS b FROM nation) WHERE a <> b""")
def vintage_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.create_map(F.lit("older"), F.col("n_regionkey"), F.lit("newer"), F.col("n_nationkey") % 5)).alias("vintage", "code"))
    return long.groupBy("n_nationkey").pivot("vintage", ["older", "newer"]).agg(F.max("code")).filter("older <> newer")


@query("attribute_warnings", """
    SELECT c_custkey, array_to_string(list_filter([CASE WHEN abs(c_acctbal - s) > 4000 THEN 'balance' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM customer JOIN (SELECT s_nationkey, max(s_acctbal) AS s FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def attribute_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("s"))
    found = F.array_compact(F.array(F.when(F.abs(F.col("c_acctbal") - F.col("s")) > 4000, "balance"), F.when(F.col("c_mktsegment") != "BUILDING", "segment")))
    return table(spark, sf_dir, "customer").join(best, "c_nationkey").select("c_custkey", F.array_join(found, ",").alias("warnings"))


@query("tagged_join_share", """
    SELECT c_mktsegment, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 4) AS share FROM customer GROUP BY 1""")
def tagged_join_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    # one row for each segment
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 4))
