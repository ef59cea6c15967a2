"""Whole pipelines on the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.plans import gold, profiles, spine
from spanforge.queries.joining import RELATION_VALUES, RELATIONS, SPANS_SQL, order_spans
from spanforge.queries.registry import query
from spanforge.queries.tagging import SCOPE_SQL, scoped
from spanforge.session import spread, table


@query("spine_build")
def spine_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of several rows, suppliers as a second source."""
    lines = table(spark, sf_dir, "part")
    at = lambda c, by: (F.lit(40.0) + F.col(c) % 17 / by).alias
    bindings = lines.select((F.col("p_partkey") % 500).alias("entity"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), at("p_partkey", 300)("lat"), at("p_size", 200)("lng"), F.col("p_size").alias("opened"), F.col("p_type").alias("type"))
    other = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"), at("s_suppkey", 300)("lat"), at("s_nationkey", 200)("lng"), (F.col("s_suppkey") * 9).alias("linked"))
    places = spark.createDataFrame([("a-1", "Erie"), ("a-2", None)], "venue_id string, city string")
    venues = spine.build_spine(bindings, other, places)
    return venues.select("venue_id", "name", "city", F.size("merged_ids").alias("merged"), F.array_join("types", ",").alias("types"))


@query("coverage_spot_check", """
    WITH k AS (SELECT p_name AS key, count(DISTINCT p_partkey) AS n FROM part WHERE p_size > 30 GROUP BY 1), p AS (SELECT DISTINCT 'The ' || upper(p_name) AS probe, p_name FROM part)
    SELECT probe, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'miss' WHEN n = 1 THEN 'hit' ELSE 'ambiguous' END AS outcome FROM p LEFT JOIN k ON key = p_name""")
def coverage_spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    keys = spine.venue_keys(part.filter("p_size > 30").select(F.col("p_partkey").alias("venue_id"), F.col("p_name").alias("name")), ["arena", "center"])
    probes = part.select(F.concat(F.lit("The "), F.upper("p_name")).alias("probe")).distinct()
    return spine.spot_check(probes, "probe", keys).select("probe", "n", "outcome")


@query("spine_keys", r"""
    WITH v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN 'Riverton ' || p_partkey % 3 WHEN p_partkey % 50 = 1 THEN 'Arena Hall' ELSE p_name || ' ' || p_partkey // 4 END AS name, 'Riverton ' || p_partkey % 3 AS city, 1950 + p_size AS s FROM part),
    f AS (SELECT id, 0 AS a, 0 AS f, lower(name) AS key, NULL::INT AS s FROM v
      UNION ALL SELECT id, 1, 0, 'old ' || lower(name) || ' at park ' || id % 7, s FROM v UNION ALL SELECT id, 1, 1, 'old ' || lower(name), s FROM v
      UNION ALL SELECT id, 2, 0, 'hall arena arena number ' || id % 9 || ' ' || lower(city), NULL FROM v UNION ALL SELECT id, 2, 1, 'hall arena arena number ' || id % 9, NULL FROM v
      UNION ALL SELECT id, 2, 2, 'hall arena', NULL FROM v UNION ALL SELECT id, 2, 3, 'arena number ' || id % 9, NULL FROM v UNION ALL SELECT id, 2, 4, lower(city), NULL FROM v),
    k AS (SELECT f.*, f.key = lower(v.name) AS canonical FROM f JOIN v USING (id) WHERE f.key = lower(v.name) OR (f.key <> 'hall arena' AND f.key NOT IN (SELECT lower(city) FROM v UNION SELECT 'pa'))),
    g AS (SELECT id, key, arg_min({'s': s}, a * 10 + f).s AS s, bool_or(canonical) AS canonical FROM k GROUP BY 1, 2)
    SELECT id AS venue_id, key, s AS key_start, NULL::INT AS key_end, canonical, count(*) OVER (PARTITION BY key) AS n_venues FROM g""")
def spine_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of parts as venues: a name of their own (some of type words alone, some a city's), a former one, and one that packs three."""
    key = F.col("p_partkey")
    city = F.concat(F.lit("Riverton "), key % 3)
    name = F.when(key % 50 == 0, city).when(key % 50 == 1, "Arena Hall").otherwise(F.concat("p_name", F.lit(" "), F.floor(key / 4).cast("string")))
    alias = lambda n, start: F.struct(n.alias("name"), start.cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    packed = F.concat(F.lit("Hall Arena; Arena Number "), key % 9, F.lit(", "), city)
    former = F.concat(F.lit("Old "), F.col("name"), F.lit(" at Park "), key % 7)
    venues = spread(table(spark, sf_dir, "part")).withColumn("name", name).select(key.alias("venue_id"), "name", city.alias("city"), F.lit("PA").alias("state"), F.array(alias(former, F.col("p_size") + 1950), alias(packed, F.lit(None))).alias("aliases"))
    return spine.spine_keys(venues, ["arena", "hall"])


@query("scoped_profile", f"""
    WITH r AS (SELECT *, {SCOPE_SQL} AS scope_reason, year(o_orderdate)::INT AS y FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
    SELECT 'scope' AS part, scope_reason AS name, count(*) AS n, NULL::DOUBLE AS total FROM r GROUP BY 2
    UNION ALL SELECT 'operator', c_mktsegment, count(*), round(sum(o_totalprice), 2) FROM r WHERE scope_reason = 'in_scope' GROUP BY 2
    UNION ALL SELECT 'year', y::VARCHAR, count(*), round(sum(o_totalprice), 2) FROM r WHERE scope_reason = 'in_scope' GROUP BY 2""")
def scoped_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = scoped(spark, sf_dir).withColumn("y", F.year("o_orderdate"))
    parts = profiles.scoped_profile(records, "scope_reason", "in_scope", "c_mktsegment", "y", "o_totalprice")
    a = parts["scope_counts"].select(F.lit("scope").alias("part"), F.col("scope_reason").alias("name"), "n", F.lit(None).cast("double").alias("total"))
    b = parts["by_operator"].select(F.lit("operator").alias("part"), F.col("c_mktsegment").alias("name"), "n", "total")
    c = parts["by_year"].select(F.lit("year").alias("part"), F.col("y").cast("string").alias("name"), "n", "total")
    return a.unionByName(b).unionByName(c)


@query("audit_scores", """
    WITH j AS (SELECT lang, CASE WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS verdict, toxic::VARCHAR AS toxic FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT 'all' AS stratum, 'all' AS value, verdict FROM j UNION ALL SELECT 'lang', lang, verdict FROM j UNION ALL SELECT 'toxic', toxic, verdict FROM j),
    c AS (SELECT stratum, value, count(*) FILTER (WHERE verdict = 'correct') AS good, count(*) AS n FROM s GROUP BY 1, 2), w AS (SELECT *, good / n::DOUBLE AS p, 1.96 * 1.96 AS zz FROM c)
    SELECT stratum, value, good, n, round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 3) AS low,
        round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 3) AS high FROM w""")
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("verdict", F.when(F.col("quality") == 1, "correct").otherwise("wrong"))
    return profiles.audit_scores(judged, "verdict", ("correct", "wrong"), "correct", ("lang", "toxic"))


@query("audit_verdicts", """
    WITH v AS (SELECT trim(CASE WHEN quality = 1 AND toxic = 0 THEN ' correct' WHEN quality = 1 THEN 'wrong_date ' WHEN toxic = 1 THEN 'wrong_operator' WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 5 = 1 THEN 'cant_tell' WHEN doc_id % 5 = 2 THEN 'Correct' ELSE NULL END) AS v FROM labels)
    SELECT CASE WHEN coalesce(v, '') = '' THEN 'unfilled' WHEN v = 'Correct' THEN 'unrecognised' WHEN v = 'correct' THEN 'correct' WHEN v = 'cant_tell' THEN 'undecided' ELSE 'failure' END AS kind, nullif(v, '') AS verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label's verdict counted, those that are off the list and those that are missing too."""
    quality, toxic, fifth = F.col("quality"), F.col("toxic"), F.col("doc_id") % 5
    said = F.when((quality == 1) & (toxic == 0), " correct").when(quality == 1, "wrong_date ").when(toxic == 1, "wrong_operator").when(fifth == 0, "  ").when(fifth == 1, "cant_tell").when(fifth == 2, "Correct")
    rows = table(spark, sf_dir, "labels").select(said.alias("verdict"))
    return profiles.verdict_report(rows, "verdict", ("correct", "wrong_date", "wrong_operator", "cant_tell"), "correct", ("cant_tell",))


@query("year_map", SPANS_SQL + """
    , c AS (SELECT * FROM s WHERE year(st) <= 1998 AND coalesce(year(en), 9999) >= 1998), m AS (SELECT *, coalesce(coalesce(en, DATE '9999-12-31') > lead(st) OVER (PARTITION BY o_custkey ORDER BY st, o_orderkey), false) AS past FROM c),
    g AS (SELECT o_custkey, count(DISTINCT o_orderpriority) > 1 AND bool_or(past) AS contested, arg_max(o_orderpriority, {'s': st, 'k': o_orderkey}) AS holder FROM m GROUP BY 1),
    t AS (SELECT holder FROM g WHERE NOT contested GROUP BY 1 ORDER BY count(*) DESC, holder LIMIT 3)
    SELECT o_custkey, CASE WHEN contested THEN 'Contested' WHEN holder IN (SELECT holder FROM t) THEN holder ELSE 'Other' END AS label FROM g""")
def year_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.year_map(order_spans(spark, sf_dir), "o_custkey", "o_orderpriority", "start", "end", "o_orderkey", F.lit(1998), 3)


@query("zone_choropleth", """
    SELECT c_nationkey, v, CASE WHEN v IS NULL THEN NULL ELSE (v >= 0)::INT + (v >= 4000)::INT + (v >= 8000)::INT END AS bin FROM (SELECT c_nationkey, arg_min(c_acctbal, c_custkey) FILTER (WHERE c_acctbal > 1000) AS v FROM customer GROUP BY 1)""")
def zone_choropleth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("ord"), F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal")).alias("v"))
    return profiles.place_values(rows, "c_nationkey", "v", [0, 4000, 8000])


@query("gold_load", f"""
    WITH s AS (SELECT *, p_partkey // 4 AS g FROM part),
    v AS (SELECT p_partkey AS venue_id, 'hall ' || g || CASE WHEN p_partkey % 8 = 0 THEN ' annex' ELSE '' END AS canonical, 'hall ' || g AS key, 'S' || p_size % 2 AS state, 'Town ' || p_partkey % 3 AS city, CASE WHEN p_size % 3 = 0 THEN 'arena' ELSE 'stadium' END AS type,
        CASE WHEN p_size % 5 > 0 THEN 1950 + p_size END AS opened, CASE WHEN p_size % 4 > 0 THEN 1970 + p_size END AS closed, (p_size / 10.0)::DOUBLE AS lat FROM s),
    t AS (SELECT k, arg_min(relation, pr) AS relation, arg_min(parent, pr) AS parent FROM (VALUES {RELATION_VALUES}) v(k, relation, parent, pr) GROUP BY 1),
    r AS (SELECT c_custkey AS row_no, c_custkey % (SELECT count(*) + 40 FROM part) AS pk, c_mktsegment, c_custkey % 6 AS m, c_nationkey FROM customer),
    e AS (SELECT row_no, CASE WHEN m = 5 THEN NULL ELSE 'hall ' || pk // 4 END AS key, CASE WHEN m IN (1, 2) THEN 'S' || c_nationkey % 2 END AS state, CASE WHEN m IN (2, 3) THEN 'town ' || c_nationkey % 3 END AS city, CASE WHEN m > 2 THEN 1990 + c_nationkey END AS year,
        lower(c_mktsegment) AS op, m FROM r),
    n AS (SELECT key, count(*) AS n FROM v GROUP BY 1),
    c0 AS (SELECT e.*, v.venue_id, n.n, lower(v.city) = e.city AS same_city, coalesce(opened, -9999) <= year AND coalesce(closed, 9999) >= year AS then_ FROM e JOIN n USING (key) JOIN v USING (key) WHERE n.n = 1 OR e.state IS NULL OR e.state = v.state),
    c1 AS (SELECT * FROM (SELECT *, bool_or(coalesce(same_city, false)) OVER (PARTITION BY row_no) AS any_ FROM c0) WHERE same_city OR NOT any_),
    c2 AS (SELECT *, count(*) OVER (PARTITION BY row_no) AS left_ FROM (SELECT *, bool_or(coalesce(then_, false)) OVER (PARTITION BY row_no) AS any2 FROM c1) WHERE then_ OR NOT any2),
    o AS (SELECT row_no, venue_id FROM c2 WHERE left_ = 1)
    SELECT e.row_no, o.venue_id, CASE WHEN e.key IS NULL THEN 'no_name' WHEN n.n IS NULL THEN 'not_in_spine' WHEN o.venue_id IS NULL THEN 'ambiguous' WHEN v.canonical = e.key THEN 'exact' ELSE 'alias' END AS match, coalesce(n.n, 0) AS n_candidates,
        CASE WHEN op = 'furniture' THEN 'self_op' ELSE coalesce(relation, 'unknown') END AS relation, CASE WHEN op = 'furniture' THEN 'Self-operated' ELSE coalesce(parent, op) END AS operator_normalized,
        concat_ws(',', CASE WHEN e.state <> v.state THEN 'state: ' || e.state || ' against ' || v.state END, CASE WHEN v.type <> 'arena' THEN 'venue_type: arena against ' || v.type END, CASE WHEN abs(2.5 - lat) > 0.05 THEN 'lat' END) AS warnings, m <> 4 AS verified,
        'gold-' || left(sha256(coalesce(o.venue_id::VARCHAR, 'The Hall ' || upper(substr(e.key, 6)), '') || '|' || CASE WHEN op = 'furniture' THEN 'Self-operated' ELSE coalesce(parent, op) END || '|' || coalesce(year::VARCHAR, '')), 10) AS tenure_id
    FROM e LEFT JOIN n USING (key) LEFT JOIN o USING (row_no) LEFT JOIN v USING (venue_id) LEFT JOIN t ON t.k = op""")
def gold_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hand-made rows about halls that four parts share: name, then state, city and year tell which is meant."""
    size, key = F.col("p_size"), F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumn("g", F.floor(key / 4))
    hall = F.concat(F.lit("Hall "), F.col("g").cast("string"))
    venues = part.select(
        key.alias("venue_id"), F.concat(hall, F.when(key % 8 == 0, " Annex").otherwise("")).alias("canonical_name"), F.when(size % 3 == 0, "arena").otherwise("stadium").alias("venue_type"), F.concat(F.lit("Town "), key % 3).alias("city"),
        F.concat(F.lit("S"), size % 2).alias("state"), (size / 10).alias("lat"), F.lit(0.0).alias("lng"), F.when(size % 5 > 0, size + 1950).alias("opened"), F.when(size % 4 > 0, size + 1970).alias("closed"), text.match_key(hall).alias("key"),
    )
    nobody = F.lit(None).cast("int")
    keys = venues.select("venue_id", "key", nobody.alias("key_start"), nobody.alias("key_end"))
    m, nation = F.col("c_custkey") % 6, F.col("c_nationkey")
    n = part.agg((F.count("*") + 40).alias("n"))
    rows = table(spark, sf_dir, "customer").crossJoin(n).select(
        F.col("c_custkey").alias("row_no"), F.when(m != 5, F.concat(F.lit("The Hall "), F.floor(F.col("c_custkey") % F.col("n") / 4).cast("string"))).alias("venue_name"), F.when(m.isin(1, 2), F.concat(F.lit("S"), nation % 2)).alias("state"),
        F.when(m.isin(2, 3), F.concat(F.lit("town "), nation % 3)).alias("city"), F.when(m > 2, nation + 1990).alias("year"), F.col("c_mktsegment").alias("operator"), F.lit("arena").alias("venue_type"), F.lit(2.5).alias("lat"), F.lit(0.0).alias("lng"),
        F.when(m == 4, "to VERIFY").otherwise("press").alias("source"),
    )
    relations = spark.createDataFrame(RELATIONS, "key string, relation string, parent string, priority int")
    loaded = gold.gold_load(rows, venues.drop("key"), keys, relations, ("furniture",))
    return loaded.select("row_no", "venue_id", "match", "n_candidates", "relation", "operator_normalized", F.array_join("warnings", ",").alias("warnings"), "verified", "tenure_id")
