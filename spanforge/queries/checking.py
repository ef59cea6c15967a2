"""Record rules, composed records, and what panels show of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import dates, records
from spanforge.operators import aggregates, rules, validate
from spanforge.queries.joining import SPANS_SQL, order_spans
from spanforge.queries.registry import query
from spanforge.session import scratch, table
from spanforge.sources import files, sinks


def broken(rows: DataFrame, key: str, found: list[rules.Rule]) -> DataFrame:
    """(key, problem): a row for each rule that a record breaks."""
    return rows.select(key, F.explode(validate.problems(rows.select(), [], found)).alias("problem"))


def listed(*cases: str) -> str:
    return f"unnest(list_filter([{', '.join(f'CASE WHEN {a} THEN {b!r} END' for a, b in (c.split(' => ') for c in cases))}], lambda x: x IS NOT NULL)) AS problem"


@query("event_rules", f"""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS d, ['year', 'month', 'exact'][event_id % 3 + 1] AS p, value > 50 AS review FROM events)
    SELECT event_id, {listed("p = 'year' AND NOT ends_with(d, '-01-01') => event_date: precision year but not January 1", "p = 'month' AND NOT ends_with(d, '-01') => event_date: precision month but not the first", "d IS NULL AND NOT review => event_date: missing, and not for review")} FROM e""")
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    precise = F.element_at(F.array(F.lit("year"), F.lit("month"), F.lit("exact")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.to_date("ts").cast("string")).alias("event_date"), precise.alias("date_precision"), (F.col("value") > 50).alias("needs_review"))
    return broken(rows, "event_id", rules.of_event())


@query("tenure_rules", SPANS_SQL + f""",
    t AS (SELECT o_orderkey, CAST(st AS VARCHAR) AS st, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '1900-01-01' ELSE CAST(en AS VARCHAR) END AS en, ['ended', 'ongoing', 'unknown'][o_orderkey % 3 + 1] AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'lost_rebid' END AS mode,
      ['exact', 'year'][o_custkey % 2 + 1] AS p FROM s)
    SELECT o_orderkey, {listed("p = 'year' AND NOT ends_with(st, '-01-01') => start_date: precision year but not January 1", "p = 'year' AND NOT ends_with(en, '-01-01') => end_date: precision year but not January 1", "status = 'ended' AND en IS NULL => end_status: ended without an end_date", "status <> 'ended' AND en IS NOT NULL => end_status: not ended but an end_date", "mode IS NOT NULL AND status <> 'ended' => exit_mode: only where ended", "en < st => end_date: before start_date")} FROM t""")
def tenure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    precise = pick(["exact", "year"], F.col("o_custkey") % 2)
    rows = order_spans(spark, sf_dir).select(
        "o_orderkey", F.col("start").cast("string").alias("start_date"), F.when(key % 5 == 0, None).when(key % 11 == 0, "1900-01-01").otherwise(F.col("end").cast("string")).alias("end_date"),
        pick(["ended", "ongoing", "unknown"], key % 3).alias("end_status"), F.when(key % 4 == 0, "lost_rebid").alias("exit_mode"), precise.alias("start_precision"), precise.alias("end_precision"),
    )
    return broken(rows, "o_orderkey", rules.of_tenure())


@query("award_rules", f"""
    WITH a AS (SELECT o_orderkey, o_totalprice > 200000 AS kept, ['in_scope', 'operator_unresolved', 'too_small'][o_orderkey % 3 + 1] AS reason, CASE WHEN o_custkey % 2 = 0 THEN 'v' || o_custkey END AS venue, CASE WHEN o_custkey % 3 = 0 THEN 'unmatched' ELSE 'name' END AS match,
      ['exact', 'unknown', NULL, 'acquired'][o_orderkey % 4 + 1] AS relation, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS st, CASE WHEN o_orderkey % 9 = 0 THEN '1990-01-01' END AS en FROM orders)
    SELECT o_orderkey, {listed("kept AND reason <> 'in_scope' => in_scope: kept against its reason", "NOT kept AND reason = 'in_scope' => in_scope: left out against its reason", "NOT kept AND venue IS NOT NULL => venue_id: on a row out of scope", "(match <> 'unmatched') <> (venue IS NOT NULL) => venue_match: disagrees with venue_id", "coalesce(relation, 'unknown') <> 'unknown' AND reason = 'operator_unresolved' => scope_reason: unresolved, but the operator is known", "coalesce(relation, 'unknown') = 'unknown' AND kept => in_scope: kept with an unknown operator", "en < st => end_date: before start_date")} FROM a""")
def award_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, pick = F.col("o_orderkey"), lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") > 200000).alias("in_scope"), pick(["in_scope", "operator_unresolved", "too_small"], key % 3).alias("scope_reason"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("v"), F.col("o_custkey"))).alias("venue_id"), F.when(F.col("o_custkey") % 3 == 0, "unmatched").otherwise("name").alias("venue_match"),
        pick(["exact", "unknown", None, "acquired"], key % 4).alias("operator_relation"), F.to_date("o_orderdate").cast("string").alias("start_date"), F.when(key % 9 == 0, "1990-01-01").alias("end_date"),
    )
    return broken(rows, "o_orderkey", rules.of_award())


@query("vintage_rules", f"""
    WITH r AS (SELECT c_custkey, 2015 + c_custkey % 9 AS y, CASE WHEN c_custkey % 5 > 0 THEN '1' || c_nationkey END AS z, CASE WHEN c_custkey % 2 = 0 THEN 2010 ELSE 2020 END AS v, ['both', 'no_zcta', '2020_only', '2010_only'][c_custkey % 4 + 1] AS m,
      CASE WHEN c_custkey % 7 > 0 THEN round(c_acctbal) END AS w, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 14 / 10.0::DOUBLE END AS t FROM customer)
    SELECT c_custkey, {listed("z IS NOT NULL AND v <> CASE WHEN y <= 2020 THEN 2010 ELSE 2020 END => zcta_vintage: not that of its year", "m = 'no_zcta' AND z IS NOT NULL => zcta_match: no_zcta but a zcta", "m = '2020_only' AND v = 2010 => zcta_match: 2020_only in the older vintage", "m = '2010_only' AND v = 2020 => zcta_match: 2010_only in the newer vintage", "z IS NULL AND w IS NOT NULL => workers_total: without a zcta", "z IS NULL AND t IS NOT NULL => transit_share: without a zcta", "t > 1 => transit_share: outside 0 to 1", "w < 0 => workers_total: negative", "coalesce(w, 0) = 0 AND t IS NOT NULL => transit_share: without workers")} FROM r""")
def vintage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, none = F.col("c_custkey"), F.lit(None).cast("double")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", (key % 9 + 2015).alias("year"), F.when(key % 5 > 0, F.concat(F.lit("1"), F.col("c_nationkey"))).alias("zcta"), F.when(key % 2 == 0, 2010).otherwise(2020).alias("zcta_vintage"),
        F.element_at(F.array(*map(F.lit, ["both", "no_zcta", "2020_only", "2010_only"])), (key % 4 + 1).cast("int")).alias("zcta_match"), F.when(key % 7 > 0, F.round("c_acctbal")).alias("workers_total"),
        F.when(key % 3 > 0, key % 14 / F.lit(10.0)).alias("transit_share"), none.alias("median_household_income"), none.alias("long_commute_share"),
    )
    return broken(rows, "c_custkey", rules.of_vintage())


@query("alias_lists", """
    WITH p AS (SELECT p_partkey, p_name AS n, CASE p_partkey % 3 WHEN 0 THEN [upper(p_name), p_brand] WHEN 1 THEN [p_brand] END AS a, [' ' || p_type || ' ', lower(p_brand), p_name, ''] AS o FROM part),
    q AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN a ELSE list_concat([n], coalesce(a, [])) END AS a, o FROM p)
    SELECT p_partkey, array_to_string(list_concat(a, list_filter([trim(o[1]), o[2]], lambda x: NOT list_contains(list_transform(a, lambda y: lower(y)), lower(x)))), '|') AS names FROM q""")
def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = lambda x: F.struct(x.alias("name"), F.lit("2001-01-01").alias("start_date"), F.lit(None).cast("string").alias("end_date"), F.lit(True).alias("dated"))
    kind, name, brand = F.col("p_partkey") % 3, F.col("p_name"), F.col("p_brand")
    known = F.when(kind == 0, F.array(alias(F.upper(name)), alias(brand))).when(kind == 1, F.array(alias(brand)))
    others = F.array(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), F.lower(brand), name, F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(records.alias_list(name, known, others), lambda a: a["name"]), "|").alias("names"))


@query("coordinate_fallback", """
    WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 40.0 + c_custkey % 10 END AS a, CASE WHEN c_custkey % 3 > 0 THEN -75.0 END AS b, CASE WHEN c_custkey % 4 > 0 THEN 40.5 + c_custkey % 10 END AS c, CASE WHEN c_custkey % 4 > 0 THEN -75.0 END AS d FROM customer)
    SELECT c_custkey, coalesce(a, c)::DOUBLE AS lat, CASE WHEN a IS NULL THEN d ELSE b END::DOUBLE AS lng, CASE WHEN a IS NOT NULL THEN 'first' WHEN c IS NOT NULL THEN 'second' END AS source, CASE WHEN a IS NOT NULL AND c IS NOT NULL THEN round(2 * 6371.0::DOUBLE * asin(sqrt(power(sin(radians((c - a)::DOUBLE) / 2), 2))), 3) END AS delta_km FROM p""")
def coordinate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    at = lambda some, value: F.when(some, value)
    point = records.coordinates(at(key % 3 > 0, key % 10 + 40.0), at(key % 3 > 0, F.lit(-75.0)), at(key % 4 > 0, key % 10 + 40.5), at(key % 4 > 0, F.lit(-75.0)), "first", "second")
    return table(spark, sf_dir, "customer").select("c_custkey", point.alias("p")).select("c_custkey", "p.*")


@query("evidence_summary", """
    WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 4 > 0 THEN event_id % 5 END AS m, CASE WHEN event_id % 6 > 0 THEN year(ts) + event_id % 3 END AS y FROM events)
    SELECT user_id, count(*) AS n, CAST(sum(coalesce(m, 1)) AS BIGINT) AS mentions, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS holders, min(y) AS first_year, max(y) AS last_year, array_to_string(list(event_id ORDER BY y DESC NULLS LAST, event_id), ',') AS children FROM e GROUP BY 1""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(key % 4 > 0, key % 5).alias("m"), F.when(key % 6 > 0, F.year("ts") + key % 3).alias("y"))
    found = aggregates.evidence_summary(rows, "user_id", ["event_id"], "m", "event_type", "y", "event_id")
    return found.withColumn("holders", F.array_join("holders", ",")).withColumn("children", F.array_join(F.transform("children", lambda x: x["event_id"].cast("string")), ","))


@query("award_totals", """
    WITH e AS (SELECT c_nationkey, c_custkey, max(c_name) AS n, count(*) AS k, sum(round(o_totalprice * 100)::BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT c_nationkey, CAST(sum(k) AS BIGINT) AS awards, CAST(sum(s) AS BIGINT) AS cents, count(*) AS places, array_to_string(list(n ORDER BY s DESC, c_custkey), ',') AS names FROM e GROUP BY 1""")
def award_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    found = aggregates.award_totals(joined, "c_nationkey", "c_custkey", "c_name", "cents")
    return found.withColumnRenamed("total", "cents").withColumn("names", F.array_join("names", ","))


@query("best_article", """
    SELECT source, arg_max(doc_id, {'a': contains(lower(text), 'the'), 'b': length(text), 'c': -doc_id}) AS doc_id, count(*) AS candidates FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1""")
def best_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the articles with one citation that which holds the claim, the longest of these, the first of equals."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND text <> ''")
    place = F.struct(F.contains(F.lower("text"), F.lit("the")), F.length("text"), -F.col("doc_id"))
    return docs.groupBy("source").agg(F.max_by("doc_id", place).alias("doc_id"), F.count("*").alias("candidates"))


@query("claim_sentences", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '(no operator)' ELSE 'Op' || user_id END || CASE event_type WHEN 'signup' THEN ' won the food service contract at ' WHEN 'purchase' THEN ' renewed its food service contract at ' ELSE ' had a ''' || event_type || ''' event at ' END
      || CASE WHEN event_id % 3 = 0 THEN '(no venue named)' ELSE 'Hall' END || CASE WHEN event_id % 2 = 0 THEN ', City' ELSE '' END || ' — ' || CASE WHEN event_id % 7 = 0 THEN 'date unknown' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' (exact)' END END || '.' AS claim FROM events""")
def claim_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")
    kind = F.when(kind == "signup", "won").when(kind == "purchase", "renewed").otherwise(kind)
    sentence = records.claim(
        F.when(key % 5 != 0, F.concat(F.lit("Op"), F.col("user_id"))), kind, F.when(key % 3 != 0, "Hall"), F.when(key % 2 == 0, "City"),
        F.when(key % 7 != 0, F.to_date("ts").cast("string")), F.when(key % 4 != 0, "exact"),
    )
    return table(spark, sf_dir, "events").select("event_id", sentence.alias("claim"))


@query("tag_names", "SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS name FROM part")
def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("alt_name"), F.concat_ws(";", "p_name", "p_brand"), F.lit("amenity"), F.lit("hall"), F.lit("old_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(records.tag_values(tags)).alias("name"))


@query("result_bindings", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS label, CASE WHEN c_custkey % 4 > 0 THEN c_custkey / 8.0::DOUBLE END AS lat, CASE WHEN c_custkey % 4 > 0 THEN -1.5::DOUBLE END AS lng FROM customer")
def result_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cell = lambda value: F.struct(F.lit("literal").alias("type"), value.alias("value"))
    point = F.when(key % 4 > 0, F.concat(F.lit("Point(-1.5 "), (key / F.lit(8.0)).cast("string"), F.lit(")")))
    row = F.to_json(F.struct(F.when(key % 3 > 0, cell(F.col("c_name"))).alias("label"), cell(point).alias("coord")))
    parsed = table(spark, sf_dir, "customer").select("c_custkey", row.alias("row")).select("c_custkey", records.binding(F.col("row"), "label").alias("label"), records.wkt_point(records.binding(F.col("row"), "coord")).alias("p"))
    return parsed.select("c_custkey", "label", "p.lat", "p.lng")


@query("verified_rows", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 OR o_orderkey % 7 = 0)")
def verified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("o_orderkey") % 3 == 0, "To VERIFY by phone").when(F.col("o_orderkey") % 7 == 0, "verify").when(F.col("o_orderkey") % 2 == 0, "press")
    return table(spark, sf_dir, "orders").filter(records.verified(source)).select("o_orderkey")


@query("dates_within_texts", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (4, 5) THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d, o_orderkey % 6 = 4 AS month_only FROM orders""")
def dates_within_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 6
    written = (
        F.when(kind == 0, F.concat(F.lit("Erie, "), F.date_format(d, "MMMM d"), F.lit("th "), F.date_format(d, "yyyy"), F.lit(" Thursday"))).when(kind == 1, F.concat(F.lit("Paper; Erie [Erie]"), F.date_format(d, " dd MMM yyyy"), F.lit(": B.1")))
        .when(kind == 2, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:00"))).when(kind == 3, F.date_format(d, "'(printed 'M/d/yyyy')'")).when(kind == 4, F.date_format(d, "MMMM yyyy")).otherwise(F.lit("February 31, 2001 or 2001-02-03"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_within(written).alias("d"), dates.month_only(written).alias("month_only"))


@query("drifting_headers", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS layout FROM supplier")
def drifting_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of one table in two layouts, read by their own headers."""
    rows, path = table(spark, sf_dir, "supplier"), scratch(spark, "layouts")
    sinks.write_csv(rows.filter("s_suppkey % 2 = 0"), f"{path}/layout=a", ["s_suppkey", "s_name", "s_nationkey"], ["s_suppkey"])
    sinks.write_csv(rows.filter("s_suppkey % 2 = 1"), f"{path}/layout=b", ["s_nationkey", "s_suppkey", "s_acctbal", "s_name"], ["s_suppkey"])
    read = lambda k: files.csv_exports(spark, f"{path}/layout={k}", ["s_suppkey", "s_name", "s_nationkey"]).withColumn("layout", F.lit(k))
    both = files.csv_exports(spark, f"{path}/*", ["s_suppkey", "s_name", "s_nationkey"])
    return both.join(read("a").select("s_suppkey", "layout").unionByName(read("b").select("s_suppkey", "layout")), "s_suppkey").select("s_suppkey", "s_name", "s_nationkey", "layout")


@query("panel_labels", """
    SELECT p_partkey, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS size_class, CASE WHEN p_size <= 10 THEN 2.0 WHEN p_size <= 30 THEN 2.0 + (p_size - 10) / 20.0 * 4.0 ELSE 6.0 END::DOUBLE AS radius, CASE WHEN p_size % 5 = 0 THEN 'no data' ELSE printf('%.1f', p_size / 2.0::DOUBLE) || '%' END AS label,
      CASE WHEN p_size % 5 > 0 THEN CASE WHEN p_size >= 30 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END END AS bucket, p_brand || '; ' || p_type AS citation, list_contains([p_size % 7, 3], 3) AS published FROM part""")
def panel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").withColumn("measure", F.when(size % 5 != 0, size.cast("double")))
    metric = records.Metric("size", "measure", "%.1f%%", 0.5, (10, 30))
    return rows.select(
        "p_partkey", records.size_class(size, 40).alias("size_class"), records.interpolated(size, [(10, 2), (30, 6)]).alias("radius"), metric.label().alias("label"), metric.bucket().alias("bucket"),
        records.citation(F.concat(F.lit("| "), "p_brand", F.lit("; "), "p_type", F.lit(" |"))).alias("citation"), F.array_contains(F.array(size % 7, F.lit(3)), 3).alias("published"),
    )


@query("runs_without_start", SPANS_SQL + "SELECT o_orderkey, o_custkey FROM s WHERE en IS NOT NULL AND o_orderkey % 4 = 0")
def runs_without_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that end but have no start: listed, never painted."""
    spans = order_spans(spark, sf_dir).withColumn("start", F.when(F.col("o_orderkey") % 4 != 0, F.col("start")))
    return spans.filter("start IS NULL AND end IS NOT NULL").select("o_orderkey", "o_custkey")


@query("repeat_totals", """
    SELECT s_nationkey, CAST(sum(CASE WHEN s_suppkey % 3 = 0 THEN 2 END) AS BIGINT) AS cases, arg_min(s_name, s_suppkey) FILTER (WHERE s_suppkey % 4 > 0) AS first_name FROM supplier GROUP BY 1""")
def repeat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of those who are in a list more than once, and the first name there that is not blank."""
    key, name = F.col("s_suppkey"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).otherwise(" ")
    cases = F.when(key % 3 == 0, 2)
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum(cases).alias("cases"), F.min_by(name, F.when(~validate.blank(name), key)).alias("first_name"))


@query("planned_layers", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey % 2 = 1")
def planned_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "region").withColumn("status", F.when(F.col("r_regionkey") % 2 == 1, "planned").otherwise("live"))
    return catalog.filter("status = 'planned'").select("r_regionkey", "r_name")
