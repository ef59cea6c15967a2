"""Scope decisions, filters and classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import dates, numbers
from spanforge.operators import aggregates, classify
from spanforge.queries.registry import query
from spanforge.session import table

SCOPE_SQL = """CASE WHEN o_orderpriority = '5-LOW' THEN 'remote' WHEN c_nationkey >= 20 THEN 'foreign'
    WHEN NOT c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'other_line' WHEN o_totalprice < 50000 THEN 'unresolved' ELSE 'in_scope' END"""


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their ordered scope reason; every order stays."""
    rules = [
        (F.col("o_orderpriority") == "5-LOW", "remote"),
        (F.col("c_nationkey") >= 20, "foreign"),
        (~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"), "other_line"),
        (F.col("o_totalprice") < 50000, "unresolved"),
    ]
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.withColumn("scope_reason", classify.first_match(rules, "in_scope"))


@query("scope_cascade_counts", f"""
    SELECT {SCOPE_SQL} AS scope_reason, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def scope_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(spark, sf_dir).groupBy("scope_reason", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("scope_exclusions_sorted", f"""
    SELECT * FROM (SELECT o_orderkey, o_custkey, {SCOPE_SQL} AS scope_reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
    WHERE scope_reason <> 'in_scope' ORDER BY 3, 1""")
def scope_exclusions_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, others = classify.split_by_tag(scoped(spark, sf_dir), "scope_reason", "in_scope")
    return others.select("o_orderkey", "o_custkey", "scope_reason").orderBy("scope_reason", "o_orderkey")


@query("prefix_line_of_business", """
    SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'catering' WHEN p_brand LIKE 'Brand#1%' THEN 'security' ELSE 'other' END AS line,
        CASE WHEN lower(p_name) LIKE '%widget%' OR lower(p_name) LIKE '%gear%' THEN 'machine' WHEN lower(p_name) LIKE '%ring%' THEN 'jewel' ELSE 'none' END AS kind FROM part""")
def prefix_line_of_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = classify.prefix_class(F.col("p_brand"), {"catering": ["Brand#1", "Brand#2", "Brand#3"]}, {"security": ["Brand#1"]}, "other")
    kind = classify.keyword_class(F.col("p_name"), [("machine", ["widget", "gear"]), ("jewel", ["ring"])], "none")
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"), kind.alias("kind"))


@query("forall_exists_filter", """
    SELECT p_partkey, p_name FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)
    WHERE NOT (len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '^(red|blue|green|cold)'))) = len(w))
      AND len(list_filter(w, lambda x: x IN ('widget', 'ring', 'red', 'cold'))) > 0
      AND len(list_filter(w, lambda x: x IN ('ring', 'small'))) < len(w)""")
def forall_exists_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    keep = ~classify.all_match(w, "^(red|blue|green|cold)") & F.exists(w, lambda x: x.isin("widget", "ring", "red", "cold")) & ~classify.all_in(w, ["ring", "small"])
    return table(spark, sf_dir, "part").filter(keep).select("p_partkey", "p_name")


@query("size_or_type_scope", """
    SELECT p_partkey, (p_type IN ('ECONOMY', 'LARGE') OR p_size >= 40) AS in_scope, CASE WHEN coalesce(p_size, 0) > 40 THEN 3 WHEN coalesce(p_size, 0) > 20 THEN 2 ELSE 1 END AS size_class FROM part""")
def size_or_type_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce("p_size", F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_type").isin("ECONOMY", "LARGE") | (F.col("p_size") >= 40)).alias("in_scope"), F.when(size > 40, 3).when(size > 20, 2).otherwise(1).alias("size_class"))


@query("visibility_filter", """
    SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) <= 1998 AND o_orderstatus IN ('O', 'F')
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def visibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000")
    seen = table(spark, sf_dir, "orders").filter((F.year("o_orderdate") <= 1998) & F.col("o_orderstatus").isin("O", "F"))
    return seen.join(rich, seen["o_custkey"] == rich["c_custkey"], "left_semi").select("o_orderkey", F.year("o_orderdate").alias("y"))


@query("never_match", "SELECT o_orderkey FROM orders WHERE false")
def never_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.lit(False)).select("o_orderkey")


@query("band_filter_states", """
    SELECT state, band, count(*) AS n FROM (SELECT *, CASE WHEN band IS NULL THEN 'unknown' WHEN band IN (1, 2) THEN 'matched' ELSE 'out' END AS state
      FROM (SELECT CASE WHEN v IS NULL THEN NULL ELSE (v >= 0)::INT + (v >= 2500)::INT + (v >= 5000)::INT + (v >= 7500)::INT END AS band
        FROM (SELECT CASE WHEN c_nationkey = 7 THEN NULL ELSE c_acctbal END AS v FROM customer))) GROUP BY 1, 2""")
def band_filter_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_nationkey") != 7, F.col("c_acctbal")))
    return classify.band_filter(rows, "v", [0, 2500, 5000, 7500], [1, 2]).groupBy("state", "band").agg(F.count("*").alias("n"))


@query("as_of_keeping_undated", """
    SELECT event_id, y FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 2000 + (event_id % 30)::INT END AS y FROM events) WHERE y IS NULL OR y <= 2012""")
def as_of_keeping_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("event_type") != "error", (F.lit(2000) + F.col("event_id") % 30).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", y.alias("y")).filter(F.col("y").isNull() | (F.col("y") <= 2012))


@query("open_in_year", """
    SELECT y::INT AS year, count(*) FILTER (WHERE coalesce(o, -9999) <= y AND coalesce(c, 9999) >= y) AS open_n, count(*) AS n
    FROM (SELECT CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1950 + p_size END AS o, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 1980 + p_size END AS c FROM part), (VALUES (1970), (1990), (2010)) AS t(y) GROUP BY 1""")
def open_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened, closed = F.when(F.col("p_size") % 5 != 0, F.col("p_size") + 1950), F.when(F.col("p_size") % 3 != 0, F.col("p_size") + 1980)
    rows = table(spark, sf_dir, "part").select(opened.alias("o"), closed.alias("c"), F.explode(F.array(*map(F.lit, (1970, 1990, 2010)))).alias("year"))
    return rows.groupBy("year").agg(F.count_if(dates.plausible_in(F.col("o"), F.col("c"), F.col("year"))).alias("open_n"), F.count("*").alias("n"))


@query("open_under_name", """
    SELECT p_partkey, y::INT AS year, coalesce(o, -9999) <= y AND coalesce(c, 9999) >= y AND coalesce(s, -9999) <= y AND coalesce(e, 9999) >= y AS plausible
    FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1950 + p_size END AS o, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 1980 + p_size END AS c, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1960 + p_partkey % 30 END AS s, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1990 + p_partkey % 30 END AS e FROM part), (VALUES (1970), (1990), (2010)) AS t(y)""")
def open_under_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part could have been there in a year under a name that it had for some years."""
    size, key = F.col("p_size"), F.col("p_partkey")
    opened, closed = F.when(size % 5 != 0, size + 1950), F.when(size % 3 != 0, size + 1980)
    start, end = F.when(key % 4 != 0, key % 30 + 1960), F.when(key % 3 != 0, key % 30 + 1990)
    rows = table(spark, sf_dir, "part").withColumn("year", F.explode(F.array(*map(F.lit, (1970, 1990, 2010)))))
    return rows.select("p_partkey", "year", dates.plausible_as(opened, closed, start, end, F.col("year")).alias("plausible"))


@query("coordinate_truthiness", """
    SELECT count(*) FILTER (WHERE lat IS NOT NULL AND lat <> 0 AND lng IS NOT NULL AND lng <> 0) AS truthy, count(*) FILTER (WHERE lat IS NOT NULL) AS present
    FROM (SELECT CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey - 5 END AS lat, s_suppkey % 4 AS lng FROM supplier)""")
def coordinate_truthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") != 3, F.col("s_nationkey") - 5).alias("lat"), (F.col("s_suppkey") % 4).alias("lng"))
    truthy = F.col("lat").isNotNull() & (F.col("lat") != 0) & F.col("lng").isNotNull() & (F.col("lng") != 0)
    return rows.agg(F.count_if(truthy).alias("truthy"), F.count_if(F.col("lat").isNotNull()).alias("present"))


@query("coverage_reason", """
    SELECT CASE WHEN o.o_orderkey IS NULL THEN 'not in join' WHEN o.o_orderstatus = 'P' THEN 'no code' WHEN o.o_totalprice < 100000 THEN 'no estimates' END AS reason, count(*) AS n
    FROM customer LEFT JOIN orders o ON c_custkey = o_custkey GROUP BY 1""")
def coverage_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    reason = classify.first_match([(F.col("o_orderkey").isNull(), "not in join"), (F.col("o_orderstatus") == "P", "no code"), (F.col("o_totalprice") < 100000, "no estimates")], None)
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("usable_documents", """
    SELECT lang, count(*) FILTER (WHERE ok) AS usable, count(*) AS n FROM (SELECT lang, source IS NOT NULL AND lang IS NOT NULL AND length(trim(coalesce(text, ''))) > 0 AND n_chars >= 200 AS ok FROM documents) GROUP BY 1""")
def usable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("source").isNotNull() & F.col("lang").isNotNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.col("n_chars") >= 200)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(ok).alias("usable"), F.count("*").alias("n"))


@query("first_usable_documents", """
    SELECT doc_id, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND length(trim(coalesce(text, ''))) > 0 AND n_chars >= 200 ORDER BY doc_id LIMIT 25""")
def first_usable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents that can be used: what cannot be does not count against the limit."""
    ok = F.col("source").isNotNull() & F.col("lang").isNotNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.col("n_chars") >= 200)
    return table(spark, sf_dir, "documents").filter(ok).orderBy("doc_id").limit(25).select("doc_id", "lang")


@query("faceted_counts", """
    SELECT c_mktsegment, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 9000 AND c_nationkey < 10) AS n FROM customer GROUP BY 1 ORDER BY total DESC""")
def faceted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = (F.col("c_acctbal") > 9000) & (F.col("c_nationkey") < 10)
    return classify.faceted_counts(table(spark, sf_dir, "customer"), "c_mktsegment", others).orderBy(F.desc("total"))


@query("coded_numbers", """
    SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 6 THEN NULL ELSE p_retailprice * 100 END AS v FROM part""")
def coded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.format_number(F.col("p_retailprice") * 100, 2)
    kind = F.col("p_size") % 7
    text = F.when(kind == 0, "-").when(kind == 1, F.concat(plain, F.lit("+"))).when(kind == 2, F.concat(plain, F.lit("-"))).when(kind == 6, "-666666666").otherwise(plain)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.coded_number(text), 2).alias("v"))


@query("wilson_interval", """
    WITH t AS (SELECT coalesce(lang, 'all') AS stratum, good, n FROM (SELECT lang, count(*) FILTER (WHERE quality = 1) AS good, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ()))),
    w AS (SELECT *, good / n::DOUBLE AS p, 1.96 * 1.96 AS zz FROM t)
    SELECT stratum, good, n, round(p, 3) AS share, round(greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 3) AS low,
        round(least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 3) AS high FROM w""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    counts = joined.rollup("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count("*").alias("n"))
    low, high = numbers.wilson(F.col("good"), F.col("n"))
    return counts.select(F.coalesce("lang", F.lit("all")).alias("stratum"), "good", "n", F.round(F.col("good") / F.col("n"), 3).alias("share"), low.alias("low"), high.alias("high"))


@query("missing_field_counts", "SELECT count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS missing_text, count(*) FILTER (WHERE lang IS NULL) AS missing_lang, count(*) FILTER (WHERE source IS NULL) AS missing_source FROM documents")
def missing_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.operators.validate import missing_counts

    return missing_counts(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("bool_invariants", """
    SELECT bool_and(l_discount BETWEEN 0 AND 1) AS discount_is_share, bool_and(l_quantity > 0) AS quantity_positive, bool_and(l_extendedprice >= 40000) AS price_high, bool_or(l_tax = 0) AS any_untaxed FROM lineitem""")
def bool_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_discount", "l_quantity", "l_extendedprice", "l_tax")
    checks = {"discount_is_share": F.col("l_discount").between(0, 1), "quantity_positive": F.col("l_quantity") > 0, "price_high": F.col("l_extendedprice") >= 40000}
    return aggregates.invariants(lines, checks, F.bool_or(F.col("l_tax") == 0).alias("any_untaxed"))
