"""Profiles, counts, histograms and other aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import numbers
from spanforge.operators import aggregates
from spanforge.queries.registry import query
from spanforge.session import table


def orders_with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")


@query("award_profile_by_operator", """
    SELECT coalesce(nullif(trim(CASE WHEN c_nationkey = 4 THEN NULL ELSE c_mktsegment END), ''), 'Unattributed') AS operator, count(*) AS n, round(sum(coalesce(o_totalprice, 0.0)), 2) AS total
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY total DESC""")
def award_profile_by_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_with_segment(spark, sf_dir).withColumn("operator", F.when(F.col("c_nationkey") != 4, F.col("c_mktsegment")))
    return aggregates.profile(rows, aggregates.labelled("operator", "Unattributed"), F.col("o_totalprice")).orderBy(F.desc("total"))


@query("award_profile_by_year", """
    SELECT year(o_orderdate)::INT AS y, c_mktsegment AS operator, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def award_profile_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_with_segment(spark, sf_dir).filter("c_custkey IS NOT NULL").withColumn("y", F.year("o_orderdate"))
    nested = aggregates.nested_sums(rows, "y", "c_mktsegment", "o_totalprice")
    return nested.select("y", F.explode("by").alias("operator", "total"))


@query("labor_profile", """
    SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(sum(value * 2), 2) AS doubled, count(*) FILTER (WHERE value > 10) AS large, min(day(ts))::INT AS first_day, max(day(ts))::INT AS last_day,
        concat(min(day(ts)), '–', max(day(ts))) AS span FROM events GROUP BY 1""")
def labor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.day("ts")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum(F.col("value") * 2), 2).alias("doubled"), F.count_if(F.col("value") > 10).alias("large"),
        F.min(d).alias("first_day"), F.max(d).alias("last_day"), F.concat_ws("–", F.min(d), F.max(d)).alias("span"),
    )


@query("grand_totals", """
    SELECT coalesce(c_mktsegment, 'all') AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment)""")
def grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_with_segment(spark, sf_dir).filter("c_custkey IS NOT NULL")
    return rows.rollup("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "total")


@query("stats_battery", """
    SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_n, count(*) FILTER (WHERE o_totalprice IS NULL) AS no_price, count(*) FILTER (WHERE year(o_orderdate) < 1997) AS early, count(*) FILTER (WHERE o_orderstatus <> 'O') + count(*) FILTER (WHERE o_orderstatus = 'O') - count(*) AS unaccounted FROM orders""")
def stats_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.count_if(F.col("o_orderstatus") == "O")
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n"), open_.alias("open_n"), F.count_if(F.col("o_totalprice").isNull()).alias("no_price"), F.count_if(F.year("o_orderdate") < 1997).alias("early"),
        (F.count_if(F.col("o_orderstatus") != "O") + open_ - F.count("*")).alias("unaccounted"),
    )


@query("entity_fold_first_last", """
    SELECT user_id, arg_max(event_type, event_id) FILTER (value IS NOT NULL) AS last_type, arg_min(CASE WHEN value > 5 THEN event_id END, event_id) FILTER (value > 5) AS first_large,
        array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types FROM events GROUP BY 1""")
def entity_fold_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value").isNotNull(), F.col("event_type")).alias("last_type"), F.when(F.col("value") > 5, F.col("event_id")).alias("first_large"), F.col("event_type").alias("types"))
    folded = aggregates.entity_fold(rows, "user_id", "event_id", ["last_type"], ["first_large"], ["types"])
    return folded.withColumn("types", F.array_join("types", ","))


@query("ambiguous_keys", """
    SELECT p_name, count(DISTINCT p_partkey) AS n, array_to_string(list_sort(list_distinct(list(p_partkey))), ',') AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1""")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ambiguous(table(spark, sf_dir, "part"), "p_name", "p_partkey").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("token_document_frequency", """
    WITH e AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS off FROM part),
    f AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT p_partkey, token FROM e) GROUP BY 1)
    SELECT p_partkey, token AS trigger, off::INT AS "offset", df FROM (SELECT e.*, df, row_number() OVER (PARTITION BY p_partkey ORDER BY df, -length(token), off) AS rn FROM e JOIN f USING (token)) WHERE rn = 1""")
def token_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.operators.joins import rarest_tokens

    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    frequency = parts.select("p_partkey", F.explode(F.array_distinct("tokens")).alias("trigger")).groupBy("trigger").agg(F.count("*").alias("df"))
    return rarest_tokens(parts, "p_partkey", "tokens").join(frequency, "trigger")


@query("ordered_distinct_citations", """
    WITH f AS (SELECT o_custkey, o_orderpriority, min({'d': o_orderdate, 'k': o_orderkey}) AS o FROM orders GROUP BY 1, 2)
    SELECT o_custkey, array_to_string(list_transform(list_sort(list({'o': o, 'p': o_orderpriority}))[1:3], lambda x: x.p), '; ') AS text FROM f GROUP BY 1""")
def ordered_distinct_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ordered_distinct(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"], 3, "unsourced")


@query("text_coverage_ratio", """
    SELECT lang, round(sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) / sum(length(text)), 4) AS retained, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM documents GROUP BY 1""")
def text_coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.functions.text import squeeze

    size, body = F.sum(F.length("text")), F.sum(F.length(squeeze(F.col("text"))))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(numbers.share(body, size), 4).alias("retained"), F.floor(size / 4).alias("tokens"))


@query("null_safe_share_sum", """
    SELECT l_orderkey, CASE WHEN sum(q) IS NULL OR sum(q) = 0 THEN NULL ELSE CAST(sum(round(l_extendedprice * 100)::BIGINT) AS DOUBLE) / sum(q) END AS cents, round(sum(coalesce(l_tax, 0) + coalesce(q, 0)), 2) AS added
    FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS q FROM lineitem) GROUP BY 1""")
def null_safe_share_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("l_linenumber") == 1, 0.0).when(F.col("l_linenumber") != 2, F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_tax", q.alias("q"))
    return rows.groupBy("l_orderkey").agg(numbers.share(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")), F.sum("q")).alias("cents"), F.round(F.sum(numbers.sum_where_row(F.lit(True), F.col("l_tax"), F.col("q"))), 2).alias("added"))


@query("index_median_vs_median", """
    SELECT lang, count(*) AS n, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, min(n_chars) AS low, max(n_chars) AS high, median(n_chars)::DOUBLE AS true_median FROM documents GROUP BY 1""")
def index_median_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars")
    placed = aggregates.index_values(docs, ["lang"], "n_chars", [("low", "0"), ("upper_median", "n div 2"), ("high", "n - 1")])
    return placed.join(docs.groupBy("lang").agg(F.median("n_chars").alias("true_median")), "lang")


@query("quantile_cut_histogram", """
    WITH s AS (SELECT list_sort(list(c_acctbal)) AS l, count(*) AS n FROM customer), c AS (SELECT [l[n * 1 // 5 + 1], l[n * 2 // 5 + 1], l[n * 3 // 5 + 1], l[n * 4 // 5 + 1]] AS cuts FROM s),
    b AS (SELECT c_acctbal AS v, len(list_filter(cuts, lambda x: c_acctbal >= x))::INT AS bin FROM customer, c)
    SELECT bin, count(*) AS n, min(v) AS low, max(v) AS high FROM b GROUP BY 1""")
def quantile_cut_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_acctbal").withColumn("one", F.lit(1))
    counts = rows.count()
    # the places of the four cuts, found without sorting everything in one task
    cuts = places_of(rows, "c_acctbal", [counts * k // 5 for k in range(1, 5)])
    return aggregates.histogram(rows, numbers.bucket_of(F.col("c_acctbal"), cuts).cast("int"), 5, "c_acctbal")


def places_of(rows: DataFrame, value: str, places: list[int]) -> list[float]:
    """The values at given places of the sorted whole: ranges, their counts, then the places within their ranges."""
    from pyspark.sql import Window as W

    counted = rows.groupBy(value).agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(value).withColumn("_range", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("_range").agg(F.sum("n").alias("m")).orderBy("_range").collect()
    offsets, total = {}, 0
    for r in sizes:
        offsets[r["_range"]] = total
        total += r.m
    through = F.sum("n").over(W.partitionBy("_range").orderBy(value)) + F.element_at(F.create_map(*[F.lit(x) for i in offsets.items() for x in i]), F.col("_range"))
    placed = ranged.withColumn("_to", through)
    wanted = F.explode(F.filter(F.array(*map(F.lit, places)), lambda p: (p < F.col("_to")) & (p >= F.col("_to") - F.col("n"))))
    found = {r.p: r.v for r in placed.select(wanted.alias("p"), F.col(value).alias("v")).collect()}
    ranged.unpersist()
    return [found[p] for p in places]


@query("pooled_distribution", """
    SELECT count(*) AS n, round(sum(v), 2) AS total, min(v) AS low FROM (SELECT DISTINCT year(o_orderdate) AS y, o_custkey, first(o_totalprice ORDER BY o_orderkey) OVER (PARTITION BY year(o_orderdate), o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders)""")
def pooled_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("v"))
    return pooled.agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.min("v").alias("low"))


@query("bounding_box", """
    SELECT s_nationkey, CASE WHEN one THEN x0 - 0.15 ELSE x0 END AS x0, CASE WHEN one THEN x1 + 0.15 ELSE x1 END AS x1, CASE WHEN one THEN y0 - 0.15 ELSE y0 END AS y0, CASE WHEN one THEN y1 + 0.15 ELSE y1 END AS y1
    FROM (SELECT *, x0 = x1 AND y0 = y1 AS one FROM (SELECT s_nationkey, min(s_acctbal) AS x0, max(s_acctbal) AS x1, min(s_suppkey::DOUBLE) AS y0, max(s_suppkey::DOUBLE) AS y1 FROM supplier GROUP BY 1))""")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.bounding_box(table(spark, sf_dir, "supplier").withColumn("s_suppkey", F.col("s_suppkey").cast("double")), ["s_nationkey"], "s_acctbal", "s_suppkey")


@query("legend_overflow", """
    WITH c AS (SELECT p_brand, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1), r AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 8)
    SELECT CASE WHEN p_brand IN (SELECT p_brand FROM r) THEN p_brand ELSE 'Other' END AS label, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1""")
def legend_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.legend(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("invert_map", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') AS ids FROM nation GROUP BY 1")
def invert_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.inverted(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("topk_most_common", """
    WITH c AS (SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS first_at FROM part GROUP BY ALL)
    SELECT p_type, value, n, first_at, rank::INT AS rank FROM (SELECT p_type, p_brand AS value, n, first_at, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, first_at) AS rank FROM c) WHERE rank <= 3""")
def topk_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.operators.windows import best_rows

    counts = table(spark, sf_dir, "part").groupBy("p_type", F.col("p_brand").alias("value")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_at"))
    return best_rows(counts, ["p_type"], [F.desc("n"), F.col("first_at")], 3)


@query("top_words", """
    SELECT event_type, n, first_at, row_number() OVER (ORDER BY n DESC, first_at)::INT AS rank FROM (SELECT event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 3)""")
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_counts(table(spark, sf_dir, "events"), "event_type", "event_id", 3)


@query("linear_cost", "SELECT o_orderstatus, round(sum(o_totalprice * 3.0 / 1e6 + o_custkey * 15.0 / 1e6), 4) AS cost FROM orders GROUP BY 1")
def linear_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = numbers.linear_price([(F.col("o_totalprice"), 3.0), (F.col("o_custkey"), 15.0)])
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.sum(price), 4).alias("cost"))


@query("distinct_per_reason", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2")
def distinct_per_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.sum("l_linenumber").alias("lines"))


@query("array_size_sum", "SELECT CAST(sum(len(string_split(p_name, ' '))) AS BIGINT) AS tokens, count(*) AS n, max(len(string_split(p_name, ' ')))::INT AS longest FROM part")
def array_size_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("p_name", " "))
    return table(spark, sf_dir, "part").agg(F.sum(n).alias("tokens"), F.count("*").alias("n"), F.max(n).alias("longest"))


@query("brand_groups", "SELECT p_type, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def brand_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("brands"))


@query("citation_duplicates", "SELECT source, lang, count(*) AS n, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY 1, 2")
def citation_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are told apart by digest: no text is shuffled
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.sha2("text", 256).alias("digest"))
    per = docs.groupBy("source", "lang", "digest").agg(F.count("*").alias("k"))
    return per.groupBy("source", "lang").agg(F.sum("k").alias("n"), (F.sum("k") - F.count("digest")).alias("duplicates"))


@query("rollup_profile", """
    SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def rollup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubed = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return cubed.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


@query("tumbling_window", """
    SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS began, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts"), "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "event_type", "n", "total")


@query("session_window", """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@query("approx_distinct")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
