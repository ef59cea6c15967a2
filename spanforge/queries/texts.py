"""Text, dates, formats, hashes, JSON, sets, sorts and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import dates, documents, geometry, hashing, numbers, text
from spanforge.operators import aggregates, classify, validate, windows
from spanforge.plans.review import CATEGORIES, review_queue
from spanforge.queries.registry import query
from spanforge.session import spread, table


@query("match_key_norm", """
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '\\bthe\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS key FROM documents""")
def match_key_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(text.match_key(F.col("text"))).alias("key"))


@query("company_keys", """
    SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(s_name || ' Group Inc')), '\\b(inc|incorporated|corp|corporation|co|company|llc|lp|ltd|limited|plc|group|usa|holdings)\\b', ' ', 'g'), '[^a-z0-9&! ]', ' ', 'g'), '\\s+', ' ', 'g')) AS key,
        regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM supplier""")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.company_key(F.concat("s_name", F.lit(" Group Inc."))).alias("key"), text.slug(F.col("s_name")).alias("slug"))


@query("packed_split", """
    SELECT p_partkey, unnest(list_filter(string_split_regex(p_name || ', ' || p_brand || ' / ' || p_type, '[,;]| / ').list_transform(lambda x: trim(x)), lambda x: length(x) >= 7)) AS form FROM part
    UNION ALL SELECT p_partkey, p_name || ', ' || p_brand || ' / ' || p_type FROM part""")
def packed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" / "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.packed_parts(packed, 7)).alias("form"))


@query("short_forms", """
    SELECT DISTINCT p_partkey, unnest(list_filter([regexp_replace(n, '\\s+(at|in|of|on)\\s+.*$', ''), regexp_replace(n, '^[A-Z][a-z]+\\s+[A-Z]\\.\\s+', ''), CASE WHEN ends_with(n, ' ' || p_type) THEN n[1:-(length(p_type) + 2)] ELSE n END], lambda f: length(f) >= 6 AND f <> n)) AS form
    FROM (SELECT p_partkey, p_type, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' at ' || p_brand ELSE p_name || ' ' || p_type END AS n FROM part)""")
def short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" at "), "p_brand")).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", name.alias("n"))
    return rows.select("p_partkey", F.explode(text.short_forms(F.col("n"), F.col("p_type"))).alias("form"))


@query("place_suffix", "SELECT n_nationkey, regexp_replace(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' City' ELSE ' Park' END, '(?i)\\s+(city|town|township|village|borough|county)$', '') AS place, CASE WHEN n_nationkey % 2 = 0 THEN '12345' END AS zip FROM nation")
def place_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("n_nationkey") % 2 == 0
    name = F.concat("n_name", F.when(even, " City").otherwise(" Park"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.without_place_suffix(name).alias("place"), text.zip5(F.when(even, "12345-6789").otherwise("n/a")).alias("zip"))


@query("search_folds", "SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', ' ', 'g')) AS folded FROM documents")
def search_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.search_fold(F.col("text"))).alias("folded"))


@query("strict_name_parts", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' arena|old ' || p_type || ' hall' ELSE '' END AS parts FROM part""")
def strict_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that pack two venues, against those that only look so: a part of one word, one without a venue word, one with parentheses."""
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    packed = F.when(kind == 0, F.concat(name, F.lit(" arena, old "), "p_type", F.lit(" hall"))).when(kind == 1, F.concat(name, F.lit(" arena; "), "p_type")).when(kind == 2, F.concat(name, F.lit(" arena / "), name, F.lit(" hall (east)"))).otherwise(F.concat(name, F.lit(" arena")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.strict_parts(packed, ("arena", "hall")), "|").alias("parts"))


@query("rewritten_names", """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'saint saint ' || p_name || '|st ' || p_name WHEN 1 THEN 'mount ' || p_name || '|mt ' || p_name ELSE p_name END AS forms FROM part""")
def rewritten_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and what rewrite rules make of them until nothing changes."""
    third = F.col("p_partkey") % 3
    name = F.concat(F.when(third == 0, "saint saint ").when(third == 1, "mount ").otherwise(""), "p_name")
    forms = text.rewritten_forms(name, [(r"\bsaint\b", "st"), (r"\bmount\b", "mt"), (r"\bst st\b", "st")])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(forms, "|").alias("forms"))


@query("straight_quotes", "SELECT conv_id, turn, md5(chr(39) || text || chr(34) || '-' || chr(34)) AS digest FROM conversations")
def straight_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    curled = F.concat(F.lit("‘"), "text", F.lit("”—“"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.straight(curled)).alias("digest"))


@query("degree_distances", "SELECT c_custkey, round((c_custkey % 90) / 10.0::DOUBLE * 111.32 * cos(radians((c_nationkey * 3)::DOUBLE)), 6) AS km FROM customer")
def degree_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(numbers.degrees_km(F.col("c_custkey") % 90 / F.lit(10.0), (F.col("c_nationkey") * 3).cast("double")), 6).alias("km"))


@query("snippet_window", """
    WITH t AS (SELECT doc_id, text, instr(text, 'the') AS found FROM documents), b AS (SELECT *, greatest(1, found - 130) AS s FROM t)
    SELECT doc_id, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, 260) || CASE WHEN s + 259 < length(text) THEN '…' ELSE '' END AS snippet FROM b""")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), F.lit("the"), 260).alias("snippet"))


@query("format_money_percent", """
    SELECT o_orderkey, CASE WHEN v >= 1e6 THEN '$' || printf('%.1f', round(v / 1e6, 1)) || 'M' WHEN v >= 1e3 THEN '$' || printf('%.0f', round(v / 1e3, 0)) || 'K' ELSE '$' || printf('%.0f', round(v, 0)) END AS money,
        printf('%.1f', round(o_custkey / 15.0::DOUBLE, 1)) || '%' AS pct FROM (SELECT *, floor(o_totalprice) * 7 + 0.25 AS v FROM orders)""")
def format_money_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.floor("o_totalprice") * 7 + 0.25
    pct = F.concat(F.format_string("%.1f", F.round(F.col("o_custkey") / F.lit(15.0), 1)), F.lit("%"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.compact_money(value).alias("money"), pct.alias("pct"))


@query("name_lists", """
    WITH l AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey)[1:n_regionkey + 1] AS l FROM nation GROUP BY 1)
    SELECT n_regionkey, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS names FROM l""")
def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("l"))
    return listed.select("n_regionkey", text.name_list(F.slice("l", F.lit(1), F.col("n_regionkey") + 1)).alias("names"))


@query("parse_dates_multi", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def parse_dates_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    written = F.when(kind == 0, F.date_format(d, "MMMM d, yyyy")).when(kind == 1, F.date_format(d, "d MMM yyyy")).when(kind == 2, F.date_format(d, "yyyy-MM-dd")).when(kind == 3, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "MMMM yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.flexible_date(written).alias("d"))


@query("date_precision_check", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 WHEN 1 THEN day(o_orderdate) = 1 ELSE true END AS consistent, least(greatest(year(o_orderdate), 1996), 1999)::INT AS clamped,
        date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') <= 1095 AS recent FROM orders""")
def date_precision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    precision = F.element_at(F.array(F.lit("year"), F.lit("month"), F.lit("exact")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.precision_consistent(F.col("o_orderdate"), precision).alias("consistent"), dates.clamp(F.year("o_orderdate"), F.lit(1996), F.lit(1999)).alias("clamped"),
        dates.recent(F.to_date("o_orderdate"), F.lit("2000-01-01").cast("date")).alias("recent"),
    )


@query("knowledge_dates", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE make_date(1900 + p_size, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 7 END, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 9 END) END AS d, 1900 + p_size AS y FROM part")
def knowledge_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    year = F.when(s % 5 == 0, "0000").otherwise((s + 1900).cast("string"))
    written = F.concat(F.lit("+"), year, F.lit("-"), F.when(s % 2 == 0, "00").otherwise("07"), F.lit("-"), F.when(s % 3 == 0, "00").otherwise("09"), F.lit("T00:00:00Z"))
    return table(spark, sf_dir, "part").select("p_partkey", dates.knowledge_base_date(written).alias("d"), dates.year_of((s + 1900).cast("string")).alias("y"))


@query("number_parsing", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice * 1000 END AS v, coalesce(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice * 1000 END, 0) AS z FROM part")
def number_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("p_size") % 8 == 0, "n/a").when(F.col("p_size") % 4 == 0, " ").otherwise(F.format_number(F.col("p_retailprice") * 1000, 2))
    value = F.round(numbers.parse_number(written), 2)
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("v"), F.coalesce(value, F.lit(0.0)).alias("z"))


@query("url_host", "SELECT page_id, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1), '') AS host, string_split(url, '/')[-1] AS last FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"), text.last_segment(F.col("url")).alias("last"))


@query("hash_ids", "SELECT o_orderkey, 'sp-' || substr(sha256(concat(o_custkey, '|', o_orderpriority, '|', o_orderkey)), 1, 10) AS id FROM orders")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.content_id("sp-", 10, F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderkey")).alias("id"))


@query("json_extras", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, '{\"type\":\"' || event_type || '\",\"k\":' || (props ->> '$.k') || '}' AS extras FROM events")
def json_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("extras"))


@query("set_ops_union", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 8000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_ops_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 8000").select(F.col("c_custkey").alias("k"))
    return rich.union(table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_custkey")).distinct()


@query("census_differences", """
    WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)
    SELECT count(*) AS either, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both_, count(*) FILTER (WHERE b.k IS NULL) AS only_a, count(*) FILTER (WHERE a.k IS NULL) AS only_b FROM a FULL JOIN b ON a.k = b.k""")
def census_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two censuses' union, and how many each has alone."""
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    buying = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return aggregates.census(rich, buying, "k")


@query("employer_keys", """
    WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' Group, Inc. d/b/a ' || p_type WHEN 1 THEN p_type || ' & ' || p_name || ' Co. and' ELSE 'The ' || p_brand || ' DBA ' || p_name || ' & Subsidiaries, L.P.' END AS name FROM part),
    t AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '\\bd/?b/?a\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM n)
    SELECT p_partkey, regexp_replace(array_to_string(list_filter(t, lambda x: x NOT IN ('inc', 'incorporated', 'corp', 'corporation', 'co', 'company', 'llc', 'lp', 'ltd', 'limited', 'plc', 'group', 'usa', 'holdings')), ' '), '(?:(?:^|\\s+)and)+$', '') AS key FROM t""")
def employer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("p_partkey") % 3
    name = F.when(third == 0, F.concat("p_name", F.lit(" Group, Inc. d/b/a "), "p_type")).when(third == 1, F.concat("p_type", F.lit(" & "), "p_name", F.lit(" Co. and"))).otherwise(F.concat(F.lit("The "), "p_brand", F.lit(" DBA "), "p_name", F.lit(" & Subsidiaries, L.P.")))
    return table(spark, sf_dir, "part").select("p_partkey", text.employer_key(name).alias("key"))


@query("payload_hashes", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS payload FROM orders""")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.payload_hash(["o_orderstatus", "o_orderkey", "o_custkey"]).alias("payload"))


@query("set_ops_intersect", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_ops_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return rich.intersect(table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_custkey"))


@query("set_ops_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_ops_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@query("subset_test", "SELECT NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AS orders_in_customers, NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) AS customers_in_orders")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    a = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg((F.count("*") == 0).alias("orders_in_customers"))
    return a.join(customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg((F.count("*") == 0).alias("customers_in_orders")))


@query("custom_order_review_queue", """
    WITH q AS (SELECT CASE WHEN text IS NULL OR n_chars < 50 THEN 'corpus' WHEN source = 'src1' THEN 'out_of_scope' WHEN contains(text, 'the of') THEN 'silent_source' ELSE 'needs_a_person' END AS category, 'document' AS kind, doc_id AS id FROM documents
      UNION ALL SELECT 'out_of_scope', 'order', o_orderkey FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT 'needs_a_person', 'event', event_id FROM events WHERE event_type = 'error' AND value > 60)
    SELECT category, kind, id, list_position(['corpus', 'out_of_scope', 'silent_source', 'needs_a_person'], category)::BIGINT AS place FROM q""")
def custom_order_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = review_queue(table(spark, sf_dir, "documents"), table(spark, sf_dir, "orders").filter("o_totalprice < 2000"), table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 60"))
    return queue.withColumn("place", F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("long")).orderBy("place", "kind", "id")


@query("nulls_last_orders", """
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey)::INT AS newest, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_orderkey)::INT AS oldest FROM orders""")
def nulls_last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    place = lambda order: F.row_number().over(W.partitionBy("o_custkey").orderBy(order, "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place(d.desc_nulls_last()).alias("newest"), place(d.asc_nulls_last()).alias("oldest"))


@query("seeded_sample")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 7, 20)


@query("fixed_batches", "SELECT c_nationkey, c_custkey, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 25)::BIGINT AS batch FROM customer")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = windows.numbered(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey")
    return placed.select("c_nationkey", "c_custkey", F.floor(F.col("place") / 25).alias("batch"))


ORDER_FIELDS = [
    validate.Field("o_orderkey", "number", True),
    validate.Field("o_orderstatus", "enum", True, ("O", "F")),
    validate.Field("o_orderpriority", "enum", False, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),
    validate.Field("o_orderdate", "date", True),
]


@query("validation_problems", """
    SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'o_orderstatus: not in list' END, 'o_custkey: unknown field', 'o_totalprice: unknown field', CASE WHEN o_totalprice > 490000 AND o_orderpriority = '5-LOW' THEN 'large but low' END], lambda x: x IS NOT NULL)) AS problem FROM orders""")
def validation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rules = [((F.col("o_totalprice") > 490000) & (F.col("o_orderpriority") == "5-LOW"), "large but low")]
    return orders.select("o_orderkey", F.explode(validate.problems(orders, ORDER_FIELDS, rules)).alias("problem"))


@query("repair_audit", """
    SELECT repair, count(*) AS n, CAST(sum(CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulled FROM (SELECT unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'status off list' END, CASE WHEN o_totalprice > 450000 THEN 'price capped' END], lambda x: x IS NOT NULL)) AS repair, nullif(o_orderstatus, 'P') AS status FROM orders) GROUP BY 1""")
def repair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = [("o_orderstatus", F.col("o_orderstatus") == "P", F.lit(None).cast("string"), "status off list"), ("o_totalprice", F.col("o_totalprice") > 450000, F.lit(450000.0), "price capped")]
    fixed = validate.repaired(table(spark, sf_dir, "orders"), fixes)
    return fixed.select("o_orderstatus", F.explode("repairs").alias("repair")).groupBy("repair").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus").isNull()).alias("nulled"))


@query("half_even_rounding", "SELECT p_partkey, round_even(p_size / 8.0::DOUBLE, 2) AS even, round(p_size / 8.0::DOUBLE, 2) AS up FROM part")
def half_even_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    eighth = F.col("p_size") / F.lit(8.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(eighth, 2).alias("even"), F.round(eighth, 2).alias("up"))


@query("alias_partition", """
    SELECT p_partkey, array_to_string(list_filter([p_name, p_brand, p_type], lambda x: x <> p_name AND length(x) > 7), ';') AS dated, array_to_string(list_filter([p_name, p_brand, p_type], lambda x: x <> p_name AND length(x) <= 7), ';') AS undated FROM part""")
def alias_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = F.array_remove(F.array("p_name", "p_brand", "p_type"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.filter(others, lambda x: F.length(x) > 7), ";").alias("dated"), F.array_join(F.filter(others, lambda x: F.length(x) <= 7), ";").alias("undated"))


@query("truncated_bodies", """
    SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 3000) || ' [cut]' ELSE text END AS body, concat_ws('; ', lang, CASE WHEN source <> 'src0' THEN source END) AS label FROM documents""")
def truncated_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.length("text") > 3000, F.concat(F.left("text", F.lit(3000)), F.lit(" [cut]"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"), F.concat_ws("; ", "lang", F.when(F.col("source") != "src0", F.col("source"))).alias("label"))


def polygon() -> Column:
    """An L-shaped polygon with a square hole."""
    ring = lambda points: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))
    return F.array(ring([(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]), ring([(1, 1), (2, 1), (2, 2), (1, 2)]))


@query("point_in_polygon", """
    SELECT c_custkey, ((x > 0 AND x < 10 AND y > 0 AND y < 4) OR (x > 0 AND x < 4 AND y > 0 AND y < 10)) AND NOT (x > 1 AND x < 2 AND y > 1 AND y < 2) AS inside FROM (SELECT c_custkey, (c_custkey % 23) / 2.0::DOUBLE + 0.1 AS x, (c_custkey % 29) / 3.0::DOUBLE + 0.05 AS y FROM customer)""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("c_custkey") % 23 / F.lit(2.0) + 0.1, F.col("c_custkey") % 29 / F.lit(3.0) + 0.05
    return table(spark, sf_dir, "customer").select("c_custkey", geometry.polygon_contains(polygon(), x, y).alias("inside"))


@query("ring_area", "SELECT n_nationkey, (64.0 * (n_nationkey + 1))::DOUBLE AS area, (n_nationkey + 1)::DOUBLE AS hole FROM nation")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = lambda ring: F.transform(ring, lambda p: F.struct((p["x"] * (F.col("n_nationkey") + 1)).alias("x"), p["y"].alias("y")))
    return table(spark, sf_dir, "nation").select("n_nationkey", geometry.signed_area(scaled(polygon()[0])).alias("area"), geometry.signed_area(scaled(polygon()[1])).alias("hole"))


@query("ring_tools", """
    SELECT n_nationkey, 7 AS points, 4 AS kept, round(CASE WHEN n_nationkey <= 4 THEN least(n_nationkey, 4 - n_nationkey) ELSE sqrt(1 + power(greatest(n_nationkey - 10, 0), 2)) END::DOUBLE, 4) AS away FROM nation""")
def ring_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = polygon()[0]
    rows = table(spark, sf_dir, "nation").withColumn("ring", geometry.closed_ring(outer))
    return rows.select("n_nationkey", F.size("ring").alias("points"), F.size(geometry.simplified(F.col("ring"), 5.0)).alias("kept"), F.round(geometry.distance_to_ring(outer, F.col("n_nationkey").cast("double"), F.lit(5.0)), 4).alias("away"))


@query("english_capitalised", r"""SELECT doc_id, coalesce(regexp_matches(text, '[^\s.!?:"“”](\s*[^\S\n])?\bThe\b'), false) AS inner_the FROM documents""")
def english_capitalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a word appears with a capital other than at the start of a sentence."""
    return table(spark, sf_dir, "documents").select("doc_id", documents.appears_capitalised(F.col("text"), F.lit("the")).alias("inner_the"))


@query("keyword_categories", "SELECT conv_id, turn, CASE WHEN lower(text) LIKE '%the%' THEN 'english' WHEN lower(text) LIKE '%der %' THEN 'german' ELSE 'other' END AS kind FROM conversations")
def keyword_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = classify.keyword_class(F.col("text"), [("english", ["the"]), ("german", ["der "])], "other")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"))
