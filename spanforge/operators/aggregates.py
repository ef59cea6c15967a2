"""Aggregation operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.session import scratch


def labelled(column: str, label: str) -> Column:
    """Nulls and blanks become a group of their own."""
    return F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit(label)).alias(column)


def profile(df: DataFrame, key: Column, amount: Column, digits: int = 2) -> DataFrame:
    """(key, n, total): counts and rounded sums, null amounts as 0."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce(amount, F.lit(0.0))), digits).alias("total"))


def nested_sums(df: DataFrame, outer: str, inner: str, amount: str) -> DataFrame:
    """(outer, map of inner to its sum), rows without an outer key skipped."""
    sums = df.filter(F.col(outer).isNotNull()).groupBy(outer, inner).agg(F.round(F.sum(amount), 2).alias("_s"))
    return sums.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "_s")))).alias("by"))


def entity_fold(df: DataFrame, key: str, order: str, last: Sequence[str], first: Sequence[str], union: Sequence[str]) -> DataFrame:
    """One row per entity from many: last or first value that is not null in order, and sorted sets."""
    picked = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    picked += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    picked += [F.array_sort(F.collect_set(c)).alias(c) for c in union]
    return df.groupBy(key).agg(*picked)


def ambiguous(df: DataFrame, key: str, entity: str) -> DataFrame:
    """(key, n, ids): keys that several entities share."""
    return df.groupBy(key).agg(F.count_distinct(entity).alias("n"), F.array_sort(F.collect_set(entity)).alias("ids")).filter("n > 1")


def ordered_distinct(df: DataFrame, key: str, value: str, order: Sequence[str], most: int, otherwise: str) -> DataFrame:
    """(key, text): a key's distinct values by first occurrence, the first few joined by "; "."""
    first = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("_o"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", value))).alias("_all"))
    joined = F.array_join(F.slice(F.transform("_all", lambda x: x[value]), 1, most), "; ")
    return df.select(key).distinct().join(listed, key, "left").select(key, F.coalesce(joined, F.lit(otherwise)).alias("text"))


def index_values(df: DataFrame, keys: Sequence[str], value: str, places: Sequence[tuple[str, str]]) -> DataFrame:
    """Per key the values at given places of the sorted values (not interpolated): (name, SQL of the place from ``n``).

    Equal values are counted first and dealt by ranges of (keys, value), so that no key is sorted in one task; a key's
    places are found from its sums per range.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "index-values")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    # written, so that both uses below see the same ranges
    counted.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_m"))
    whole = W.partitionBy(*keys)
    sums = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), (F.sum("_m").over(whole.orderBy("_range")) - F.col("_m")).alias("_before"), F.sum("_m").over(whole).alias("n"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    to = F.sum("_c").over(W.partitionBy(*keys, "_range").orderBy(value))
    placed = ranged.withColumn("_to", to).join(sums, same).withColumn("_to", F.col("_to") + F.col("_before"))
    at = lambda place: (F.expr(place) < F.col("_to")) & (F.expr(place) >= F.col("_to") - F.col("_c"))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(at(place), F.col(value))).alias(name) for name, place in places))


def evidence_summary(df: DataFrame, key: str, child: Sequence[str], mentions: str, holder: str, year: str, order: str) -> DataFrame:
    """(key, n, mentions, holders, first_year, last_year, children): an entity's claims, newest first and undated last; no mentions count as one."""
    dated = F.struct(F.col(year).isNull().alias("_undated"), (-F.col(year)).alias("_y"), F.col(order).alias("_o"), F.struct(*child).alias("_child"))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.col(mentions), F.lit(1))).alias("mentions"), F.array_sort(F.collect_set(holder)).alias("holders"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.transform(F.array_sort(F.collect_list(dated)), lambda x: x["_child"]).alias("children"),
    )


def award_totals(df: DataFrame, group: str, place: str, name: str, amount: str) -> DataFrame:
    """(group, awards, total, places, names): a group's rows and sum, and its places' names by their own sums, the largest first."""
    each = df.groupBy(group, place).agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.col(amount), F.lit(0))).alias("_s"), F.max(name).alias("_name"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("_o"), F.col(place).alias("_p"), F.coalesce("_name", F.col(place).cast("string")).alias("_name"))))
    return each.groupBy(group).agg(F.sum("_n").alias("awards"), F.sum("_s").alias("total"), F.count("*").alias("places"), F.transform(ranked, lambda x: x["_name"]).alias("names"))


def histogram(df: DataFrame, bin_: Column, bins: int, value: str) -> DataFrame:
    """(bin, n, low, high) of every bin, empty ones too."""
    spark = df.sparkSession
    counted = df.withColumn("bin", bin_).groupBy("bin").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bounding_box(df: DataFrame, keys: Sequence[str], x: str, y: str, pad: float = 0.15) -> DataFrame:
    """Bounds of each key's points; a single point is padded on all sides."""
    box = df.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    single = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    moved = lambda c, by: F.when(single, F.col(c) + by).otherwise(F.col(c))
    return box.select(*keys, moved("x0", -pad).alias("x0"), moved("x1", pad).alias("x1"), moved("y0", -pad).alias("y0"), moved("y1", pad).alias("y1"))


def legend(df: DataFrame, holder: str, entity: str, most: int = 8, rest: str = "Other") -> DataFrame:
    """(label, n): distinct entities per holder for the largest few, and the others together."""
    counts = df.groupBy(holder).agg(F.count_distinct(entity).alias("n"))
    # one row for each holder; ranked with a bounded sort
    top = counts.orderBy(F.desc("n"), holder).limit(most).select(F.col(holder).alias("_h"))
    named = df.join(F.broadcast(top), F.col(holder) == F.col("_h"), "left").withColumn("label", F.coalesce("_h", F.lit(rest)))
    return named.groupBy("label").agg(F.count_distinct(entity).alias("n"))


def inverted(df: DataFrame, value: str, entity: str) -> DataFrame:
    """(value, ids): a map turned round, ids sorted."""
    return df.groupBy(value).agg(F.array_sort(F.collect_list(entity)).alias("ids"))


def top_counts(df: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The n most common values, ties to the first encountered, with ``rank``."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_at")).orderBy(F.desc("n"), "first_at", value).limit(n)
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "first_at", value)))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """A uniform sample without replacement that reruns give again."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def invariants(df: DataFrame, checks: dict[str, Column], *more: Column) -> DataFrame:
    """One row: for each check whether it holds for all rows (true on none), and further aggregates in the same pass."""
    return df.agg(*(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(name) for name, c in checks.items()), *more)


def census(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (either, both_, only_a, only_b): how many keys two censuses list, together and alone; each key counts once."""
    sides = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return sides.agg(F.count("*").alias("either"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both_"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
