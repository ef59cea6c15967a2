"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source gets a share of the whole by weight. A source may be repeated ``max_epochs`` times at most, so a target
above that is clamped and the excess goes to the others by weight, again and again until none is above. A document is
then repeated as often as its source's rate says: the whole part for every document, the fractional part for the
documents that come first in a seeded order, the last of them in part, so that the words taken meet the target.
Clamping is found in one pass: sources are clamped in the order of cap over weight, so a sum over those before a source
tells the level at which it would be reached.

Defined results: a null source is a source of its own, sorted last; null and empty texts have size 0 and are taken 0
times; repeated rows and ids count as often as they occur; an empty table gives no rows; a text of any length is one row
whose words are counted in place; other columns, however named, go through the pipeline's mix unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm.common import WORD, checkpoint, table

#: The per-source table is broadcast up to this many rows; beyond it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Documents of a source in one bucket of its seeded order, about.
BUCKET_DOCS = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0) in code-point order, null last: ranges, then a rank in each, then offsets by range."""
    ranges = checkpoint(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range_no", F.spark_partition_id()))
    counts = ranges.groupBy("range_no").agg(F.count("*").alias("n"))
    # one row per shuffle partition, whatever the input
    offsets = counts.select("range_no", (F.sum("n").over(W.orderBy("range_no")) - F.col("n")).alias("offset"))
    within = F.row_number().over(W.partitionBy("range_no").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("within", within).join(F.broadcast(offsets), "range_no").withColumn("rank", F.col("within") + F.col("offset")).drop("range_no", "within", "offset")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): clamp what is above its cap, reshare the excess by weight, until none is.

    The level that the others share rises with each source that is clamped, so sources are clamped in the order of
    cap / weight. Sources with the same ratio go together: at their ratio r the clamped ones are those below r, and the
    level is (total - their caps) / weight of the rest; the sources of ratio r stay below their caps where that is at most r.
    """
    caps = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    per_ratio = caps.groupBy("ratio").agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"))
    # sums over all smaller ratios: within ranges, and over the ranges before
    ranged = checkpoint(per_ratio.repartitionByRange("ratio").withColumn("range_no", F.spark_partition_id()))
    ranges = ranged.groupBy("range_no").agg(F.sum("caps").alias("range_caps"), F.sum("weights").alias("range_weights"))
    # one row per shuffle partition, whatever the input
    so_far = W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("range_no", F.coalesce(F.sum("range_caps").over(so_far), F.lit(0.0)).alias("caps_far"), F.coalesce(F.sum("range_weights").over(so_far), F.lit(0.0)).alias("weights_far"))
    near = W.partitionBy("range_no").orderBy("ratio").rowsBetween(W.unboundedPreceding, -1)
    below = ranged.join(F.broadcast(ranges), "range_no").select(
        "ratio", (F.coalesce(F.sum("caps").over(near), F.lit(0.0)) + F.col("caps_far")).alias("used"), (F.coalesce(F.sum("weights").over(near), F.lit(0.0)) + F.col("weights_far")).alias("clamped_weight"),
    )
    weights = caps.agg(F.sum("weight")).first()[0] or 0.0
    level = (F.lit(total) - F.col("used")) / (F.lit(weights) - F.col("clamped_weight"))
    # the smallest ratio that its level does not exceed; where there is none, all are clamped
    first = below.filter(level <= F.col("ratio")).agg(F.min_by(level, "ratio").alias("level")).first()
    filled = F.lit(max(0.0, first.level)) * F.col("weight") if first.level is not None else F.col("cap")
    return caps.withColumn("target", F.least("cap", filled)).drop("cap", "ratio")


def mix(docs: DataFrame, id_column: str = "doc_id", weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """Per row of (id, source, size): source_size, target and ``taken``, the words that the mix takes of it.

    The rows are ordered within their source by a seeded hash, in buckets: sums per bucket find the bucket in which the
    source's fractional share ends, and only that bucket is ordered row by row. So no source passes through one task.
    """
    sized = checkpoint(docs.select(id_column, "source", "size", (F.xxhash64(F.lit(seed), F.col(id_column)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("u")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ranked = checkpoint(ranked_sources(per_source).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    totals = ranked.agg(F.sum("source_size").alias("words"), F.count("*").alias("n")).first()
    targets = water_fill(ranked, float(totals.words or 0), max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate), F.lit(int(max_epochs)))
    # what is left of the target after the whole repetitions, in words
    targets = checkpoint(
        targets.withColumn("whole", whole)
        .withColumn("extra", F.greatest(F.round(F.col("target") - F.col("whole") * F.col("source_size")), F.lit(0.0)).cast("long"))
        .withColumn("n_buckets", F.ceil(F.col("source_rows") / BUCKET_DOCS))
        .select(F.col("source").alias("s"), "source_size", "target", "whole", "extra", "n_buckets")
    )
    small = totals.n <= BROADCAST_SOURCES

    def by_source(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right) if small else right, left["source"].eqNullSafe(right["s"])).drop("s")

    bucketed = by_source(sized, targets).withColumn("bucket", F.floor(F.col("u") * F.col("n_buckets")))
    sums = bucketed.groupBy("source", "bucket", "extra").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words")
    # the bucket in which the share ends: what comes before it fits, it does not
    ends = (
        sums.withColumn("before", before)
        .filter((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("words") > F.col("extra")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("end_bucket"), F.col("before").alias("end_before"))
    )
    ends = checkpoint(ends)
    right = F.broadcast(ends) if small else ends
    placed = bucketed.join(right, bucketed["source"].eqNullSafe(right["s"]), "left").drop("s")
    at_end = F.col("bucket") == F.col("end_bucket")
    running = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("u", id_column, "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    partly = placed.filter(at_end).withColumn("room", F.col("extra") - F.col("end_before") - (running - F.col("size")))
    partly = partly.withColumn("more", F.greatest(F.least(F.col("room"), F.col("size")), F.lit(0)))
    rest = placed.filter(~F.coalesce(at_end, F.lit(False))).withColumn("room", F.lit(0).cast("long"))
    rest = rest.withColumn("more", F.when(F.col("end_bucket").isNull() & (F.col("extra") > 0) | (F.col("bucket") < F.col("end_bucket")), F.col("size")).otherwise(F.lit(0)))
    taken = F.least(F.col("whole") * F.col("size") + F.col("more"), (F.col("size") * F.lit(float(max_epochs))).cast("long"))
    return partly.unionByName(rest).select(id_column, "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: a document once for each time it is taken whole; the one that the mix takes in part is taken whole
    from half of it on, else left out, so texts are never cut.

    A document of size 0 takes no words and stays once; equal rows share their copies out; the columns are those of
    ``docs``, whatever their names.
    """
    # the row travels as one column, so that its columns may have any names
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id"), F.col("source"), F.xxhash64(text), F.length(text)).alias("row_key"))
    taken = mix(keyed.select("row_key", "row.source", word_count(F.col("row.text")).alias("size")), id_column="row_key", **options)
    words = F.greatest(F.col("size"), F.lit(1))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / words) + (2 * (F.col("taken") % words) >= words).cast("long")).otherwise(F.lit(1))
    plan = taken.groupBy("row_key").agg(F.sum(times).alias("times"), F.count("*").alias("rows"))
    joined = keyed.join(plan, "row_key")
    left = F.col("times") % F.col("rows")
    each = F.floor(F.col("times") / F.col("rows"))
    even = joined.filter(left == 0).withColumn("n", each)
    # equal rows of which the mix takes some more often than others
    uneven = joined.filter(left > 0).withColumn("n", each + (F.row_number().over(W.partitionBy("row_key").orderBy(F.lit(0))) <= left).cast("long"))
    copies = even.unionByName(uneven).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return copies.select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
