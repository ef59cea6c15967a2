"""From point events to tenure spans: collapse, fold, succeed, overlap, status, and what stays unaccounted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.dates import PRECISION_RANK
from spanforge.functions.hashing import content_id
from spanforge.operators import joins, windows
from spanforge.session import stored

#: Fixture event types in the roles of contract events.
EVENT_KINDS = {"signup": "won", "view": "renewed", "click": "presence", "purchase": "expired", "error": "lost"}
OPENERS, CLOSERS = ("won", "renewed"), ("expired", "lost")
COLLAPSE_DAYS = 45


def usable_events(events: DataFrame) -> DataFrame:
    """Events with ``kind`` and, where they cannot be used, the reason."""
    pairs = [F.lit(x) for item in EVENT_KINDS.items() for x in item]
    kind = F.try_element_at(F.create_map(*pairs), F.col("event_type"))
    reason = F.when(F.col("operator").isNull(), "no operator").when(kind.isNull(), "unknown type")
    return events.withColumn("kind", kind).withColumn("unusable", reason)


def tenures(events: DataFrame, as_of: Column, collapse_days: int = COLLAPSE_DAYS, recent_days: int = 3 * 365) -> DataFrame:
    """Tenure spans of (venue_id, operator, event_id, event_type, event_date, date_precision) rows.

    ``derived_from`` lists every event of a span, collapsed duplicates included, so events can be accounted for.
    """
    dated = usable_events(events).filter("unusable IS NULL AND event_date IS NOT NULL")
    ranks = F.create_map(*[F.lit(x) for item in PRECISION_RANK.items() for x in item])
    dated = dated.withColumn("day", F.unix_date("event_date")).withColumn("p", F.coalesce(F.try_element_at(ranks, F.col("date_precision")), F.lit(9)))
    keys = ["venue_id", "operator"]
    once = windows.collapse_duplicates(dated, [*keys, "kind"], "day", "event_id", "p", collapse_days)
    once = once.withColumn("day", F.date_from_unix_date(F.col("at").cast("int"))).withColumn("first_id", F.col("members")[0])
    spans = windows.build_spans(once, keys, "day", "first_id", "kind", OPENERS, CLOSERS, members="members").withColumnRenamed("members", "derived_from")
    spans = spans.withColumn("tenure_id", content_id("sp-", 10, F.col("venue_id"), F.col("operator"), F.array_join(F.transform("derived_from", lambda x: x.cast("string")), ",")))
    # each step reads the one before it from the shared folder: events are scanned once
    spans = stored(spans, "spans")
    followed = joins.succession(spans, "venue_id", "operator", "start", "tenure_id")
    # a span that nothing closed ends where another operator begins
    inferred = F.col("end").isNull() & F.col("next_start").isNotNull()
    followed = followed.withColumn("end_inferred_from", F.when(inferred, "succession")).withColumn("succeeded_by", F.when(inferred, F.col("next_holder"))).withColumn("end", F.coalesce("end", "next_start"))
    followed = followed.withColumn("end_status", windows.end_status(F.col("end"), F.col("known_through"), as_of, recent_days))
    followed = stored(followed, "followed")
    pairs = joins.overlaps(followed, "venue_id", "tenure_id", "operator", "start", "end")
    both = pairs.select(F.col("a").alias("tenure_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("tenure_id"), F.col("a").alias("other")))
    met = both.groupBy("tenure_id").agg(F.array_sort(F.collect_set("other")).alias("overlaps_with"))
    result = followed.join(met, "tenure_id", "left").withColumn("overlaps_with", F.coalesce("overlaps_with", F.array().cast("array<string>")))
    review = F.array_compact(F.array(F.when(~F.col("opened"), "start inferred"), F.when(F.col("end_inferred_from").isNotNull(), "end inferred"), F.when(F.size("overlaps_with") > 0, "overlap")))
    return result.select("tenure_id", *keys, "start", "end", "end_status", "known_through", "n_events", "end_inferred_from", "succeeded_by", "overlaps_with", "derived_from", F.array_join(review, "; ").alias("review_reasons"))


def accounting(events: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: events in, paired, unusable and undated, and those unaccounted for (0)."""
    tagged = usable_events(events)
    total = tagged.agg(F.count("*").alias("n"), F.count_if(F.col("unusable").isNotNull()).alias("unusable"), F.count_if(F.col("unusable").isNull() & F.col("event_date").isNull()).alias("undated"))
    paired = spans.agg(F.coalesce(F.sum(F.size("derived_from")), F.lit(0)).alias("paired"))
    return total.join(paired).withColumn("unaccounted", F.col("n") - F.col("paired") - F.col("unusable") - F.col("undated"))
