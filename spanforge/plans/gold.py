"""Hand-made reference rows: resolved to venues in stages, their operators normalised, checked against the dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import dates, text
from spanforge.functions.hashing import content_id
from spanforge.operators import joins, windows

#: Degrees by which a written coordinate may differ from the dimension's.
COORDINATE_TOLERANCE = 0.05


def resolved(rows: DataFrame, venues: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``venue_id``, ``match`` and ``n_candidates`` to rows (row_no, venue_name, state, city, year).

    venues: (venue_id, canonical_name, venue_type, city, state, lat, lng, opened, closed); keys: (venue_id, key, key_start,
    key_end). A name that one venue has is that venue. Of several, the state decides where it is written and may leave none; city and
    year narrow only where they leave any. ``match`` is exact, alias, ambiguous, not_in_spine or no_name.
    """
    keyed = rows.withColumn("_key", F.nullif(text.match_key(F.col("venue_name")), F.lit("")))
    owners = keys.groupBy("key").agg(F.count_distinct("venue_id").alias("_n"))
    placed = keys.join(venues.select("venue_id", F.col("state").alias("_state"), F.col("city").alias("_city"), "opened", "closed"), "venue_id")
    asked = keyed.select("row_no", "_key", "state", "city", "year").join(owners, F.col("_key") == owners["key"]).drop("key")
    found = asked.join(placed, F.col("_key") == placed["key"]).filter((F.col("_n") == 1) | F.col("state").isNull() | (F.col("state") == F.col("_state")))
    same_city = F.col("city").isNotNull() & (F.lower("_city") == F.lower("city"))
    then = F.col("year").isNotNull() & dates.plausible_as(F.col("opened"), F.col("closed"), F.col("key_start"), F.col("key_end"), F.col("year"))
    staged = found.withColumn("_same_city", same_city).withColumn("_then", then)
    left = joins.narrowed(staged, "row_no", [("_same_city", True), ("_then", True)])
    one = left.filter("n_left = 1").select("row_no", "venue_id")
    answered = keyed.join(asked.select("row_no", F.col("_n").alias("n_candidates")), "row_no", "left").join(one, "row_no", "left")
    named = answered.join(venues.select("venue_id", "canonical_name"), "venue_id", "left")
    exact = F.col("_key") == text.match_key(F.col("canonical_name"))
    match = F.when(F.col("_key").isNull(), "no_name").when(F.col("n_candidates").isNull(), "not_in_spine").when(F.col("venue_id").isNull(), "ambiguous").when(exact, "exact").otherwise("alias")
    return named.select(*rows.columns, "venue_id", match.alias("match"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def cross_check(rows: DataFrame, venues: DataFrame) -> DataFrame:
    """Add ``warnings``: where a row and its venue disagree on state, type or place; rows without a venue have none."""
    spine = venues.select("venue_id", *(F.col(c).alias(f"_{c}") for c in ("state", "venue_type", "lat", "lng")))
    far = lambda c: F.when(F.abs(F.col(c) - F.col(f"_{c}")) > COORDINATE_TOLERANCE, F.lit(c))
    unlike = lambda c: F.when(F.col(c) != F.col(f"_{c}"), F.concat_ws("", F.lit(f"{c}: "), F.col(c), F.lit(" against "), F.col(f"_{c}")))
    return rows.join(spine, "venue_id", "left").withColumn("warnings", F.array_compact(F.array(unlike("state"), unlike("venue_type"), far("lat"), far("lng")))).drop("_state", "_venue_type", "_lat", "_lng")


def gold_load(rows: DataFrame, venues: DataFrame, keys: DataFrame, relations: DataFrame, self_operated: Sequence[str] = ()) -> DataFrame:
    """Reference tenures with an id, their venue and how it was found, the operator and how it relates, warnings and whether they are verified.

    Repeated rows are kept and share an id; ``first`` marks one of them.
    """
    known = joins.crosswalk(resolved(rows, venues, keys).withColumn("_operator", text.company_key(F.col("operator"))), "_operator", relations, self_operated)
    known = known.withColumnRenamed("parent", "operator_normalized")
    named = known.withColumn("tenure_id", content_id("gold-", 10, F.coalesce(F.col("venue_id").cast("string"), F.col("venue_name")), F.col("operator_normalized"), F.col("year")))
    verified = ~F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit("verify"))
    checked = cross_check(named, venues).withColumn("verified", verified)
    firsts = windows.first_wins(checked.select("tenure_id", "row_no"), ["tenure_id"], ["row_no"]).select("row_no", F.lit(True).alias("first"))
    return checked.join(firsts, "row_no", "left").select("tenure_id", "row_no", "venue_id", "match", "n_candidates", "operator_normalized", "relation", "warnings", "verified", F.coalesce("first", F.lit(False)).alias("first"))
