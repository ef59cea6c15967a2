"""A venue dimension from two sources: fold, anti-join, union, proximity, overrides, match keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators import aggregates, joins, windows


def build_spine(bindings: DataFrame, other: DataFrame, places: DataFrame, km: float = 1.0) -> DataFrame:
    """Venues (venue_id, name, lat, lng, city, types, merged_ids).

    bindings: several rows per entity (entity, ord, name, lat, lng, opened, type); other: (entity, name, lat, lng, linked),
    used where ``linked`` is not an entity of the first source; places: (venue_id, city) overrides.
    """
    folded = aggregates.entity_fold(bindings, "entity", "ord", ["name", "lat", "lng"], ["opened"], ["type"]).withColumnRenamed("type", "types")
    first = folded.select(F.concat(F.lit("a-"), F.col("entity").cast("string")).alias("venue_id"), "name", "lat", "lng", "types", F.lit(0).alias("source"))
    unseen = other.join(folded.select(F.col("entity").alias("linked")), "linked", "left_anti")
    second = unseen.select(F.concat(F.lit("b-"), F.col("entity").cast("string")).alias("venue_id"), "name", "lat", "lng", F.array().cast("array<string>").alias("types"), F.lit(1).alias("source"))
    both = first.unionByName(second).withColumn("key", text.match_key(F.col("name"))).withColumn("ord", F.concat("source", F.lit("/"), "venue_id"))
    kept = windows.greedy_proximity(both, "key", "venue_id", "lat", "lng", "ord", km)
    merged = kept.groupBy("kept_id").agg(F.array_sort(F.collect_list(F.when(F.col("venue_id") != F.col("kept_id"), F.col("venue_id")))).alias("merged_ids"))
    venues = both.join(merged, both["venue_id"] == merged["kept_id"]).select("venue_id", "name", "key", "lat", "lng", "types", "merged_ids").withColumn("city", F.lit(None).cast("string"))
    return joins.override_join(venues, places, "venue_id", ["city"])


def venue_keys(venues: DataFrame, stop_words: Sequence[str], least: int = 4) -> DataFrame:
    """(venue_id, key, canonical): keys of the name and its parts; only the canonical key may consist of type words alone."""
    forms = venues.select("venue_id", F.posexplode(F.transform(text.packed_parts(F.col("name")), text.match_key)).alias("place", "key"))
    usable = (F.length("key") >= least) & ~F.forall(F.split("key", " "), lambda w: w.isin(*stop_words))
    kept = forms.filter((F.col("key") != "") & ((F.col("place") == 0) | usable))
    return windows.first_wins(kept, ["venue_id", "key"], ["place"]).select("venue_id", "key", (F.col("place") == 0).alias("canonical"))


def spot_check(probes: DataFrame, probe: str, keys: DataFrame) -> DataFrame:
    """Each probe name as hit, ambiguous or miss, with the number of venues that its key finds."""
    found = keys.groupBy("key").agg(F.count_distinct("venue_id").alias("n"))
    joined = probes.withColumn("key", text.match_key(F.col(probe))).join(found, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("outcome", F.when(F.col("n") == 0, "miss").when(F.col("n") == 1, "hit").otherwise("ambiguous"))


def spine_keys(venues: DataFrame, stop_words: Sequence[str], least: int = 4) -> DataFrame:
    """(venue_id, key, key_start, key_end, canonical, n_venues): all names by which a spine's venues are found.

    venues: (venue_id, name, city, state, aliases: array of (name, start, end)). Names are taken apart where several are packed
    into one, and shortened; of a venue's equal keys the first keeps its years. A key of type words alone, or one that is the
    name of a city or state of the spine, names no venue, unless it is the venue's own name. ``n_venues`` tells shared keys.
    """
    own = F.struct(F.col("name").alias("name"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    aliases = F.concat(F.array(own), F.coalesce("aliases", F.array().cast("array<struct<name: string, start: int, end: int>>")))
    named = venues.select("venue_id", "city", text.match_key(F.col("name")).alias("_own"), F.posexplode(aliases).alias("_a", "_alias"))
    parts = named.select("*", F.posexplode(text.packed_parts(F.col("_alias.name"))).alias("_p", "_part"))
    forms = parts.select("*", F.posexplode(F.concat(F.array("_part"), text.short_forms(F.col("_part"), F.col("city")))).alias("_f", "_form"))
    keyed = forms.select("venue_id", "_own", "_a", "_p", "_f", text.match_key(F.col("_form")).alias("key"), F.col("_alias.start").alias("key_start"), F.col("_alias.end").alias("key_end"))
    canonical = F.col("key") == F.col("_own")
    usable = (F.length("key") >= least) & ~F.forall(F.split("key", " "), lambda w: w.isin(*stop_words))
    kept = keyed.filter((F.col("key") != "") & (canonical | usable))
    places = venues.select(F.explode(F.array("city", "state")).alias("place")).select(text.match_key(F.col("place")).alias("key")).filter("key <> ''").distinct().withColumn("_place", F.lit(True))
    named_only = kept.join(places, "key", "left").filter(canonical | F.col("_place").isNull())
    first = windows.first_wins(named_only, ["venue_id", "key"], ["_a", "_p", "_f"])
    owners = first.groupBy("key").agg(F.count("*").alias("n_venues"))
    # names are taken apart to many rows, whose size Spark cannot guess: it must not choose a broadcast by that
    return first.join(owners.hint("merge"), "key").select("venue_id", "key", "key_start", "key_end", canonical.alias("canonical"), "n_venues")
