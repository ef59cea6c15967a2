"""Columns of a record made from several sources: names, coordinates, tags, bindings, sentences, labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.numbers import bucket_of, haversine_km

ALIAS = "struct<name:string,start_date:string,end_date:string,dated:boolean>"
# fixed values
VERBS = {
    "won": "won the food service contract at",
    "lost": "lost the food service contract at",
    "renewed": "renewed its food service contract at",
    "self_op": "was replaced by in-house operation at",
}
ALTERNATE_TAGS = ("alt_name", "old_name", "official_name", "short_name")


def alias_list(name: Column, aliases: Column, alternates: Column) -> Column:
    """A place's aliases with its own name in front unless it is there, and each alternate name behind unless it is there; letter case apart."""
    undated = lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("end_date"), F.lit(False).alias("dated")).cast(ALIAS)
    held = lambda done, x: F.exists(done, lambda a: F.lower(a["name"]) == F.lower(x))
    known = F.coalesce(aliases, F.array().cast(f"array<{ALIAS}>")).cast(f"array<{ALIAS}>")
    named = F.when(held(known, name), known).otherwise(F.concat(F.array(undated(name)), known))
    added = lambda done, x: F.when((F.trim(x) == "") | x.isNull() | held(done, F.trim(x)), done).otherwise(F.concat(done, F.array(undated(F.trim(x)))))
    return F.aggregate(F.coalesce(alternates, F.array().cast("array<string>")), named, added)


def coordinates(lat: Column, lng: Column, other_lat: Column, other_lng: Column, source: str, other: str) -> Column:
    """struct(lat, lng, source, delta_km): the first source's point, else the other's; how far apart they are where both have one."""
    first, second = lat.isNotNull(), other_lat.isNotNull()
    return F.struct(
        F.coalesce(lat, other_lat).alias("lat"), F.when(first, lng).otherwise(other_lng).alias("lng"),
        F.when(first, source).when(second, other).alias("source"), F.when(first & second, F.round(haversine_km(lat, lng, other_lat, other_lng), 3)).alias("delta_km"),
    )


def tag_values(tags: Column, keys: Sequence[str] = ALTERNATE_TAGS, separator: str = ";") -> Column:
    """The values of some keys of a tag map, split."""
    return F.flatten(F.transform(F.map_values(F.map_filter(tags, lambda k, _: k.isin(*keys))), lambda v: F.split(v, separator)))


def binding(row: Column, name: str) -> Column:
    """The value of a binding in a JSON result row; blank is null."""
    return F.nullif(F.get_json_object(row, f"$.{name}.value"), F.lit(""))


def wkt_point(text: Column) -> Column:
    """struct(lat, lng) of ``Point(lng lat)``."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^Point\(([-\d.eE]+) ([-\d.eE]+)\)", k), F.lit("")).try_cast("double")
    return F.struct(part(2).alias("lat"), part(1).alias("lng"))


# fixed values: what a sentence says where nothing is known
NO_OPERATOR, NO_PLACE, NO_DATE = "(no operator)", "(no venue named)", "date unknown"


def claim(operator: Column, kind: Column, place: Column, institution: Column, date: Column, precision: Column, verbs: dict[str, str] = VERBS) -> Column:
    """An event as a sentence: who, what, where and when, each from the parts that are there."""
    there = lambda c: F.nullif(c, F.lit(""))
    said = lambda parts, between, otherwise: F.coalesce(there(F.array_join(F.array_compact(F.array(*parts)), between)), F.lit(otherwise))
    known = F.try_element_at(F.create_map(*[F.lit(x) for item in verbs.items() for x in item]), kind)
    verb = F.coalesce(known, F.format_string("had a '%s' event at", F.coalesce(kind, F.lit("None"))))
    named = F.coalesce(there(place), F.lit(NO_PLACE))
    where = said([named, F.when(there(institution) != named, institution)], ", ", NO_PLACE)
    when = said([date, F.when(date.isNotNull() & there(precision).isNotNull(), F.format_string("(%s)", precision))], " ", NO_DATE)
    return F.format_string("%s %s %s — %s.", said([there(operator)], "", NO_OPERATOR), verb, where, when)


def verified(source: Column) -> Column:
    """Rows whose source does not say that they are to be verified."""
    return ~F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit("verify"))


def citation(text: Column) -> Column:
    """Without the bars and blanks around it."""
    return F.btrim(text, F.lit("| "))


def size_class(capacity: Column, large: float = 40_000) -> Column:
    """1 for a large place, else 0; no capacity counts as 0."""
    return F.when(F.coalesce(capacity, F.lit(0)) > large, 1).otherwise(0)


def interpolated(x: Column, stops: Sequence[tuple[float, float]]) -> Column:
    """Linear between stops, level outside them."""
    value = F.when(x <= stops[0][0], F.lit(float(stops[0][1])))
    for (a, low), (b, high) in zip(stops[:-1], stops[1:], strict=True):
        value = value.when(x <= b, F.lit(float(low)) + (x - a) / (b - a) * (high - low))
    return value.otherwise(F.lit(float(stops[-1][1])))


@dataclass(frozen=True)
class Metric:
    """A measure as it is shown: its column, how it is written, and the cuts of its classes."""

    name: str
    column: str
    form: str = "%.1f"
    scale: float = 1.0
    cuts: tuple[float, ...] = ()

    def value(self) -> Column:
        return F.col(self.column) * self.scale

    def label(self, missing: str = "no data") -> Column:
        return F.when(F.col(self.column).isNotNull(), F.format_string(self.form, self.value())).otherwise(missing)

    def bucket(self) -> Column:
        return bucket_of(F.col(self.column), self.cuts)
