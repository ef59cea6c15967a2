"""Zone shapes: the wanted records of a boundary file, simplified, nested and written as geometries, with what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import geometry
from spanforge.operators.borders import simplified_zones
from spanforge.operators.windows import first_wins


def coordinates(polygons: Column, digits: int = 5) -> Column:
    """Polygons as arrays of numbers, rounded."""
    return F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))))


def geometry_json(polygons: Column) -> Column:
    """A GeoJSON Polygon, a MultiPolygon if there are several, null if there is none."""
    numbers = coordinates(polygons)
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(numbers, F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), numbers.alias("coordinates")))
    return F.when(F.size(polygons) == 1, one).when(F.size(polygons) > 1, many)


def zone_shapes(records: DataFrame, key: str, order: str, rings: str, wanted: DataFrame, tolerance: float) -> DataFrame:
    """(key, status, polygons, geometry) for every wanted key.

    ``status`` is ``drawn``, ``emptied`` where simplification left no ring, or ``missing`` where no record has the key. Of
    several records of a key the first in ``order`` counts. Neighbours keep their common borders.
    """
    keys = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    found = first_wins(records.select(key, order, rings).join(keys, key, "left_semi"), [key], [order]).select(key, F.coalesce(rings, F.array().cast(f"array<{geometry.POINTS}>")).alias("_rings"))
    drawn = simplified_zones(found, key, "_rings", tolerance).withColumn("polygons", geometry.nested(F.col("_rings"))).drop("_rings")
    status = F.when(F.col("polygons").isNull(), "missing").when(F.size("polygons") == 0, "emptied").otherwise("drawn")
    return keys.join(drawn, key, "left").withColumn("status", status).withColumn("geometry", geometry_json(F.col("polygons"))).select(key, "status", "polygons", "geometry")


def shape_report(shapes: DataFrame) -> DataFrame:
    """(requested, drawn, missing, emptied) counts."""
    return shapes.agg(F.count("*").alias("requested"), *(F.count_if(F.col("status") == s).alias(s) for s in ("drawn", "missing", "emptied")))
