"""Zones, shapes and points in them. Polygons are made of table columns, so they grow in number with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import geometry
from spanforge.operators import spatial
from spanforge.plans.zones import zone_shapes
from spanforge.queries.registry import query
from spanforge.session import spread, table


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def square(x: Column, y: Column, half: Column | float) -> Column:
    half = half if isinstance(half, Column) else F.lit(half)
    return ring((x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half))


def diamond(x: Column, y: Column, half: Column) -> Column:
    return ring((x, y - half), (x + half, y), (x, y + half), (x - half, y))


def supplier_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier has a diamond with a square hole, and a square island apart from it."""
    key = F.col("s_suppkey")
    x, y, half = key * 37 % 101 + F.lit(0.25), key * 53 % 89 + F.lit(0.75), key % 7 + F.lit(2.0)
    polygons = F.array(F.array(diamond(x, y, half), square(x, y, half / 4)), F.array(square(x + 20, y - 5, half / 2)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", polygons.alias("polygons"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (key * 7919 % 1201 / 10).alias("x"), (key * 104729 % 997 / 10).alias("y"))


EDGES = """
    WITH z AS (SELECT s_suppkey, s_suppkey * 37 % 101 + 0.25::DOUBLE AS x, s_suppkey * 53 % 89 + 0.75::DOUBLE AS y, s_suppkey % 7 + 2.0::DOUBLE AS h FROM supplier),
    r AS (SELECT s_suppkey, 0 AS part, [{'x': x, 'y': y - h}, {'x': x + h, 'y': y}, {'x': x, 'y': y + h}, {'x': x - h, 'y': y}] AS p FROM z
      UNION ALL SELECT s_suppkey, 0, [{'x': x - h / 4, 'y': y - h / 4}, {'x': x + h / 4, 'y': y - h / 4}, {'x': x + h / 4, 'y': y + h / 4}, {'x': x - h / 4, 'y': y + h / 4}] FROM z
      UNION ALL SELECT s_suppkey, 1, [{'x': x + 20 - h / 2, 'y': y - 5 - h / 2}, {'x': x + 20 + h / 2, 'y': y - 5 - h / 2}, {'x': x + 20 + h / 2, 'y': y - 5 + h / 2}, {'x': x + 20 - h / 2, 'y': y - 5 + h / 2}] FROM z),
    e AS (SELECT s_suppkey, part, p[i] AS a, p[i % 4 + 1] AS b FROM r, range(1, 5) g(i)),
    pt AS (SELECT o_orderkey, o_custkey, o_orderkey * 7919 % 1201 / 10.0::DOUBLE AS x, o_orderkey * 104729 % 997 / 10.0::DOUBLE AS y FROM orders),
    hit AS (SELECT DISTINCT o_orderkey, s_suppkey FROM (SELECT o_orderkey, s_suppkey, part FROM pt JOIN e ON (a.y > pt.y) <> (b.y > pt.y)
      WHERE pt.x < (b.x - a.x) * (pt.y - a.y) / (b.y - a.y) + a.x GROUP BY ALL HAVING count(*) % 2 = 1))"""


@query("points_in_zones", EDGES + " SELECT s_suppkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM hit GROUP BY 1")
def points_in_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders' points against all suppliers' multipolygons; orders at the same place are asked for once."""
    places = order_points(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    found = spatial.zones_of_points(places, "x", "y", supplier_zones(spark, sf_dir), "s_suppkey", "polygons")
    return found.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


OWN = "1 + o_custkey % (SELECT count(*) FROM supplier)"


@query("points_outside_their_zone", EDGES + f""" SELECT o_orderkey, zone FROM (SELECT o_orderkey, {OWN} AS zone FROM pt) p
    WHERE zone IN (SELECT s_suppkey FROM supplier) AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.o_orderkey = p.o_orderkey AND hit.s_suppkey = zone)""")
def points_outside_their_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = supplier_zones(spark, sf_dir)
    n = zones.agg(F.count("*").alias("_n"))
    points = order_points(spark, sf_dir).crossJoin(n).withColumn("zone", 1 + F.col("o_custkey") % F.col("_n")).drop("_n")
    return spatial.outside_own_zone(points, "x", "y", "zone", zones, "s_suppkey", "polygons").select("o_orderkey", "zone")


@query("nested_rings", """
    WITH k AS (SELECT p_partkey, 1 + p_partkey % 5 AS m, p_partkey % 11 + 5.0::DOUBLE AS s FROM part)
    SELECT p_partkey, ((m + 1) // 2)::INT + 1 AS polygons, (m // 2)::INT AS holes, round(list_sum(list_transform(range(m), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * 4 * (s * (m - i)) * (s * (m - i))))::DOUBLE + 1, 6) AS area FROM k""")
def nested_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares one in another, the smallest first and wound as it comes, and an island beside them: polygons, holes and the area they leave."""
    m, step = 1 + F.col("p_partkey") % 5, F.col("p_partkey") % 11 + F.lit(5.0)
    turned = lambda i, r: F.when((i + F.col("p_partkey")) % 2 == 0, r).otherwise(F.reverse(r))
    rings = F.transform(F.sequence(F.lit(1).cast("long"), m), lambda i: turned(i, square(F.lit(0.0), F.lit(0.0), step * i)))
    island = ring((F.lit(900.0), F.lit(0.0)), (F.lit(901.0), F.lit(0.0)), (F.lit(901.0), F.lit(1.0)), (F.lit(900.0), F.lit(1.0)))
    shaped = spread(table(spark, sf_dir, "part")).withColumn("shape", geometry.nested(F.concat(F.array(island), rings)))
    area = F.aggregate(F.flatten("shape"), F.lit(0.0), lambda s, r: s + geometry.signed_area(r))
    holes = F.aggregate("shape", F.lit(0), lambda s, p: s + F.size(p) - 1)
    return shaped.select("p_partkey", F.size("shape").alias("polygons"), holes.alias("holes"), F.round(area, 6).alias("area"))


WIDTH = 16


def jagged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on a grid WIDTH wide; each side has a point in its middle that leaves the line, a little or a lot, the same for both neighbours."""
    c, r = F.col("s_suppkey") % WIDTH, F.floor(F.col("s_suppkey") / WIDTH)
    away = lambda n: F.when(n % 3 == 0, 0.25).otherwise(0.0625)
    across = lambda c, r: (c + 0.5, r + away(c * 5 + r * 7))  # noqa: E731  the middle of the side from (c, r) to (c + 1, r)
    upright = lambda c, r: (c + away(c * 3 + r * 11), r + 0.5)
    points = ring((c, r), across(c, r), (c + 1, r), upright(c + 1, r), (c + 1, r + 1), across(c, r + 1), (c, r + 1), upright(c, r))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(1).alias("record"), F.array(points).alias("rings"))


@query("zone_shapes", f"""
    WITH g AS (SELECT s_suppkey, s_suppkey % {WIDTH} AS c, s_suppkey // {WIDTH} AS r FROM supplier),
    w AS (SELECT s_suppkey, (c * 5 + r * 7) % 3 = 0 AS s, ((c + 1) * 3 + r * 11) % 3 = 0 AS e, (c * 5 + (r + 1) * 7) % 3 = 0 AS n, (c * 3 + r * 11) % 3 = 0 AS w FROM g)
    SELECT s_suppkey, 'drawn' AS status, 5 + (s::INT + e::INT + n::INT + w::INT) AS points, (1 + (n::INT - s::INT + e::INT - w::INT) * 0.125::DOUBLE) AS area FROM w
    UNION ALL SELECT -1, 'missing', NULL, NULL""")
def zone_shapes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of all zones, and of one that has no record: neighbours drop and keep the same points of their borders."""
    cells = jagged_cells(spark, sf_dir)
    wanted = cells.select("s_suppkey").unionAll(spark.range(1).select(F.lit(-1).cast("long")))
    shapes = zone_shapes(cells, "s_suppkey", "record", "rings", wanted, 0.1)
    outline = F.col("polygons")[0][0]
    return shapes.select("s_suppkey", "status", F.when(F.col("status") == "drawn", F.size(outline)).alias("points"), F.when(F.col("status") == "drawn", geometry.signed_area(outline)).alias("area"))
