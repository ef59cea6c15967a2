"""Points and polygons on a grid of cells.

A zone is an array of polygons, a polygon an array of rings (the first its outline, the others holes), a ring an array of
(x, y) structs, closed or not. Zones are cut into cells of a size that suits each; a point meets the zones of its own cell
by equality. In a cell that no border crosses the answer is known; in others only the borders of that cell are ray-cast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanforge.session import spread

#: Cells across a zone, at least; a quarter of the most. Points in a cell above which it is split, where it holds a share of all points too.
SIDE, HOT_ROWS, HOT_SHARE = 8, 1_000_000, 10_000
PART = "struct<base: boolean, flips: array<double>, edges: array<struct<ax: double, ay: double, bx: double, by: double>>>"


def _level(extent: float) -> int:
    """The cell size's power of two, even ones only, so that few sizes occur."""
    return 2 * math.floor(math.log2(extent / SIDE) / 2) if extent > 0 else 0


def _polygon_cells(rings: list, size: float) -> Iterator[tuple[int, int, dict]]:
    """(column, row, what decides there) for the cells that a polygon's border crosses or that lie inside.

    A ray to the right of a point crosses borders of its own cell, which are compared, and borders further right. A border
    further right is crossed where its ends lie on both sides of the ray; an end that two such borders share counts twice,
    that is not at all, so only the few heights remain where the outline enters or leaves what is further right.
    """
    edges = []
    for ring in rings:
        points = [(float(p["x"]), float(p["y"])) for p in ring]
        edges += [(*a, *b) for a, b in zip(points, [*points[1:], *points[:1]], strict=True) if a[1] != b[1]]
    in_rows: dict[int, list] = {}
    for ax, ay, bx, by in edges:
        low, high = min(ay, by), max(ay, by)
        for row in range(math.floor(low / size), math.floor(high / size) + 1):
            ends = [ax + (bx - ax) * (min(max(y, low), high) - ay) / (by - ay) for y in (row * size, (row + 1) * size)]
            margin = 1e-9 * (size + max(map(abs, ends)))  # rounding never hides a crossing
            in_rows.setdefault(row, []).append((math.floor((min(ends) - margin) / size), math.floor((max(ends) + margin) / size), low, high, (ax, ay, bx, by)))
    for row, own in in_rows.items():
        own.sort(key=lambda e: -e[0])
        base, flips, after = False, set(), 0
        for column in range(max(e[1] for e in own), min(e[0] for e in own) - 1, -1):
            while after < len(own) and own[after][0] > column:
                for end in own[after][2:4]:
                    if end <= row * size:
                        base = not base
                    elif end < (row + 1) * size:
                        flips ^= {end}
                after += 1
            local = [e[4] for e in own[after:] if e[1] >= column]
            if local or flips or base:
                yield column, row, {"base": base, "flips": sorted(flips), "edges": [dict(zip(("ax", "ay", "bx", "by"), e, strict=True)) for e in local]}


def _zone_cells(polygons: list) -> tuple[int, dict[tuple[int, int], list]]:
    points = np.array([(p["x"], p["y"]) for rings in polygons for ring in rings for p in ring], float).reshape(-1, 2)
    if not len(points) or not np.isfinite(points).all():
        return 0, {}
    level = _level(float((points.max(axis=0) - points.min(axis=0)).max()))
    cells: dict[tuple[int, int], list] = {}
    for rings in polygons:
        for column, row, part in _polygon_cells(rings, 2.0**level):
            cells.setdefault((column, row), []).append(part)
    return level, cells


def zone_cells(zones: DataFrame, key: str, polygons: str) -> DataFrame:
    """(key, level, col, row, parts): the cells of every zone; a zone without an area has none."""

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"`{key}` {dict(zones.dtypes)[key]}, level int, col long, row long, parts array<{PART}>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for zone in batch.to_pylist():
                level, cells = _zone_cells([[r for r in rings if r] for rings in zone[polygons] or [] if rings])
                rows = [{key: zone[key], "level": level, "col": c, "row": r, "parts": parts} for (c, r), parts in cells.items()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    # a small file of zones is work for all tasks
    return spread(zones.select(key, polygons)).mapInArrow(run, schema)


def _inside(part: Column, x: Column, y: Column) -> Column:
    crossed = F.filter(part["edges"], lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]))
    return (F.size(crossed) + F.size(F.filter(part["flips"], lambda f: f <= y)) + part["base"].cast("int")) % 2 == 1


def _placed(points: DataFrame, x: str, y: str, level: Column) -> DataFrame:
    size = F.pow(F.lit(2.0), level)
    return points.withColumn("_level", level).withColumn("_col", F.floor(F.col(x) / size).cast("long")).withColumn("_row", F.floor(F.col(y) / size).cast("long"))


def zones_of_points(points: DataFrame, x: str, y: str, zones: DataFrame, key: str, polygons: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Points with the key of each zone that contains them; a point in no zone has no row, one in several zones several.

    Each point looks up one cell for each size of cell that occurs. A cell with ``hot_rows`` points or more, and one in
    HOT_SHARE of all, is dealt to several tasks, its zones with it; there are at most HOT_SHARE such cells.
    """
    cells = zone_cells(zones, key, polygons)
    levels = sorted(r.level for r in cells.select("level").distinct().collect())
    if not levels:
        return points.crossJoin(zones.select(key).limit(0))
    at = [*(F.col(c) for c in ("_level", "_col", "_row"))]
    own = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    own = _placed(own, x, y, F.col("_level"))
    total = points.count() * len(levels)
    salt, shares = F.lit(0), cells.select(key, *(F.col(c).alias(f"_{c}") for c in ("level", "col", "row")), "parts").withColumn("_salt", F.lit(0))
    if total >= hot_rows:
        hot = own.groupBy(*at).agg(F.count("*").alias("_n")).filter(F.col("_n") >= max(hot_rows, total // HOT_SHARE)).withColumn("_ways", F.ceil(F.col("_n") / hot_rows).cast("int") + 1)
        hot = F.broadcast(hot.drop("_n"))  # HOT_SHARE rows at most
        salt = F.coalesce(F.pmod(F.xxhash64(x, y), F.col("_ways")), F.lit(0)).cast("int")
        own = own.join(hot, ["_level", "_col", "_row"], "left")
        shares = shares.drop("_salt").join(hot, ["_level", "_col", "_row"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ways") - 1, F.lit(0))))).drop("_ways")
    # a zone has many cells and Spark takes it for one row, so it must not choose a broadcast by that size
    met = own.withColumn("_salt", salt).join(shares.hint("merge"), ["_level", "_col", "_row", "_salt"])
    return met.filter(F.exists("parts", lambda p: _inside(p, F.col(x), F.col(y)))).select(*points.columns, key)


def outside_own_zone(points: DataFrame, x: str, y: str, zone: str, zones: DataFrame, key: str, polygons: str) -> DataFrame:
    """Points that name a zone which does not contain them; those without coordinates or with an unknown zone are none."""
    cells = zone_cells(zones, key, polygons)
    sizes = cells.select(F.col(key).alias("_zone"), F.col("level").alias("_own")).distinct()
    named = points.join(zones.select(F.col(key).alias("_zone")).distinct(), F.col(zone) == F.col("_zone")).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    own = _placed(named.join(sizes, "_zone", "left"), x, y, F.col("_own"))
    there = cells.select(F.col(key).alias("_zone"), F.col("col").alias("_col"), F.col("row").alias("_row"), "parts")
    met = own.join(there.hint("merge"), ["_zone", "_col", "_row"], "left")
    return met.filter(~F.coalesce(F.exists("parts", lambda p: _inside(p, F.col(x), F.col(y))), F.lit(False))).select(*points.columns)
