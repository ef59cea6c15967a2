"""Rings and points. Rings are arrays of (x, y) structs; native higher-order functions, simplification in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1)).alias("b")))


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast."""

    def crosses(e: Column) -> Column:
        (ax, ay), (bx, by) = (e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"])
        straddles = (ay > y) != (by > y)
        return F.when(straddles, x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax).otherwise(F.lit(False))

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def polygon_contains(rings: Column, x: Column, y: Column) -> Column:
    """In the first ring and in none of the others, its holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return ring_contains(rings[0], x, y) & ~F.exists(holes, lambda r: ring_contains(r, x, y))


def signed_area(ring: Column) -> Column:
    """Shoelace; positive for counter-clockwise rings."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def closed_ring(ring: Column, digits: int = 5) -> Column:
    """Rounded coordinates, the first point repeated at the end if it is not."""
    rounded = F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
    return F.when(F.element_at(rounded, -1) == rounded[0], rounded).otherwise(F.concat(rounded, F.slice(rounded, 1, 1)))


def distance_to_ring(ring: Column, x: Column, y: Column) -> Column:
    """Least distance from a point to the ring's segments."""

    def to_segment(e: Column) -> Column:
        ax, ay, dx, dy = e["a"]["x"], e["a"]["y"], e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / F.nullif(length, F.lit(0.0)))))
        return F.sqrt(F.pow(x - ax - t * dx, 2) + F.pow(y - ay - t * dy, 2))

    return F.array_min(F.transform(_edges(ring), to_segment))


def simplified(ring: Column, tolerance: float) -> Column:
    """Points nearer than ``tolerance`` to what is left of the ring go; the ends stay."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: None if r is None else [] if not len(r) else _thin([(p["x"], p["y"]) for p in r], tolerance))

    return run(ring)


def _thin(points: list[tuple[float, float]], tolerance: float) -> list[dict]:
    xy = np.array(points, float).reshape(-1, 2)
    return [{"x": x, "y": y} for x, y in xy[kept_points(xy, tolerance)].tolist()]


def kept_points(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points a polyline keeps: stretches are cut where a point is farthest from their chord, all stretches of a round at once."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    done = len(xy) < 3
    while not done:
        ends = np.flatnonzero(keep)
        stretch = np.searchsorted(ends, np.arange(len(xy)), "right") - 1
        stretch[-1] = len(ends) - 2
        start, chord = xy[ends[stretch]], np.diff(xy[ends], axis=0)[stretch]
        length = (chord**2).sum(axis=1)
        along = ((xy - start) * chord).sum(axis=1) / np.where(length > 0, length, 1)
        foot = start + np.clip(along, 0, 1)[:, None] * chord
        far = np.sqrt(((xy - foot) ** 2).sum(axis=1))
        far[ends] = 0
        # the first of the farthest points in each stretch
        order = np.lexsort((np.arange(len(xy)), -far, stretch))
        first = order[np.searchsorted(stretch[order], np.arange(len(ends) - 1))]
        cut = first[far[first] > tolerance]
        keep[cut] = True
        done = not len(cut)
    return keep


POINTS = "array<struct<x: double, y: double>>"


def nested(rings: Column) -> Column:
    """An array of rings to polygons: what lies in what decides, not the order or the winding of the rings.

    Every ring hangs under the smallest ring around it. Rings at even depth are outlines, those at odd depth are holes of
    the ring above them; so an island in a lake is a polygon again. Outlines come out counter-clockwise, holes clockwise,
    all closed; rings without an area and repeated rings go. Outlines are ordered by area, the largest first.
    """

    @F.arrow_udf(f"array<array<{POINTS}>>")
    def run(shapes: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        return pa.array([None if shape is None else _forest([[(p["x"], p["y"]) for p in ring] for ring in shape if ring]) for shape in shapes.to_pylist()], kind)

    return run(rings)


def _area(xy: np.ndarray) -> float:
    (x, y), (nx, ny) = xy.T, np.roll(xy, -1, axis=0).T
    return float((x * ny - nx * y).sum() / 2)


def _crossings(xy: np.ndarray, y: float) -> np.ndarray:
    """Where a ring crosses a height, from left to right."""
    (ax, ay), (bx, by) = xy.T, np.roll(xy, -1, axis=0).T
    at = (ay > y) != (by > y)
    return np.sort((bx - ax)[at] * (y - ay[at]) / (by - ay)[at] + ax[at])


def _inner_point(xy: np.ndarray) -> tuple[float, float]:
    """A point in the ring: half way along its first stretch inside, between its two lowest heights."""
    heights = np.unique(xy[:, 1])
    y = (heights[0] + heights[1]) / 2
    left, right = _crossings(xy, y)[:2]
    return (left + right) / 2, y


def _forest(rings: list[list[tuple[float, float]]]) -> list[list[list[dict]]]:
    opened = [np.array(r[:-1] if r[0] == r[-1] else r, float).reshape(-1, 2) for r in rings]
    sized = sorted(((abs(_area(r)), -k) for k, r in enumerate(opened) if len(r) > 2), reverse=True)
    order, seen = [], set()
    for size, k in sized:
        shape = frozenset(map(tuple, opened[-k].tolist()))
        if size > 0 and shape not in seen:
            seen.add(shape)
            order.append(-k)
    boxes = np.array([[*opened[k].min(axis=0), *opened[k].max(axis=0)] for k in order]).reshape(-1, 4)
    depth: list[int] = []
    polygons: dict[int, list[np.ndarray]] = {}
    for n, k in enumerate(order):
        x, y = _inner_point(opened[k])
        around = np.flatnonzero((boxes[:n, 0] < x) & (boxes[:n, 1] < y) & (boxes[:n, 2] > x) & (boxes[:n, 3] > y))
        # the smallest ring around comes last
        above = next((m for m in around[::-1].tolist() if (_crossings(opened[order[m]], y) > x).sum() % 2), None)
        depth.append(0 if above is None else depth[above] + 1)
        if depth[n] % 2 == 0:
            polygons[n] = [opened[k]]
        else:
            polygons[above].append(opened[k])
    out = []
    for own in polygons.values():
        turned = [r if (_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(own)]
        out.append([[{"x": x, "y": y} for x, y in [*r.tolist(), r[0].tolist()]] for r in turned])
    return out
