"""Simplification of zones that keeps what neighbours share.

Simplified alone, two neighbours would keep different points of one border and gape or overlap. Borders are cut where they
part or meet (points with other than two neighbouring points in all rings), and each arc between two such points is
simplified from the same end by every ring that holds it, so every ring keeps the same points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.geometry import POINTS, kept_points


def _without_repeats(ring: Column) -> Column:
    """Points unlike the one before them; the last goes if it closes the ring."""
    unlike = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    closes = (F.size(unlike) > 1) & (F.get(unlike, F.lit(0)) == F.element_at(unlike, -1))
    return F.when(closes, F.slice(unlike, 1, F.size(unlike) - 1)).otherwise(unlike)


def _arcs(xy: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """A ring's arcs from cut to cut in its own direction, ends included; without a cut one from its least point to itself."""
    starts = sorted(cuts) or [int(np.lexsort((xy[:, 1], xy[:, 0]))[0])]
    round_ = np.concatenate([xy, xy, xy[:1]])
    ends = [*starts[1:], starts[0] + len(xy)]
    return [round_[a : b + 1] for a, b in zip(starts, ends, strict=True)]


def _simplified_arc(arc: np.ndarray, tolerance: float) -> np.ndarray:
    """Always from the same end, whichever way a ring runs along it."""
    there, back = arc.tolist(), arc[::-1].tolist()
    if back < there:
        return arc[::-1][kept_points(arc[::-1], tolerance)][::-1]
    return arc[kept_points(arc, tolerance)]


def _simplified_ring(points: list[dict], cuts: list[int], tolerance: float) -> list[dict]:
    xy = np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)
    if len(xy) < 3:
        return []
    left = np.concatenate([_simplified_arc(arc, tolerance)[:-1] for arc in _arcs(xy, cuts)])
    return [{"x": x, "y": y} for x, y in left.tolist()] if len(np.unique(left, axis=0)) > 2 else []


def simplified_zones(zones: DataFrame, key: str, rings: str, tolerance: float) -> DataFrame:
    """(key, rings) with rings thinned to ``tolerance`` and open; rings that keep fewer than three points are left out.

    ``key`` names a row. Points are compared by value, so borders are shared where their coordinates are the same.
    """
    each = zones.select(F.col(key), F.posexplode(rings).alias("_ring", "_closed"))
    each = each.withColumn("_open", _without_repeats(F.col("_closed"))).filter(F.size("_open") > 0).select(key, "_ring", "_open")
    n = F.size("_open")
    corner = F.transform("_open", lambda p, i: F.struct(i.alias("at"), p.alias("p"), F.array(F.get("_open", F.pmod(i - 1, n)), F.get("_open", F.pmod(i + 1, n))).alias("near")))
    corners = each.select(key, "_ring", F.explode(corner).alias("_c")).select(key, "_ring", "_c.*")
    neighbours = corners.select("p", F.explode("near").alias("q")).distinct().groupBy("p").agg(F.count("*").alias("n"))
    cuts = corners.join(neighbours.filter("n <> 2").select("p"), "p", "left_semi").groupBy(key, "_ring").agg(F.sort_array(F.collect_list("at")).alias("_cuts"))

    @F.arrow_udf(POINTS)
    def thinned(points: pa.Array, at: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.array([_simplified_ring(p, c or [], tolerance) for p, c in zip(points.to_pylist(), at.to_pylist(), strict=True)], kind)

    # each ring is one array of its zone's row already, so gathering a zone's rings holds no more than that row did
    done = each.join(cuts, [key, "_ring"], "left").withColumn("_thin", thinned("_open", "_cuts")).filter(F.size("_thin") > 0)
    gathered = done.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_ring", "_thin"))), lambda r: r["_thin"]).alias(rings))
    return zones.select(key).join(gathered, key, "left").withColumn(rings, F.coalesce(rings, F.array().cast(f"array<{POINTS}>")))
