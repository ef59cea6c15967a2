"""Points in zones, nested rings, borders and shapes against plain versions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import geometry
from spanforge.operators import borders, spatial
from spanforge.plans import zones as plans
from spanforge.session import importable

SHAPE = "array<array<array<struct<x:double,y:double>>>>"
RINGS = "array<array<struct<x:double,y:double>>>"


def dicts(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def star(rng, n, cx, cy, r, grid):
    out = []
    for k in range(n):
        q = r * rng.uniform(0.4, 1)
        out.append((round((cx + q * math.cos(2 * math.pi * k / n)) * grid) / grid, round((cy + q * math.sin(2 * math.pi * k / n)) * grid) / grid))
    return out


def in_ring(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def contains(polygons, x, y):
    return any(sum(in_ring(x, y, [(p["x"], p["y"]) for p in ring]) for ring in rings) % 2 for rings in polygons or [])


@pytest.fixture(scope="module")
def case(spark):
    importable(spark)
    rng = random.Random(1)
    zones = []
    for z in range(30):
        grid, polygons = rng.choice([1, 2, 4, 1000]), []
        for _ in range(rng.randint(1, 3)):
            cx, cy, r = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.5, 3, 10])
            rings = [star(rng, rng.randint(3, 30), cx, cy, r, grid)] + [star(rng, 5, cx, cy, r / 5, grid)] * rng.randint(0, 1)
            polygons.append([dicts(ring + ring[:1] * rng.randint(0, 1)) for ring in rings])
        zones.append((z, polygons))
    zones += [(99, None), (98, []), (97, [[dicts([(1, 1)])]]), (96, [[[]]])]
    at = lambda: rng.choice([rng.uniform(-25, 25), float(rng.randint(-20, 20)), rng.randint(-80, 80) / 4])  # noqa: E731  many lie on corners and borders
    points = [(k, at(), at(), rng.randrange(40)) for k in range(1500)] + [(3001, None, 1.0, 1), (3002, 1.0, None, 99)]
    return spark.createDataFrame(points, "k int, x double, y double, own int"), spark.createDataFrame(zones, f"z int, shape {SHAPE}"), points, dict(zones)


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_points_meet_the_zones_that_hold_them(case, hot):
    points, zones, rows, shapes = case
    want = sorted((k, z) for k, x, y, _ in rows if x is not None and y is not None for z, p in shapes.items() if contains(p, x, y))
    found = spatial.zones_of_points(points, "x", "y", zones, "z", "shape", hot)
    assert sorted((r.k, r.z) for r in found.collect()) == want and found.columns == ["k", "x", "y", "own", "z"]
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_points_outside_their_zone(case):
    points, zones, rows, shapes = case
    want = {k for k, x, y, own in rows if x is not None and y is not None and own in shapes and not contains(shapes[own], x, y)}
    assert {r.k for r in spatial.outside_own_zone(points, "x", "y", "own", zones, "z", "shape").collect()} == want


def test_no_zones_and_no_points(case):
    points, zones, _, _ = case
    assert spatial.zones_of_points(points, "x", "y", zones.limit(0), "z", "shape").count() == 0
    assert spatial.zones_of_points(points.limit(0), "x", "y", zones, "z", "shape").count() == 0


def test_only_cells_on_a_border_hold_edges():
    square = [dicts([(0, 0), (64, 0), (64, 64), (0, 64)])]
    level, cells = spatial._zone_cells([square])
    inner = [parts for parts in cells.values() if not parts[0]["edges"]]
    assert len(inner) > len(cells) / 3 and all(p["base"] and not p["flips"] for parts in inner for p in parts)
    assert max(len(p["edges"]) for parts in cells.values() for p in parts) <= 2


def shape_of(spark, rings):
    return spark.createDataFrame([([dicts(r) for r in rings],)], f"rings {RINGS}").select(geometry.nested(F.col("rings")).alias("x")).first().x


def square(x, y, half):
    return [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]


def test_rings_nest_by_what_lies_in_what(spark):
    importable(spark)
    lake, island, pond = square(0, 0, 6), square(1, 0, 3), square(1, 0, 1)
    other = square(30, 0, 5)
    got = shape_of(spark, [pond, other[::-1], island[::-1], square(0, 0, 10), lake, square(0, 0, 10)[::-1], [(0, 0), (1, 1)], [(5, 5), (6, 6), (7, 7)], []])
    sides = [[round(abs(2 * sum(a.x * b.y - b.x * a.y for a, b in zip(r, r[1:])) / 2) ** 0.5 / 2**0.5 / 2, 6) for r in p] for p in got]
    assert sides == [[10, 6], [5], [3, 1]]
    signs = [[sum(a.x * b.y - b.x * a.y for a, b in zip(r, r[1:])) > 0 for r in p] for p in got]
    assert signs == [[True, False], [True], [True, False]] and all(r[0] == r[-1] for p in got for r in p)
    assert shape_of(spark, []) == [] and shape_of(spark, [[(0, 0), (1, 0)]]) == []


def test_many_holes_touching_their_outline(spark):
    importable(spark)
    outline = square(50, 50, 50)
    holes = [square(5 + 10 * k, 5, 2) for k in range(9)] + [[(0, 0), (3, 20), (1, 20)]]
    got = shape_of(spark, [*holes, outline])
    assert len(got) == 1 and len(got[0]) == 11


def wandering(rng, a, b, n):
    """A jagged line from a to b, ends included."""
    (ax, ay), (bx, by) = a, b
    line = [a] + [(ax + (bx - ax) * k / n + rng.uniform(-0.03, 0.03), ay + (by - ay) * k / n + rng.uniform(-0.03, 0.03)) for k in range(1, n)] + [b]
    return line


def test_neighbours_keep_the_same_border(spark):
    importable(spark)
    rng = random.Random(4)
    lines = {}
    for c in range(6):
        for r in range(6):
            lines[(c, r), (c + 1, r)] = wandering(rng, (c, r), (c + 1, r), 25)
            lines[(c, r), (c, r + 1)] = wandering(rng, (c, r), (c, r + 1), 25)
    lake = star(rng, 40, 2.5, 2.5, 0.3, 1000)
    rows = []
    for c in range(5):
        for r in range(5):
            path = lines[(c, r), (c + 1, r)] + lines[(c + 1, r), (c + 1, r + 1)][1:] + lines[(c, r + 1), (c + 1, r + 1)][::-1][1:] + lines[(c, r), (c, r + 1)][::-1][1:-1]
            turn = rng.randrange(len(path))
            rings = [dicts(path[turn:] + path[:turn])]
            if (c, r) == (2, 2):
                rings.append(dicts(lake[::-1]))
            rows.append((c * 5 + r, rings))
    rows.append((100, [dicts(lake[7:] + lake[:7] + lake[7:8])]))  # the lake is a zone of its own
    rows.append((101, None))
    rows.append((102, [dicts([(0, 0), (0, 0), (0.001, 0.001)])]))
    out = {r.z: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in borders.simplified_zones(spark.createDataFrame(rows, f"z int, rings {RINGS}"), "z", "rings", 0.02).collect()}
    assert set(out) == {z for z, _ in rows} and out[101] == [] == out[102]
    assert sum(len(ring) for rings in out.values() for ring in rings) < 0.8 * sum(len(ring) for _, rings in rows for ring in rings or [])
    for (a, b), line in lines.items():
        dx, dy = b[0] - a[0], b[1] - a[1]
        one, two = ((a[0], a[1]), (a[0], a[1] - 1)) if dx else ((a[0], a[1]), (a[0] - 1, a[1]))
        kept = [[p for p in out[c * 5 + r][0] if p in set(line)] for c, r in (one, two) if 0 <= c < 5 and 0 <= r < 5]
        assert not kept or all(set(k) == set(kept[0]) for k in kept) and {a, b} - {(0, 0), (5, 0), (0, 5), (5, 5)} <= set(kept[0])
    inner, own = set(out[12][1]), set(out[100][0])
    assert inner == own and len(own) > 3


def test_thinned_points_stay_near(spark):
    importable(spark)
    rng = random.Random(8)
    line = wandering(rng, (0, 0), (3, 0), 60) + [(3, 3), (0, 3)]
    (row,) = borders.simplified_zones(spark.createDataFrame([(1, [dicts(line)])], f"z int, rings {RINGS}"), "z", "rings", 0.02).collect()
    kept = [(p.x, p.y) for p in row.rings[0]]
    away = lambda p, a, b: math.dist(p, (a[0] + (t := max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / max(math.dist(a, b) ** 2, 1e-12)))) * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    assert all(min(away(p, a, b) for a, b in zip(kept, kept[1:] + kept[:1])) <= 0.02 + 1e-9 for p in line)


def test_zone_shapes_name_what_is_missing(spark):
    importable(spark)
    box = dicts(square(0, 0, 4))
    rows = [("a", 2, [dicts(square(0, 0, 1))]), ("a", 1, [box, dicts(square(0, 0, 1)[::-1]), dicts(square(20, 0, 2))]), ("b", 3, [dicts([(0, 0), (1e-4, 0), (0, 1e-4)])]), ("c", 4, [box]), ("e", 5, None)]
    records = spark.createDataFrame(rows, f"zone string, record int, rings {RINGS}")
    wanted = spark.createDataFrame([("a",), ("b",), ("d",), ("a",), ("e",), (None,)], "zone string")
    shapes = plans.zone_shapes(records, "zone", "record", "rings", wanted, 0.01)
    got = {r.zone: (r.status, r.geometry) for r in shapes.collect()}
    assert {z: s for z, (s, _) in got.items()} == {"a": "drawn", "b": "emptied", "d": "missing", "e": "emptied"}
    shape = json.loads(got["a"][1])
    assert shape["type"] == "MultiPolygon" and [len(p) for p in shape["coordinates"]] == [2, 1] and shape["coordinates"][0][0][0] == shape["coordinates"][0][0][-1]
    assert tuple(plans.shape_report(shapes).first()) == (4, 1, 1, 2)


@pytest.mark.parametrize("name", ["points_in_zones", "points_outside_their_zone"])
def test_cells_of_zones_are_not_broadcast_by_a_guessed_size(spark, name):
    from spanforge.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    at = [line for line in plan.splitlines() if "Join" in line and "_col" in line and "_row" in line]
    assert at and all("SortMergeJoin" in line for line in at)
