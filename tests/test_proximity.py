"""Greedy proximity against the fold in order, on dense and scattered keys, folded and by rounds."""

import math
import random

import pytest

from spanforge.operators import windows
from spanforge.session import importable


def plain(rows, km):
    out, kept = {}, {}
    for key, k, lat, lng, order in sorted(rows, key=lambda r: (r[4], r[1])):
        if lat is None or lng is None:
            out[key, k] = k
            continue
        near = None
        for other, a, b in kept.get(key, []):
            h = math.sin(math.radians(lat - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(lat)) * math.sin(math.radians(lng - b) / 2) ** 2
            if 2 * 6371.0 * math.asin(math.sqrt(h)) < km:
                near = other
                break
        if near is None:
            kept.setdefault(key, []).append((k, lat, lng))
        out[key, k] = k if near is None else near
    return out


def places(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(500):
        key = rng.choice(["dense", "dense", "line", "world", None])
        if key == "dense":
            lat, lng = 40 + rng.uniform(0, 0.05), -75 + rng.uniform(0, 0.05)
        elif key == "line":  # ordered along itself, the longest chain of rounds
            lat, lng = 10 + k * 0.0002, 20.0
        elif key == "world":
            lat, lng = rng.choice([(89.9999, rng.uniform(-180, 180)), (rng.uniform(-0.01, 0.01), rng.choice([179.999, -179.999, 179.995])), (rng.uniform(-90, 90), rng.uniform(-180, 180)), (60 + rng.uniform(0, 0.02), rng.uniform(5, 5.05))])
        else:
            lat, lng = rng.uniform(0, 0.03), rng.uniform(0, 0.03)
        if rng.random() < 0.02:
            lat = None
        rows.append((key, k, lat, lng, k if key == "line" else rng.randrange(200)))
    return rows


@pytest.mark.parametrize(("fold_rows", "km"), [(20_000, 1.0), (0, 1.0), (30, 2.5)])
def test_rounds_give_what_the_fold_gives(spark, fold_rows, km):
    importable(spark)
    rows = places(3)
    df = spark.createDataFrame(rows, "name string, k long, lat double, lng double, ord int")
    found = windows.greedy_proximity(df, "name", "k", "lat", "lng", "ord", km, fold_rows)
    assert {(r.name, r.k): r.kept_id for r in found.collect()} == plain(rows, km)
    assert found.count() == len(rows) and found.columns == ["name", "k", "kept_id"]


def test_no_places(spark):
    importable(spark)
    df = spark.createDataFrame([], "name int, k long, lat double, lng double, ord int")
    assert windows.greedy_proximity(df, "name", "k", "lat", "lng", "ord", 1.0).count() == 0
