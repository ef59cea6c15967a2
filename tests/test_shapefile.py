"""The shapefile source on files written by hand."""

import datetime as dt
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from spanforge.plans.zones import zone_shapes
from spanforge.sources import conditions, shapefile


def shape(kind, parts):
    if kind == 0:
        return struct.pack("<i", 0)
    points = [p for part in parts for p in part]
    flat = b"".join(struct.pack("<dd", *p) for p in points)
    if kind == 1:
        return struct.pack("<i", 1) + flat
    xs, ys = zip(*points)
    box = struct.pack("<4d", min(xs), min(ys), max(xs), max(ys))
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    return struct.pack("<i", kind) + box + struct.pack("<ii", len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + flat


def files(rows, kind=5):
    """rows: (parts or None, GEOID, AREA, LAND, OPEN, SINCE, deleted)."""
    shp, shx, at = b"", b"", 50
    for k, (parts, *_) in enumerate(rows):
        content = shape(0 if parts is None else kind, parts)
        shp += struct.pack(">ii", k + 1, len(content) // 2) + content
        shx += struct.pack(">ii", at, len(content) // 2)
        at += 4 + len(content) // 2
    head = lambda n: struct.pack(">i20xi", 9994, 50 + n // 2) + struct.pack("<ii64x", 1000, kind)
    fields = [("GEOID", b"C", 8, 0), ("AREA", b"N", 10, 0), ("LAND", b"N", 12, 3), ("OPEN", b"L", 1, 0), ("SINCE", b"D", 8, 0)]
    width = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<B3xIHH20x", 3, len(rows), 33 + 32 * len(fields), width)
    for name, type_, length, decimals in fields:
        dbf += struct.pack("<11sc4xBB14x", name.encode(), type_, length, decimals)
    dbf += b"\r"
    for _, geoid, area, land, open_, since, deleted in rows:
        dbf += (b"*" if deleted else b" ") + geoid.encode().ljust(8) + str(area if area is not None else "").rjust(10).encode() + ("*" * 12 if land is None else f"{land:12.3f}").encode() + open_.encode() + (since or "").ljust(8).encode()
    return {"shp": head(len(shp)) + shp, "shx": head(len(shx)) + shx, "dbf": dbf, "cpg": b"UTF-8"}


def square(k, half=1.0):
    return [(k - half, -half), (k - half, half), (k + half, half), (k + half, -half), (k - half, -half)]


ROWS = [([square(10 * k), square(10 * k, 0.25)[::-1]] if k % 5 else None, f"é{k:03}", k if k % 4 else None, k / 8 if k % 3 else None, "TF?"[k % 3], "20240229" if k % 2 else None, k == 7) for k in range(25)]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    shapefile.register(spark)
    folder = tmp_path_factory.mktemp("shapes")
    for name, kind in (("stored", zipfile.ZIP_STORED), ("packed", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(folder / f"{name}.zip", "w", kind) as z:
            for ending, data in files(ROWS).items():
                z.writestr(f"in/zones.{ending}", data)
            for ending, data in files([([[(1.0, 2.0)]], "p", 1, 1.0, "T", None, False)], 1).items():
                z.writestr(f"in/points.{ending}", data)
    for ending, data in files(ROWS).items():
        (folder / f"plain.{ending}").write_bytes(data)
    return folder


def read(spark, path, name="packed.zip", **options):
    return spark.read.format("shapefile").options(**({"base": "zones", "rangeSize": 4} | options)).load(f"{path}/{name}")


@pytest.mark.parametrize("name", ["stored.zip", "packed.zip", "plain.shp"])
def test_records_come_back(spark, path, name):
    df = read(spark, path, name)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema] == ["record bigint", "rings array<array<struct<x:double,y:double>>>", "GEOID string", "AREA bigint", "LAND double", "OPEN boolean", "SINCE date"]
    assert df.rdd.getNumPartitions() == 7
    got = {r.record: r for r in df.collect()}
    assert set(got) == set(range(25)) - {7}
    for k, (parts, geoid, area, land, open_, since, _) in enumerate(ROWS):
        if k == 7:
            continue
        r = got[k]
        assert (r.GEOID, r.AREA, r.LAND, r.OPEN, r.SINCE) == (geoid, area, land, {"T": True, "F": False, "?": None}[open_], dt.date(2024, 2, 29) if since else None)
        assert (r.rings is None and parts is None) or [[(p.x, p.y) for p in ring] for ring in r.rings] == parts


def test_other_shapes_and_several_files(spark, path):
    (row,) = read(spark, path, base="points").collect()
    assert [[tuple(p) for p in ring] for ring in row.rings] == [[(1.0, 2.0)]] and row.GEOID == "p"
    both = spark.read.format("shapefile").option("base", "zones").load(f"{path}/*ed.zip")
    assert both.count() == 48
    with pytest.raises(Exception, match="base must name one"):
        spark.read.format("shapefile").load(f"{path}/packed.zip")
    with pytest.raises(Exception, match="none.shp"):
        spark.read.format("shapefile").load(f"{path}/none.shp")


def test_only_declared_columns_are_decoded(spark, path, monkeypatch):
    df = spark.read.schema("GEOID string, AREA long").format("shapefile").option("base", "zones").load(f"{path}/packed.zip")
    assert df.columns == ["GEOID", "AREA"] and df.count() == 24
    header = shapefile.attributes(shapefile.Members(f"{path}/packed.zip", "zones"), None)
    reader = shapefile.ShapefileReader([f"{path}/packed.zip"], {"base": "zones"}, df.schema)
    monkeypatch.setattr(shapefile, "rings_of", lambda _: pytest.fail("a shape was read"))
    assert len(list(reader.read(reader.partitions()[0]))) == 24 and len(header.fields) == 5


def test_conditions_leave_shapes_unread(spark, path, monkeypatch):
    scan = lambda *where: shapefile.scan(spark, f"{path}/packed.zip", where, base="zones", rangeSize=4)
    some = scan(("AREA", ">=", 9), ("GEOID", "starts", "é0"), ("OPEN", "=", True), ("record", "<", 20))
    assert sorted(r.record for r in some.collect()) == [k for k in range(20) if k % 4 and k >= 9 and k % 3 == 0]
    assert {r.GEOID for r in scan(("GEOID", "in", ["é003", "é004", "x"]), ("AREA", "is null", None)).collect()} == {"é004"}
    assert scan(("SINCE", "=", dt.date(2024, 2, 29)), ("LAND", "is not null", None), ("GEOID", "ends", "1")).count() == sum(1 for k in range(25) if k % 2 and k % 3 and k % 10 == 1)
    # one scan's conditions are not another's
    every, few = scan(), scan(("AREA", ">=", 9))
    assert (every.count(), few.count(), every.count(), every.join(few, "record").count()) == (24, 12, 24, 12)
    reader = shapefile.ShapefileReader([f"{path}/packed.zip"], {"base": "zones", "rangesize": "4", "where": conditions.packed([("GEOID", "=", "é011"), ("record", ">", 8)])}, every.schema)
    read_shapes, plain = [], shapefile.rings_of
    monkeypatch.setattr(shapefile, "rings_of", lambda content: read_shapes.append(1) or plain(content))
    ranges = reader.partitions()
    assert [r.low for r in ranges] == [8, 12, 16, 20, 24]
    assert [row[0] for r in ranges for row in reader.read(r)] == [11] and len(read_shapes) == 1
    with pytest.raises(ValueError, match="unknown operator"):
        scan(("GEOID", "like", "x"))


def test_zones_from_a_boundary_file(spark, path):
    wanted = spark.createDataFrame([("é001",), ("é000",), ("nowhere",)], "GEOID string")
    shapes = zone_shapes(read(spark, path), "GEOID", "record", "rings", wanted, 0.01)
    assert {(r.GEOID, r.status, len(r.polygons or [])) for r in shapes.collect()} == {("é001", "drawn", 1), ("é000", "emptied", 0), ("nowhere", "missing", 0)}
    assert shapes.filter(F.size(F.get("polygons", F.lit(0))) == 2).count() == 1
