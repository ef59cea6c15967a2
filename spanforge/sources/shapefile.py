"""Shapefiles, zipped or not, as a Spark data source.

``spark.read.format("shapefile").load(path)`` reads polygons, lines and points with their attributes. The index file gives
the place of every record, so a file is read in ranges of records, one task each. Attributes are decoded before shapes:
the conditions of ``scan`` drop records whose shape is then never read, and only the columns of a declared schema are decoded.

Columns: ``record`` (number in the file, from 0), ``rings`` (parts as arrays of points, null for a null shape) and the
attributes by name. Options: ``path`` (comma-separated patterns), ``base`` (the member's name without its ending, where a zip holds several),
``rangeSize`` (records of a task), ``where`` (packed conditions), ``encoding`` (else the .cpg file's, else UTF-8).
"""

from __future__ import annotations

import datetime as dt
import glob
import io
import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import IO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from spanforge.session import importable
from spanforge.sources.conditions import Condition, exactly, holds, packed, unpacked

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
#: Shape types by what they hold (the format's own numbers): points, parts of points, bare lists of points.
POINT, PARTS, MULTIPOINT = {1, 11, 21}, {3, 5, 13, 15, 23, 25}, {8, 18, 28}
HEADER = 100


def opened(path: str) -> IO[bytes]:
    """A seekable file, by its address if it has one."""
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class Stretch(io.RawIOBase):
    """A stored member of a zip as a file of its own."""

    def __init__(self, file: IO[bytes], info: zipfile.ZipInfo):
        file.seek(info.header_offset + 26)
        name, extra = struct.unpack("<HH", file.read(4))
        self.file, self.start, self.size, self.at = file, info.header_offset + 30 + name + extra, info.file_size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer: bytearray) -> int:
        self.file.seek(self.start + self.at)
        data = self.file.read(max(0, min(len(buffer), self.size - self.at)))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


class Members:
    """The .shp, .shx, .dbf and .cpg files of one shapefile."""

    def __init__(self, path: str, base: str | None):
        self.path, self.zip = path, None
        if path.lower().endswith(".zip"):
            self.zip = zipfile.ZipFile(opened(path))
            names = self.zip.namelist()
            bases = sorted({n[:-4] for n in names if n.lower().endswith(".shp")})
            chosen = [b for b in bases if base in (None, b, b.rsplit("/", 1)[-1])]
            if len(chosen) != 1:
                raise ValueError(f"{path} holds {bases}; option base must name one of them")
            self.names = {n[-3:].lower(): n for n in names if n[:-4] == chosen[0]}
        else:
            self.base = path[:-4]

    def open(self, kind: str) -> IO[bytes]:
        if self.zip:
            info = self.zip.getinfo(self.names[kind])
            # a stored member is a stretch of the file, so its ranges are read alone; a packed one is unpacked up to the range
            return io.BufferedReader(Stretch(opened(self.path), info)) if info.compress_type == zipfile.ZIP_STORED else self.zip.open(info)
        return opened(f"{self.base}.{kind}")

    def has(self, kind: str) -> bool:
        if self.zip:
            return kind in self.names
        try:
            self.open(kind).close()
        except OSError:
            return False
        return True


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    length: int
    decimals: int
    at: int

    def type(self) -> T.DataType:
        whole = self.kind == "N" and self.decimals == 0 and self.length <= 18
        return T.LongType() if whole else T.DoubleType() if self.kind in "NFO" else {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def value(self, record: bytes, encoding: str) -> object:
        raw = record[self.at : self.at + self.length]
        text = raw.strip(b" \0")
        if not text:
            return None
        kind = self.type()
        try:
            if isinstance(kind, T.LongType):
                return int(text)
            if isinstance(kind, T.DoubleType):
                return float(text)
            if isinstance(kind, T.DateType):
                return dt.datetime.strptime(text.decode("ascii"), "%Y%m%d").date()
        except ValueError:
            return None  # stars and other fillers stand for nothing
        if isinstance(kind, T.BooleanType):
            return True if text in b"YyTt" else False if text in b"NnFf" else None
        return raw.rstrip(b" \0").decode(encoding, "replace")


@dataclass(frozen=True)
class Attributes:
    fields: tuple[Attribute, ...]
    start: int
    width: int
    count: int
    encoding: str


def attributes(members: Members, encoding: str | None) -> Attributes:
    """The attribute file's header."""
    with members.open("dbf") as file:
        count, start, width = struct.unpack("<4xIHH20x", file.read(32))
        fields, at = [], 1
        for raw in iter(lambda: file.read(32), b""):
            if raw[0] == 0x0D:
                break
            name, kind, length, decimals = struct.unpack("<11sc4xBB14x", raw)
            fields.append(Attribute(name.split(b"\0")[0].decode("ascii", "replace"), kind.decode(), length, decimals, at))
            at += length
    if not encoding and members.has("cpg"):
        with members.open("cpg") as file:
            encoding = file.read().decode("ascii", "ignore").strip()
    return Attributes(tuple(fields), start, width, count, encoding or "utf-8")


def rings_of(content: bytes) -> list[list[dict]] | None:
    """A record's parts; null for a null shape."""
    (kind,) = struct.unpack_from("<i", content)
    if kind in POINT:
        flat, parts = np.frombuffer(content, "<f8", 2, 4), [0]
    elif kind in MULTIPOINT:
        (n,) = struct.unpack_from("<36xi", content)
        flat, parts = np.frombuffer(content, "<f8", 2 * n, 40), [0]
    elif kind in PARTS:
        n_parts, n = struct.unpack_from("<36xii", content)
        parts = np.frombuffer(content, "<i4", n_parts, 44).tolist()
        flat = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * n_parts)
    else:
        return None
    points = [{"x": x, "y": y} for x, y in flat.reshape(-1, 2).tolist()]
    return [points[a:b] for a, b in zip(parts, [*parts[1:], len(points)], strict=True)]


@dataclass
class Range(D.InputPartition):
    """Records ``low`` to ``high`` of a file."""

    path: str
    low: int
    high: int


class ShapefileReader(D.DataSourceReader):
    def __init__(self, paths: Sequence[str], options: dict[str, str], schema: T.StructType):
        self.paths, self.schema = list(paths), schema
        self.base, self.encoding = options.get("base"), options.get("encoding")
        self.size = int(options.get("rangesize", 10_000))
        self.where = unpacked(options.get("where"))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            members = Members(path, self.base)
            n = attributes(members, self.encoding).count
            numbered = [c for c in self.where if c[0] == "record"]
            for low in range(0, n, self.size):
                high = min(low + self.size, n)
                if not numbered or any(all(holds(c, k) for c in numbered) for k in range(low, high)):
                    out.append(Range(path, low, high))
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        members = Members(partition.path, self.base)
        header = attributes(members, self.encoding)
        known = {a.name: a for a in header.fields}
        count = partition.high - partition.low
        with members.open("shx") as file:
            file.seek(HEADER + 8 * partition.low)
            index = np.frombuffer(file.read(8 * count), ">i4").reshape(-1, 2).astype(np.int64) * 2  # in words of two bytes
        wanted = [f.name for f in self.schema]
        with members.open("dbf") as records, members.open("shp") as shapes:
            records.seek(header.start + header.width * partition.low)
            for k in range(count):
                record = records.read(header.width)
                if record[:1] == b"*":  # deleted
                    continue
                row: dict[str, object] = {"record": partition.low + k}

                def value(name: str) -> object:
                    if name not in row:
                        row[name] = known[name].value(record, header.encoding) if name in known else None
                    return row[name]

                if not all(holds(c, value(c[0])) for c in self.where):
                    continue
                if "rings" in wanted:
                    shapes.seek(int(index[k, 0]) + 8)
                    row["rings"] = rings_of(shapes.read(int(index[k, 1])))
                yield tuple(value(name) for name in wanted)


class ShapefileSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def paths(self) -> list[str]:
        out = []
        for pattern in self.options["path"].split(","):
            out += [pattern] if "://" in pattern else sorted(glob.glob(pattern.removeprefix("file:")))
        if not out:
            raise FileNotFoundError(self.options["path"])
        return out

    def schema(self) -> T.StructType:
        header = attributes(Members(self.paths()[0], self.options.get("base")), self.options.get("encoding"))
        fixed = [T.StructField("record", T.LongType()), T.StructField("rings", RINGS)]
        return T.StructType(fixed + [T.StructField(a.name, a.type()) for a in header.fields])

    def reader(self, schema: T.StructType) -> ShapefileReader:
        return ShapefileReader(self.paths(), dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    importable(spark)
    spark.dataSource.register(ShapefileSource)


def scan(spark: SparkSession, path: str, where: Sequence[Condition] = (), schema: str | None = None, **options: object) -> DataFrame:
    """Records that meet the conditions; the source decides on those before it reads shapes."""
    reader = spark.read.format("shapefile").options(where=packed(where), **options)
    return (reader.schema(schema) if schema else reader).load(path).filter(exactly(where))
