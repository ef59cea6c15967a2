"""A remote SQL service as a Spark data source.

The service answers ``GET url?sql=...`` with a JSON array of rows. A scan asks it for the columns of the declared schema only,
in ranges of a unique numeric key (one task each) and within a range page by page, so no answer exceeds what the service
gives at once. Conditions go along as SQL; those on texts, and a chain of LIKE patterns over several columns, are loose on
purpose and may let too much through: ``scan`` applies the exact conditions above.

Options: ``url``; ``query`` (a table or a SELECT); ``key``; ``partitions``; ``lower`` and ``upper`` (bounds of the key, asked for if not
given); ``page`` (rows of an answer); ``where`` (packed conditions); ``likeColumns`` and ``likePatterns`` (JSON lists: a row is
wanted if any pattern occurs in the columns joined by blanks, without regard to case); ``retries``; ``timeout`` (seconds).
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from spanforge.session import importable
from spanforge.sources.conditions import Condition, as_sql, exactly, packed, quoted, unpacked


def named(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def ask(url: str, sql: str, page: int, retries: int, timeout: float) -> list[dict]:
    """A service's rows; what may pass by itself (no connection, too many requests, its own errors) is asked again."""
    wait = 0.2
    for left in range(retries, -1, -1):
        try:
            request = urllib.request.Request(f"{url}?{urllib.parse.urlencode({'sql': sql, '_shape': 'array', '_size': page})}")
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                rows = json.load(answer)
            if not isinstance(rows, list):
                raise ValueError(f"the service answered {str(rows)[:200]} to {sql[:200]}")
            return rows
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            passing = not isinstance(error, urllib.error.HTTPError) or error.code == 429 or error.code >= 500
            if not left or not passing:
                raise
            time.sleep(wait)
            wait *= 2
    return []


def converted(value: object, kind: T.DataType) -> object:
    """A JSON value as a column's type; what is no such value is null."""
    if value is None or value == "" and not isinstance(kind, T.StringType):
        return None
    try:
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list, bool)) else str(value)
        if isinstance(kind, T.BooleanType):
            return bool(int(value))
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, T.FractionalType):
            return float(value)
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(str(value)[:10])
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return dt.datetime.fromisoformat(str(value))
    except ValueError:
        return None
    raise TypeError(f"no {kind.simpleString()} from a remote service")


@dataclass
class Keys(D.InputPartition):
    """Rows with low <= key < high; no bound where it is null."""

    low: int | None
    high: int | None


class RemoteReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        get = lambda name, otherwise=None: options.get(name, options.get(name.lower(), otherwise))
        self.schema, self.url, self.key = schema, get("url"), get("key")
        query = get("query")
        self.query = f"({query})" if " " in query.strip() else named(query)
        self.n, self.page = int(get("partitions", 1)), int(get("page", 1000))
        self.retries, self.timeout = int(get("retries", 3)), float(get("timeout", 120))
        self.bounds = tuple(int(get(b)) if get(b) is not None else None for b in ("lower", "upper"))
        self.where = [as_sql(c) for c in unpacked(get("where"))]
        columns, patterns = json.loads(get("likeColumns", "[]")), json.loads(get("likePatterns", "[]"))
        if columns and patterns:
            text = "upper(" + " || ' ' || ".join(f"coalesce({named(c)}, '')" for c in columns) + ")"
            self.where.append("(" + " OR ".join(f"{text} LIKE {quoted('%' + p.upper() + '%')}" for p in patterns) + ")")

    def ask(self, sql: str, page: int = 1) -> list[dict]:
        return ask(self.url, sql, page, self.retries, self.timeout)

    def partitions(self) -> list[Keys]:
        """Ranges of the key, open at both ends so that bounds never leave a row out."""
        if self.n <= 1:
            return [Keys(None, None)]
        low, high = self.bounds
        if low is None or high is None:
            conditions = f" WHERE {' AND '.join(self.where)}" if self.where else ""
            row = self.ask(f"SELECT min({named(self.key)}) AS low, max({named(self.key)}) AS high FROM {self.query}{conditions}")[0]
            low, high = (row[k] if b is None else b for k, b in (("low", low), ("high", high)))
        if low is None or high is None:
            return [Keys(None, None)]
        cuts = sorted({int(low + (high + 1 - low) * k // self.n) for k in range(1, self.n)})
        return [Keys(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Keys) -> Iterator[tuple]:
        names = [f.name for f in self.schema]
        asked = ", ".join(named(c) for c in dict.fromkeys([*names, self.key]))
        key, low = named(self.key), f"{named(self.key)} >= {partition.low}" if partition.low is not None else None
        while True:
            conditions = [*self.where, *([low] if low else []), *([f"{key} < {partition.high}"] if partition.high is not None else [])]
            rows = self.ask(f"SELECT {asked} FROM {self.query}{' WHERE ' + ' AND '.join(conditions) if conditions else ''} ORDER BY {key} LIMIT {self.page}", self.page)
            for row in rows:
                yield tuple(converted(row[f.name], f.dataType) for f in self.schema)
            if len(rows) < self.page:
                return
            low = f"{key} > {quoted(rows[-1][self.key])}"


class RemoteSqlSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_sql"

    def reader(self, schema: T.StructType) -> RemoteReader:
        return RemoteReader(dict(self.options), schema)


def scan(spark: SparkSession, url: str, query: str, schema: str, key: str, where: Sequence[Condition] = (), like: tuple[Sequence[str], Sequence[str]] | None = None, **options: object) -> DataFrame:
    """Rows of a remote table or SELECT. ``where`` holds exactly; ``like`` (columns, patterns) is a loose choice of candidates."""
    importable(spark)
    spark.dataSource.register(RemoteSqlSource)
    reader = spark.read.format("remote_sql").schema(schema).options(url=url, query=query, key=key, where=packed(where), **options)
    if like:
        reader = reader.options(likeColumns=json.dumps(list(like[0])), likePatterns=json.dumps(list(like[1])))
    # conditions may be on columns that the caller does not ask for: those hold at the service alone
    known = {f.strip().split()[0].strip("`") for f in schema.split(",")}
    return reader.load().filter(exactly([c for c in where if c[0] in known]))
