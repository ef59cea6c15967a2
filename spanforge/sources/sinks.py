"""Sinks: flat files, GeoJSON, nested profiles, positional series, logs, side outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The declared columns, nested ones as JSON."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = ()) -> None:
    """CSV files with a header; sorted over all files where an order is given."""
    out = flat(df, columns)
    (out.orderBy(*order) if order else out).write.mode("overwrite").option("header", True).csv(path)


def features(df: DataFrame, lng: str, lat: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row as ``value``; rows without coordinates have none."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lng), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.filter(F.col(lng).isNotNull() & F.col(lat).isNotNull()).select(F.to_json(feature).alias("value"))


def write_features(df: DataFrame, path: str, lng: str, lat: str, properties: Sequence[str]) -> dict[str, int]:
    """Line-delimited features, and counters of what was written and left out as a file beside them."""
    features(df, lng, lat, properties).write.mode("overwrite").text(f"{path}/features")
    row = df.agg(F.count("*").alias("rows"), F.count_if(F.col(lng).isNull() | F.col(lat).isNull()).alias("without_coordinates")).first()
    counters = row.asDict()
    df.sparkSession.createDataFrame([row], "rows long, without_coordinates long").coalesce(1).write.mode("overwrite").json(f"{path}/counters")
    return counters


def nested_profile(**parts: DataFrame) -> DataFrame:
    """One row with each part as an array of its rows: for summaries of a few rows."""
    out: DataFrame | None = None
    for name, df in parts.items():
        listed = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        out = listed if out is None else out.join(listed)
    assert out is not None
    return out


def positional_series(df: DataFrame, entity: str, year: str, values: Sequence[str], digits: int = 4) -> DataFrame:
    """(entity, map of year to an array of rounded values); years without any value are left out."""
    some = F.coalesce(*map(F.col, values)).isNotNull()
    packed = F.struct(F.col(year), F.array(*(F.round(v, digits) for v in values)))
    return df.filter(some).groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(packed))).alias("series"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_split(df: DataFrame, tag: str, path: str) -> None:
    """Kept and rejected rows as partitions by their tag; nothing is lost."""
    df.write.mode("overwrite").partitionBy(tag).parquet(path)


def publish(tables: dict[str, DataFrame], allowed: Sequence[str], path: str) -> list[str]:
    """Write only what is on the list; return what was written."""
    written = [name for name in allowed if name in tables]
    for name in written:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    return written
