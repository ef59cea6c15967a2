"""Event streams: reading, windowed counts, re-ingest without repeats, running what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, format_: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format_).load(path)


def windowed_counts(events: DataFrame, at: str, key: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per key and window; rows later than the watermark are left out."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counts = events.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("began"), key, "n", "total")


def without_repeats(events: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there now and stop; a later run goes on from the checkpoint, so each row is handled once."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
