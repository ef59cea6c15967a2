"""Sources that answer requests: chunked remote queries, cached and resumable lookups, recorded extractions.

Nothing here opens a connection: a caller gives the function that fetches. It runs in tasks, chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.hashing import payload_hash
from spanforge.operators.windows import first_wins, last_wins
from spanforge.session import path_exists
from spanforge.streaming.events import run_available
from spanforge.streaming.stateful import batch_sink, versions

Fetch = Callable[[list], list[dict]]


def chunked(spark: SparkSession, values: DataFrame, column: str, size: int, fetch: Fetch, schema: str) -> DataFrame:
    """Rows that ``fetch`` gives for the values, asked ``size`` at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = frame[column].tolist()
            for k in range(0, len(asked), size):
                rows = fetch(asked[k : k + size])
                if rows:
                    yield pd.DataFrame(rows)

    return values.select(column).distinct().mapInPandas(run, schema)


def partitioned(spark: SparkSession, boxes: Sequence[tuple], mirrors: Sequence[Callable[[tuple], list[dict]]], schema: str, keys: Sequence[str]) -> DataFrame:
    """One task for each box; the first mirror that answers is used; rows seen in several boxes stay once, the last box's."""
    tasks = spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(boxes)], "box int, south double, west double, north double, east double").repartition(len(boxes))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for box in frame.itertuples(index=False):
                error: Exception | None = None
                for mirror in mirrors:
                    try:
                        rows = mirror(tuple(box)[1:])
                    except Exception as e:  # noqa: BLE001  the next mirror may answer
                        error = e
                        continue
                    if rows:
                        yield pd.DataFrame(rows).assign(box=box.box)
                    break
                else:
                    raise RuntimeError("no mirror answered") from error

    return last_wins(tasks.mapInPandas(run, f"{schema}, box int"), keys, ["box"]).drop("box")


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no answer yet."""
    return wanted.join(done.select(key), key, "left_anti")


ORDER = ("found", "not found", "failed")


def _asked(keys: DataFrame, key: str, lookup: Callable[[object], dict | None], fields: str) -> DataFrame:
    """One lookup for each key; ``state`` tells found, not found and failed."""
    names = [f.split()[0] for f in fields.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for value in frame[key]:
                try:
                    answer = lookup(value) or {}
                    rows.append((value, "found" if answer else "not found", *map(answer.get, names)))
                except Exception:  # noqa: BLE001  a failed lookup is a row
                    rows.append((value, "failed", *[None] * len(names)))
            yield pd.DataFrame(rows, columns=[key, "state", *names], dtype=object)

    return keys.mapInPandas(run, f"{key} {dict(keys.dtypes)[key]}, state string, {fields}")


def _best(answers: DataFrame, key: str) -> DataFrame:
    """One row for each key: found before not found before failed."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("state"))
    return first_wins(answers, [key], [place, *(c for c in answers.columns if c not in (key, "state"))])


def enriched(wanted: DataFrame, done: DataFrame, key: str, lookup: Callable[[object], dict | None], fields: str, path: str | None = None) -> DataFrame:
    """Answers for all wanted keys: those known, and one lookup for each of the rest.

    With a path new answers are appended there, so a later run goes on where this one ended; failures are asked again. A
    run that stops loses its own answers; ``enriched_in_batches`` loses one batch. A key has one row, whatever ``done`` and
    the path both hold.
    """
    names = [f.split()[0] for f in fields.split(",")]
    known = done.filter("state <> 'failed'").select(key, "state", *names)
    fresh = _asked(todo(wanted.select(key).distinct(), known, key), key, lookup, fields)
    if path is not None:
        fresh.write.mode("append").parquet(path)
        fresh = wanted.sparkSession.read.schema(fresh.schema).parquet(path)
    return _best(known.unionByName(fresh), key)


def answers(spark: SparkSession, path: str, key: str, kind: str, fields: str) -> DataFrame:
    """What ``enriched_in_batches`` has found out so far: one row for each key."""
    schema = f"{key} {kind}, state string, {fields}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return _best(versions(spark, path, schema).drop("batch"), key)


def enriched_in_batches(wanted: DataFrame, key: str, lookup: Callable[[object], dict | None], fields: str, path: str, checkpoint: str, after: Callable[[int], None] | None = None) -> DataFrame:
    """Answers for a stream of wanted keys, a batch of the stream at a time.

    Batch N's answers are written to ``path/batch=N`` before the stream commits it. A run that stops in between finds the
    folder complete and asks nothing again; one that stops while asking asks for that batch again and for no other. Keys
    answered in earlier batches are not asked. Before the stream goes on, earlier failures are asked again, in batches
    numbered below 0. ``after`` is called with each batch that has been written.
    """
    spark, kind = wanted.sparkSession, dict(wanted.dtypes)[key]

    def known() -> DataFrame:
        return answers(spark, path, key, kind, fields)

    def write(df: DataFrame, batch: int) -> None:
        fresh = todo(df.select(key).filter(F.col(key).isNotNull()).distinct(), known(), key)
        batch_sink(path, after)(_asked(fresh, key, lookup, fields), batch)

    failed = known().filter("state = 'failed'").select(key)
    if not failed.isEmpty():
        turn = -1
        while path_exists(spark, f"{path}/batch={turn}/_SUCCESS"):
            turn -= 1
        batch_sink(path)(_asked(failed, key, lookup, fields), turn)
    run_available(wanted.select(key), checkpoint, write)
    return known()


def cached(requests: DataFrame, columns: Sequence[str], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, open): requests with an answer in a cache keyed by payload hash, and those to send."""
    hashed = requests.withColumn("payload", payload_hash(columns))
    return hashed.join(cache, "payload"), hashed.join(cache.select("payload"), "payload", "left_anti")


def checked_extraction(articles: DataFrame, offered: DataFrame, answers: DataFrame) -> DataFrame:
    """Recorded extractions with what had to be repaired: an id that was not offered is nulled, source fields are restored.

    articles: (article_id, title); offered: (article_id, venue_ids); answers: (article_id, venue_id, title, operator).
    """
    joined = answers.withColumnRenamed("title", "said_title").join(articles, "article_id").join(offered, "article_id", "left")
    off_list = F.col("venue_id").isNotNull() & ~F.coalesce(F.array_contains("venue_ids", F.col("venue_id")), F.lit(False))
    changed = ~F.col("said_title").eqNullSafe(F.col("title"))
    repairs = F.array_compact(F.array(F.when(off_list, "venue_id not offered"), F.when(changed, "title restored")))
    return joined.select("article_id", F.when(~off_list, F.col("venue_id")).alias("venue_id"), "title", "operator", repairs.alias("repairs"))
