"""Order-dependent folds as typed state that take late rows, and sinks that a repeated batch does not change.

A key's state is what the rows before the watermark have been folded to, and the rows since then as they are. A batch's rows,
late ones among them, are put in order with those, and everything after the watermark is folded again: a late row can
extend, split, merge or re-open what had been given out. Each batch gives out the records that it changed; of a record's
versions the last batch's counts, so at any time the output is what the batch fold of all rows gives. Where late rows leave
fewer records, those that are no more go out with their number alone, and ``latest`` leaves them out. Rows later than the
watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanforge.session import path_exists

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What a state is folded by. Rows are tuples (at, order, *values); an accumulator is a tuple, None at the start of a key."""

    #: DDL of a row, of the accumulator and of a record (its number ``no`` first).
    row: str
    accumulator: str
    record: str

    def step(self, now: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        """The accumulator after a row, and the record that the row finished."""
        raise NotImplementedError

    def open(self, now: tuple) -> tuple | None:
        """The record that is not finished yet."""
        raise NotImplementedError

    def horizon(self, watermark_ms: int) -> int:
        """Rows with a lesser ``at`` cannot be joined by others any more."""
        raise NotImplementedError

    def expires(self, now: tuple) -> int | None:
        """The event time in ms after which silence changes the open record."""
        return None

    def expired(self, record: tuple) -> tuple:
        return record


class Refold(StatefulProcessor):
    """One value a key: what is settled, the rows since then, and the timer that is set.

    Every call of the state costs a round trip, so a key is read once and written once for a batch, and timers are touched
    only where they change.
    """

    def __init__(self, fold: Fold, columns: list[str], names: list[str]):
        self.fold, self.columns, self.out = fold, columns, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"base struct<{self.fold.accumulator}>, recent array<struct<{self.fold.row}>>, timer long")

    def _held(self) -> tuple[tuple | None, list[tuple], int | None]:
        base, recent, timer = self.held.get() or (None, [], None)
        return tuple(base) if base is not None else None, list(map(tuple, recent)), timer

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        watermark = timerValues.getCurrentWatermarkInMs()
        horizon = self.fold.horizon(watermark)
        base, known, timer = self._held()
        rows_now = sorted([*known, *(tuple(r[c] for c in self.columns) for r in rows)], key=lambda r: r[:2])
        given, before = {}, base  # what the rows so far had finished went out in an earlier batch
        for row in known:
            before, done = self.fold.step(before, row)
            if done:
                given[done[0]] = done
        last = self.fold.open(before) if before is not None else None
        gone = {*given, *([last[0]] if last else [])}
        now = base
        out, settled = [], 0
        for k, row in enumerate(rows_now):
            now, done = self.fold.step(now, row)
            if done:
                gone.discard(done[0])
                if given.get(done[0]) != done:
                    out.append(done)
            if row[0] < horizon:
                base, settled = now, k + 1
        still, wanted = self.fold.open(now) if now is not None else None, None
        if still:
            gone.discard(still[0])
            expiry = self.fold.expires(now)
            if expiry is not None and expiry <= watermark:
                still = self.fold.expired(still)
            else:
                wanted = expiry
            out.append(still)
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.held.update((base, rows_now[settled:], wanted))
        for record in out:
            yield self.out(*key, *record)
        for no in sorted(gone):
            yield self.out(*key, no, *[None] * (len(self.out) - len(key) - 1))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        base, recent, _ = self._held()
        now = base
        for row in recent:
            now, _ = self.fold.step(now, row)
        self.held.update((base, recent, None))
        still = self.fold.open(now) if now is not None else None
        if still:
            yield self.out(*key, *self.fold.expired(still))

    def close(self) -> None:
        pass


class Spans(Fold):
    """``windows.build_spans`` as state: rows (day, order, kind), records (no, start, end, opened, known_through, n_events, last_kind, status)."""

    row = "at long, ord long, kind string"
    accumulator = "no long, start long, opened boolean, known long, n long, kind string"
    record = "no long, start long, end long, opened boolean, known_through long, n_events long, last_kind string, status string"

    def __init__(self, openers: tuple[str, ...], closers: tuple[str, ...], idle_days: int):
        self.openers, self.closers, self.idle = frozenset(openers), frozenset(closers), idle_days

    def step(self, now: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        day, _, kind = row
        no, start, opened, _, n, _ = now or (0, None, None, None, 0, None)
        grown = (no, day if n == 0 else start, kind in self.openers if n == 0 else opened, day, n + 1, kind)
        if kind in self.closers:
            return (no + 1, None, None, None, 0, None), self._record(grown, day, "ended")
        return grown, None

    def _record(self, now: tuple, end: int | None, status: str) -> tuple:
        no, start, opened, known, n, kind = now
        return no, start, end, opened, known, n, kind, status

    def open(self, now: tuple) -> tuple | None:
        return self._record(now, None, "ongoing") if now[4] else None

    def horizon(self, watermark_ms: int) -> int:
        return watermark_ms // 86_400_000

    def expires(self, now: tuple) -> int | None:
        return (now[3] + self.idle) * 86_400_000

    def expired(self, record: tuple) -> tuple:
        return *record[:-1], "unknown"


class Occurrences(Fold):
    """``windows.collapse_duplicates`` as state: rows (at in microseconds, order, rank), records (no, at, rank, members)."""

    row = "at long, ord long, rank long"
    accumulator = "no long, at long, rank long, members array<long>"
    record = "no long, at long, rank long, members array<long>"

    def __init__(self, window_us: int):
        self.window = window_us

    def step(self, now: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        at, order, rank = row
        if now is None:
            return (0, at, rank, [order]), None
        no, anchor, finest, members = now
        if abs(at - anchor) > self.window:
            return (no + 1, at, rank, [order]), now
        return (no, at if rank < finest else anchor, min(rank, finest), [*members, order]), None

    def open(self, now: tuple) -> tuple | None:
        return now

    def horizon(self, watermark_ms: int) -> int:
        return watermark_ms * 1000


def refolded(events: DataFrame, at: str, keys: list[str], fold: Fold, columns: list[str], late: str) -> DataFrame:
    """A stream of record versions: keys, then the fold's record. ``columns`` are the events' columns in the order of its rows.

    Needs the RocksDB state store (``stateful_session``).
    """
    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), fold.record])
    names = [part.strip().split()[0] for part in schema.split(", ")]
    # only what the fold reads goes through the shuffle and to Python
    watched = events.select(*dict.fromkeys([*keys, at, *columns])).withWatermark(at, late)
    return watched.groupBy(*keys).transformWithState(Refold(fold, columns, names), schema, "Update", "EventTime")


def stateful_session(spark: SparkSession) -> None:
    """The state store that typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def batch_sink(path: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes batch N to ``path/batch=N``.

    A batch whose folder is complete is not written again, an incomplete one is written anew: a run that stops between
    writing and committing repeats its last batch without repeating a row.
    """

    def write(df: DataFrame, batch: int) -> None:
        target = f"{path}/batch={batch}"
        if not path_exists(df.sparkSession, f"{target}/_SUCCESS"):
            df.write.mode("overwrite").parquet(target)
        if after:
            after(batch)

    return write


def versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a batch sink with their ``batch``."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch, unless that row has nothing but its key: then it is no more."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    last = rows.withColumn("_rn", place).filter("_rn = 1").drop("_rn", "batch")
    values = [c for c in last.columns if c not in keys]
    return last.dropna("all", subset=values) if values else last

