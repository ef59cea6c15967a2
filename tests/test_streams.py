"""Streams: late rows, resumed lookups, sinks that a repeated batch does not change."""

import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanforge.operators import windows
from spanforge.session import importable
from spanforge.sources import lookups
from spanforge.streaming import events as streams
from spanforge.streaming import stateful

FIELDS = "v string"


@pytest.fixture
def wanted(spark, tmp_path):
    importable(spark)
    for k in range(5):
        spark.createDataFrame([(n,) for n in range(10 * k, 10 * k + 12)], "k long").coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    return spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def lookup_into(folder):
    os.makedirs(folder, exist_ok=True)

    def look(k):
        with open(f"{folder}/asked", "a") as log:
            log.write(f"{k}\n")
        if k % 7 == 0:
            return None
        if k % 11 == 0 and not os.path.exists(f"{folder}/mended"):
            raise RuntimeError
        if k == 34 and not os.path.exists(f"{folder}/again"):
            open(f"{folder}/again", "w").close()
            os._exit(1)  # the worker is gone in the middle of a batch
        return {"v": f"v{k}"}

    return look


def asked(folder):
    with open(f"{folder}/asked") as log:
        return [int(x) for x in log]


def test_a_stop_between_writing_and_committing_loses_nothing(spark, wanted, tmp_path):
    look, calls = lookup_into(f"{tmp_path}/log"), []

    def stop(batch):
        calls.append(batch)
        if batch == 2 and calls.count(2) == 1:
            raise RuntimeError("stopped after writing")

    run = lambda: lookups.enriched_in_batches(wanted, "k", look, FIELDS, f"{tmp_path}/out", f"{tmp_path}/state", stop)
    open(f"{tmp_path}/log/again", "w").close()
    with pytest.raises(Exception, match="stopped after writing"):
        run()
    before = asked(f"{tmp_path}/log")
    assert calls == [0, 1, 2] and sorted(before) == list(range(32))
    assert lookups.answers(spark, f"{tmp_path}/out", "k", "bigint", FIELDS).count() == 32
    got = {r.k: (r.state, r.v) for r in run().collect()}
    assert got == {k: ("not found", None) if k % 7 == 0 else ("failed", None) if k % 11 == 0 else ("found", f"v{k}") for k in range(52)}
    again = sorted(set(asked(f"{tmp_path}/log")[len(before):]) & set(range(32)))
    assert again == [k for k in range(32) if k % 11 == 0 and k % 7]  # failures alone
    open(f"{tmp_path}/log/mended", "w").close()
    before = len(asked(f"{tmp_path}/log"))
    got = {r.k: r.state for r in run().collect()}
    assert sorted(asked(f"{tmp_path}/log")[before:]) == [k for k in range(52) if k % 11 == 0 and k % 7] and "failed" not in got.values()


def test_a_stop_while_asking_loses_one_batch(spark, wanted, tmp_path):
    look = lookup_into(f"{tmp_path}/log")
    run = lambda: lookups.enriched_in_batches(wanted, "k", look, FIELDS, f"{tmp_path}/out", f"{tmp_path}/state")
    with pytest.raises(Exception):  # noqa: B017
        run()
    assert {r.k for r in lookups.answers(spark, f"{tmp_path}/out", "k", "bigint", FIELDS).collect()} == set(range(32))
    assert len(run().collect()) == 52
    counts = {k: asked(f"{tmp_path}/log").count(k) for k in range(52)}
    assert all(n == 1 for k, n in counts.items() if (k < 32 or k >= 42) and (k % 11 or k % 7 == 0))


def test_repeated_batches_do_not_repeat_rows(spark, tmp_path):
    sink = stateful.batch_sink(f"{tmp_path}/out")
    sink(spark.range(3), 0)
    sink(spark.range(3), 0)
    sink(spark.range(5), 1)
    os.remove(f"{tmp_path}/out/batch=1/_SUCCESS")  # as if it had stopped while writing
    sink(spark.range(4), 1)
    rows = stateful.versions(spark, f"{tmp_path}/out", "id long")
    assert sorted(map(tuple, rows.collect())) == sorted([(k, 0) for k in range(3)] + [(k, 1) for k in range(4)])
    assert sorted(r.id for r in stateful.latest(rows, ["id"]).collect()) == [0, 1, 2, 3]


def late_rows(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "i long, u long, t long, kind string, p long").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    df = df.withColumn("day", F.unix_date(F.to_date("ts")).cast("long")).withColumn("us", F.unix_micros("ts"))
    for k in range(6):
        df.filter(f"floor(i / 30) = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/f{k}")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


@pytest.fixture
def stream(spark, tmp_path):
    importable(spark)
    stateful.stateful_session(spark)
    rng = random.Random(11)
    rows = [(k, rng.randrange(3), 5 * 3600 * k + rng.randint(-300_000, 300_000), rng.choice(["won", "presence", "presence", "lost"]), rng.randrange(3)) for k in range(180)]
    return late_rows(spark, tmp_path, rows)


def test_late_rows_reopen_spans(spark, stream, tmp_path):
    df, arriving = stream
    fold = stateful.Spans(("won",), ("lost",), 3)
    out = stateful.refolded(arriving, "ts", ["u"], fold, ["day", "i", "kind"], "8 days")
    streams.run_available(out, f"{tmp_path}/state", stateful.batch_sink(f"{tmp_path}/out"), "update")
    every = stateful.versions(spark, f"{tmp_path}/out", f"u long, {fold.record}")
    got = {(r.u, r.no): (r.start, r.end, r.opened, r.known_through, r.n_events, r.last_kind) for r in stateful.latest(every, ["u", "no"]).collect()}
    batch = windows.build_spans(df, ["u"], "day", "i", "kind", ["won"], ["lost"])
    assert got == {(r.u, r.span_no): (r.start, r.end, r.opened, r.known_through, r.n_events, r.last_kind) for r in batch.collect()}
    ended = every.filter("status = 'ended'").groupBy("u", "no").agg(F.count_distinct("end", "n_events").alias("n"))
    assert ended.filter("n > 1").count() > 0  # some were given out as ended and changed


def test_late_rows_move_occurrences(spark, stream, tmp_path):
    df, arriving = stream
    fold = stateful.Occurrences(20 * 3600 * 1_000_000)
    out = stateful.refolded(arriving, "ts", ["u", "kind"], fold, ["us", "i", "p"], "8 days")
    streams.run_available(out, f"{tmp_path}/state", stateful.batch_sink(f"{tmp_path}/out"), "update")
    done = stateful.latest(stateful.versions(spark, f"{tmp_path}/out", f"u long, kind string, {fold.record}"), ["u", "kind", "no"])
    batch = windows.collapse_duplicates(df, ["u", "kind"], "us", "i", "p", 20 * 3600 * 1_000_000)
    as_set = lambda rows: {(r.u, r.kind, r["at"], r["rank"], tuple(r.members)) for r in rows.collect()}
    assert as_set(done) == as_set(batch) and done.count() == batch.count()


def test_late_rows_merge_occurrences(spark, tmp_path):
    importable(spark)
    stateful.stateful_session(spark)
    hour = 3600
    # the late row is finer and takes the later two along, so three occurrences and two become one; of 3 nothing changes
    rows = [(0, 1, 0, "won", 1), (1, 1, 8 * hour, "won", 1), (2, 1, 9 * hour, "won", 1), (3, 2, 0, "won", 2), (4, 2, 7 * hour, "won", 2), (5, 2, 14 * hour, "won", 2), (6, 3, 0, "won", 1), (7, 3, 9 * hour, "won", 1)]
    rows += [(30, 1, 5 * hour, "won", 0), (31, 2, 6 * hour, "won", 1), (61, 2, 11 * hour, "won", 0)]
    df, arriving = late_rows(spark, tmp_path, rows)
    fold = stateful.Occurrences(6 * hour * 1_000_000)
    out = stateful.refolded(arriving, "ts", ["u"], fold, ["us", "i", "p"], "8 days")
    streams.run_available(out, f"{tmp_path}/state", stateful.batch_sink(f"{tmp_path}/out"), "update")
    done = stateful.latest(stateful.versions(spark, f"{tmp_path}/out", f"u long, {fold.record}"), ["u", "no"])
    batch = windows.collapse_duplicates(df, ["u"], "us", "i", "p", 6 * hour * 1_000_000)
    as_list = lambda rows: sorted((r.u, r["at"], r["rank"], tuple(r.members)) for r in rows.collect())
    assert as_list(done) == as_list(batch)
    assert sorted((r.u, len(r.members)) for r in done.collect()) == [(1, 4), (2, 5), (3, 1), (3, 1)]


def test_silence_makes_an_end_unknown(spark, tmp_path):
    importable(spark)
    stateful.stateful_session(spark)
    day = 86_400
    rows = [(0, 1, 0, "won", 0), (1, 2, 0, "won", 0), (31, 2, 9 * day, "presence", 0), (61, 3, 12 * day, "won", 0), (91, 1, 11 * day + day // 2, "presence", 0)]
    _, arriving = late_rows(spark, tmp_path, rows)
    fold = stateful.Spans(("won",), ("lost",), 4)
    out = stateful.refolded(arriving, "ts", ["u"], fold, ["day", "i", "kind"], "1 day")
    streams.run_available(out, f"{tmp_path}/state", stateful.batch_sink(f"{tmp_path}/out"), "update")
    every = stateful.versions(spark, f"{tmp_path}/out", f"u long, {fold.record}")
    # 1 was unknown and came back; 2 is unknown no more than two days after its last sign
    assert {(r.u, r.status, r.n_events) for r in stateful.latest(every, ["u", "no"]).collect()} == {(1, "ongoing", 2), (2, "ongoing", 2), (3, "ongoing", 1)}
    assert every.filter("u = 1 AND status = 'unknown'").count() > 0


class Calls:
    """Stands for the handle and a value of Spark's state, and notes what is asked of them."""

    def __init__(self):
        self.now, self.made = None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0

    def get(self):
        self.made.append("get")
        return self.now

    def update(self, value):
        self.made.append("update")
        self.now = value

    def registerTimer(self, at):  # noqa: N802
        self.made.append("register")

    def deleteTimer(self, at):  # noqa: N802
        self.made.append("delete")


def test_a_key_is_read_and_written_once_for_a_batch():
    row = Row("at", "ord", "rank")
    for fold, batches, timers in (
        (stateful.Occurrences(10), [[row(1, 1, 0), row(5, 2, 1)], [row(3, 3, 2)]], []),
        (stateful.Spans(("won",), ("lost",), 3), [[row(1, 1, "won")], [row(1, 3, "presence")], [row(2, 4, "lost")]], ["register", "delete"]),
    ):
        calls = Calls()
        state = stateful.Refold(fold, ["at", "ord", "rank"], ["key", *(part.split()[0] for part in fold.record.split(", "))])
        state.init(calls)
        for batch in batches:
            list(state.handleInputRows(("k",), iter(batch), calls))
        made = calls.made
        assert made.count("get") == made.count("update") == len(batches)
        assert [m for m in made if m not in ("get", "update")] == timers


def test_a_batch_gives_out_what_it_changed_and_no_more():
    row = Row("at", "ord", "kind")
    fold, calls = stateful.Spans(("won",), ("lost",), 3), Calls()
    state = stateful.Refold(fold, ["at", "ord", "kind"], ["key", *(part.split()[0] for part in fold.record.split(", "))])
    state.init(calls)
    given = [[(r.no, r.n_events, r.status) for r in state.handleInputRows(("k",), iter(batch), calls)] for batch in (
        [row(1, 1, "won"), row(2, 2, "lost"), row(4, 3, "won"), row(5, 4, "lost")],
        [row(7, 5, "won")],
        [row(3, 6, "presence"), row(8, 7, "lost")],
    )]
    # the last batch's late row joins the second span; the first one stays as it went out
    assert given == [[(0, 2, "ended"), (1, 2, "ended")], [(2, 1, "ongoing")], [(1, 3, "ended"), (2, 2, "ended")]]
