"""Suffix ranks of many strings by the distributed difference-cover algorithm (modulo 3).

Each level sorts the triples at the sampled positions (those not divisible by 3), names them by rank, recurses on the
strings of names, and merges the remaining suffixes with the sampled ones by their first symbols and the ranks behind.
Ranks are counts of smaller suffixes, taken from sorted distinct keys: equal keys are aggregated before they are sorted,
so a triple that is everywhere is one row. ``depth`` levels compare 3**depth symbols; suffixes equal so far share a rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, fewer_tasks, release


def counts_before(keys: DataFrame, order: list[str], counts: list[str]) -> DataFrame:
    """For sorted distinct keys: the sums of ``counts`` over all smaller keys, by ranges and then range totals."""
    ranged = checkpoint(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.shiftright(F.monotonically_increasing_id(), 33)))
    sums = ranged.groupBy("place").agg(*(F.sum(c).alias(c) for c in counts))
    totals = sorted(fewer_tasks(sums, 1).collect(), key=lambda r: r.place)  # a row for each partition
    offsets, so_far = {}, [0] * len(counts)
    for row in totals:
        offsets[row.place] = list(so_far)
        so_far = [a + row[c] for a, c in zip(so_far, counts, strict=True)]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for frame in frames:
            if not len(frame):
                continue
            if now is None:
                now = offsets[int(frame["place"].iat[0])]
            sums = frame[counts].cumsum()
            out = frame[order].copy()
            for k, c in enumerate(counts):
                out[f"{c}_before"] = sums[c] - frame[c] + now[k]
            now = [now[k] + int(sums[c].iat[-1]) for k, c in enumerate(counts)]
            yield out

    schema = ", ".join([f"{c} long" for c in order] + [f"{c}_before long" for c in counts])
    return ranged.mapInPandas(add, schema)


def suffix_ranks(strings: DataFrame, depth: int = 3, symbols: int | None = None) -> DataFrame:
    """(sid, ranks array<long>) for (sid long, ts array<long>); symbols are positive, the end sorts before all of them.

    ``symbols`` is how many there are in all strings, counted where it is not given; every step has as many rows at most.
    """
    symbols = symbols if symbols is not None else strings.agg(F.sum(F.size("ts"))).first()[0] or 0
    few = partial(fewer_tasks, rows=symbols)
    at = "coalesce(get(ts, i + {0}), 0L)"
    triples = strings.selectExpr("sid", f"inline(transform(filter(sequence(0, greatest(size(ts) - 1, 0)), i -> i % 3 <> 0 AND i < size(ts)), i -> struct(i AS pos, ts[i] AS t0, {at.format(1)} AS t1, {at.format(2)} AS t2)))")
    distinct = few(triples.groupBy("t0", "t1", "t2").agg(F.count("*").alias("n")))
    names = checkpoint(counts_before(distinct, ["t0", "t1", "t2"], ["n"]))
    named = few(triples.join(names, ["t0", "t1", "t2"])).select("sid", (F.col("pos") % 3).alias("m"), "pos", (F.col("n_before") + 1).alias("name"))
    halves = named.groupBy("sid", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("ts"))
    halves = checkpoint(few(halves))
    del triples, distinct, names, named  # their shuffle files go before the next level writes its own
    release(strings.sparkSession)
    if depth > 1:
        below = suffix_ranks(halves.select(F.xxhash64("sid", "m").alias("sid"), "ts"), depth - 1, symbols).withColumnRenamed("sid", "key")
        halves = few(halves.select("sid", "m", F.xxhash64("sid", "m").alias("key")).join(below, "key")).select("sid", "m", (F.transform("ranks", lambda r: r + 1)).alias("ts"))
    sides = few(halves.groupBy("sid").agg(F.first(F.when(F.col("m") == 1, F.col("ts")), ignorenulls=True).alias("r1"), F.first(F.when(F.col("m") == 2, F.col("ts")), ignorenulls=True).alias("r2")))
    both = few(strings.join(sides, "sid", "left")).withColumn("r1", F.coalesce("r1", F.array().cast("array<long>"))).withColumn("r2", F.coalesce("r2", F.array().cast("array<long>")))
    rank = "coalesce(CASE (i + {0}) % 3 WHEN 1 THEN get(r1, CAST((i + {0}) DIV 3 AS INT)) WHEN 2 THEN get(r2, CAST((i + {0}) DIV 3 AS INT)) END, 0L)"
    all_ = checkpoint(both.selectExpr("sid", f"inline(transform(filter(sequence(0, greatest(size(ts) - 1, 0)), i -> i < size(ts)), i -> struct(i AS pos, i % 3 AS m, ts[i] AS t0, {at.format(1)} AS t1, {rank.format(1)} AS ra, {rank.format(2)} AS rb, {rank.format(0)} AS own)))"))
    del halves, sides, both
    release(strings.sparkSession)
    # the remaining suffixes among themselves and against each half of the sample
    one = few(all_.filter("m <> 2").groupBy("t0", "ra").agg(F.count_if(F.col("m") == 0).alias("n0"), F.count_if(F.col("m") == 1).alias("n1")))
    two = few(all_.filter("m <> 1").groupBy("t0", "t1", "rb").agg(F.count_if(F.col("m") == 0).alias("k0"), F.count_if(F.col("m") == 2).alias("k2")))
    one, two = checkpoint(counts_before(one, ["t0", "ra"], ["n0", "n1"])), checkpoint(counts_before(two, ["t0", "t1", "rb"], ["k0", "k2"]))
    rest = few(few(all_.filter("m = 0").join(one, ["t0", "ra"])).join(two, ["t0", "t1", "rb"])).select("sid", "pos", (F.col("n0_before") + F.col("n1_before") + F.col("k2_before")).alias("rank"))
    first = few(all_.filter("m = 1").join(one, ["t0", "ra"])).select("sid", "pos", "own", F.col("n0_before").alias("less"))
    second = few(all_.filter("m = 2").join(two, ["t0", "t1", "rb"])).select("sid", "pos", "own", F.col("k0_before").alias("less"))
    # a sampled suffix's own rank counts the smaller sampled ones
    sampled = first.unionByName(second).select("sid", "pos", (F.col("own") - 1 + F.col("less")).alias("rank"))
    ranked = rest.unionByName(sampled).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rank"))), lambda x: x["rank"]).alias("ranks"))
    ranked = checkpoint(few(ranked))
    del all_, one, two, rest, first, second, sampled
    release(strings.sparkSession)
    return ranked
