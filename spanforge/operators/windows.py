"""Order-dependent operators: dedupes, bests, duplicate collapse, span folding."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.session import checkpointed, stored


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order; a null key is a key."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_wins(df, keys, [F.col(c).desc_nulls_last() for c in order])


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n best rows of each key, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def collapse_duplicates(events: DataFrame, keys: Sequence[str], at: str, order: str, rank: str, window: int) -> DataFrame:
    """Reports of one occurrence collapsed: (keys, at, rank, members).

    In order of ``at`` a row joins the current occurrence if it lies within ``window`` of that occurrence's date; a row of
    finer rank then gives the occurrence its date, so the anchor can move. An occurrence's date is never later than its
    last row, so a gap above ``window`` always parts occurrences. Rows are ranged by key and date: each range finds its own
    gaps, the stretch that is open at its end is carried into the next range, and the stretches between gaps are folded
    where they then meet, a row at a time. No key is sorted or held in one task. A row without ``at`` is an occurrence.
    """
    spark = events.sparkSession
    kinds = dict(events.dtypes)
    rows = events.select(*keys, F.col(at).cast("long").alias("_at"), F.col(order).cast("long").alias("_order"), F.col(rank).cast("int").alias("_rank"))
    sort = [*keys, "_at", "_order"]
    checkpointed(spark)
    # the ranges and their order are those that were written
    ranged = rows.filter("_at IS NOT NULL").repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_place", F.spark_partition_id()).checkpoint()
    names = list(keys)

    def stretches(frame: pd.DataFrame, key: tuple | None, last: int, start: int) -> tuple[list[int], tuple, int, int]:
        """Where the stretch of each row starts, and what is open behind the last row."""
        starts = []
        for row in zip(*(frame[k] for k in names), frame["_at"], strict=True):
            own, when = _plain(row[:-1]), int(row[-1])
            if own != key or when - last > window:
                key, start = own, when
            last = when
            starts.append(start)
        return starts, key, last, start

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A range's first and last row, whether a gap lies between, and where the last stretch starts."""
        first = key = place = None
        last = start = 0
        for frame in frames:
            if len(frame):
                if first is None:
                    first, place = (_plain(tuple(frame[k].iat[0] for k in names)), int(frame["_at"].iat[0])), int(frame["_place"].iat[0])
                _, key, last, start = stretches(frame, key, last, start)
        if first is not None:
            yield pd.DataFrame({"place": [place], "first_key": [json.dumps(first[0], default=str)], "first_at": [first[1]], "last_key": [json.dumps(key, default=str)], "last_at": [last], "start": [start]})

    carried, before = {}, None
    for r in sorted(ranged.mapInPandas(ends, "place int, first_key string, first_at long, last_key string, last_at long, start long").collect(), key=lambda r: r.place):  # a row for each range
        joins = before is not None and before[0] == r.first_key and r.first_at - before[1] <= window
        carried[r.place] = before[2] if joins else r.first_at
        whole = r.last_key == r.first_key and r.start == r.first_at  # one stretch from the first row to the last
        before = (r.last_key, r.last_at, carried[r.place] if whole else r.start)

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, start = None, 0, 0
        first = None
        for frame in frames:
            if len(frame):
                own, key, last, start = stretches(frame, key, last, start)
                first = first or (_plain(tuple(frame[k].iat[0] for k in names)), int(frame["_at"].iat[0]), carried[int(frame["_place"].iat[0])])
                # the range's first stretch may have begun in a range before
                begun = [first[2] if s == first[1] and _plain(k) == first[0] else s for s, k in zip(own, zip(*(frame[k] for k in names), strict=True), strict=True)]
                yield frame.drop(columns="_place").assign(_stretch=begun)

    columns = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_at long, _order long, _rank int"])
    parted = ranged.mapInPandas(numbered, f"{columns}, _stretch long").repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "_at", "_order")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done = None, []
        for frame in frames:
            for row in zip(*(frame[k] for k in names), frame["_stretch"], frame["_at"], frame["_order"], frame["_rank"], strict=True):
                key, (when, member, finer) = _plain(row[:-3]), row[-3:]
                if now is not None and now[0] == key and when - now[2] <= window:
                    now = (key, now[1], when if finer < now[3] else now[2], min(finer, now[3]), now[4])
                    now[4].append(member)
                else:
                    done += [now] if now else []
                    now = (key, row[: len(names)], when, finer, [member])
            if len(done) > 10_000:
                yield _occurrences(done, names)
                done = []
        if now:
            yield _occurrences([*done, now], names)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "at long, rank int, members array<long>"])
    undated = rows.filter("_at IS NULL").select(*keys, F.col("_at").alias("at"), F.col("_rank").alias("rank"), F.array("_order").alias("members"))
    return parted.mapInPandas(fold, schema).unionByName(undated)


def _plain(values: tuple) -> tuple:
    """A key that equals itself, missing values included, and reads the same whether taken from a column's place or its iterator."""
    return tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in values)


def _occurrences(done: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = {name: [k[1][n] for k in done] for n, name in enumerate(names)}
    return pd.DataFrame(columns | {"at": [k[2] for k in done], "rank": [k[3] for k in done], "members": [k[4] for k in done]})


def build_spans(events: DataFrame, keys: Sequence[str], at: str, order: str, kind: str, openers: Sequence[str], closers: Sequence[str], members: str | None = None) -> DataFrame:
    """Fold point events into spans: (keys, span_no, start, end, opened, known_through, n_events, last_kind).

    With ``members``, an array column, spans have the sorted members of all their rows under that name, too.

    A closer ends the span it is in, so the span number is the count of closers before a row: one window, one aggregation.
    A span that no opener began has a start inferred from its first evidence; one without a closer has no end.
    """
    rows = W.partitionBy(*keys).orderBy(at, order).rowsBetween(W.unboundedPreceding, -1)
    closes = F.col(kind).isin(*closers)
    numbered = events.withColumn("span_no", F.coalesce(F.sum(closes.cast("long")).over(rows), F.lit(0)))
    place = F.struct(at, order)
    gathered = [F.array_sort(F.flatten(F.collect_list(members))).alias(members)] if members else []
    return numbered.groupBy(*keys, "span_no").agg(
        F.min(at).alias("start"),
        F.max(F.when(closes, F.col(at))).alias("end"),
        F.min_by(kind, place).isin(*openers).alias("opened"),
        F.max(at).alias("known_through"),
        F.count("*").alias("n_events"),
        F.max_by(kind, place).alias("last_kind"),
        *gathered,
    )


def end_status(end: Column, known_through: Column, as_of: Column, days: int = 3 * 365) -> Column:
    """ended, ongoing while the evidence is recent, else unknown."""
    return F.when(end.isNotNull(), "ended").when(F.datediff(as_of, known_through) <= days, "ongoing").otherwise("unknown")


def handoff_or_contested(spans: DataFrame, entity: str, holder: str, start: str, end: str, order: str) -> DataFrame:
    """(entity, holder, n_holders, contested): the one holder, else the last to start unless any span runs past the next one's start."""
    following = F.lead(start).over(W.partitionBy(entity).orderBy(start, order))
    marked = spans.withColumn("_past", F.coalesce(F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")) > following, F.lit(False)))
    grouped = marked.groupBy(entity).agg(F.count_distinct(holder).alias("n_holders"), F.max("_past").alias("_past"), F.max_by(holder, F.struct(start, order)).alias("_last"))
    contested = (F.col("n_holders") > 1) & F.col("_past")
    return grouped.select(entity, F.when(~contested, F.col("_last")).alias("holder"), "n_holders", contested.alias("contested"))


#: Places that one task folds in order; larger parts are decided in rounds.
FOLD_ROWS = 20_000
EARTH_KM = 6371.0


def _km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)))


def _cells(places: DataFrame, km: float) -> DataFrame:
    """Add ``_row`` and ``_col`` of cells in which two places are always nearer than ``km``; rows of cells have their own number of columns."""
    step = km / 111.2 * 0.7  # degrees of latitude; a degree is 111.19 km at the most, so diagonals stay below km
    row = F.floor((F.col("_lat") + 90) / step).cast("long")
    return places.withColumn("_row", row).withColumn("_col", F.pmod(F.floor((F.col("_lng") + 180) / 360 * _columns(row, step)).cast("long"), _columns(row, step)))


def _columns(row: Column, step: float) -> Column:
    """How many columns a row of cells has: its widest circle of latitude in steps."""
    nearest = F.least(F.abs(row * step - 90), F.abs((row + 1) * step - 90))
    wide = F.when((row * step - 90) * ((row + 1) * step - 90) <= 0, 1.0).otherwise(F.cos(F.radians(F.least(nearest, F.lit(90.0)))))
    return F.greatest(F.ceil(360 * wide / step), F.lit(1)).cast("long")


def _around(places: DataFrame, km: float) -> DataFrame:
    """A row for each cell that may hold a place nearer than ``km``, as ``_row`` and ``_col``."""
    step = km / 111.2 * 0.7
    # the angle in longitude that km may span, from the place's own latitude
    angle = km / EARTH_KM
    near_pole = F.abs(F.radians("_lat")) + angle >= 1.5707
    spread = F.when(near_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians("_lat"))))) + 1e-6)
    reach = F.lit(km / 111.19 + 1e-6)
    low, high = F.floor((F.col("_lat") - reach + 90) / step), F.floor((F.col("_lat") + reach + 90) / step)
    rows = places.withColumn("_spread", spread).withColumn("_r", F.explode(F.sequence(low.cast("long"), high.cast("long")))).withColumn("_n", _columns(F.col("_r"), step))
    first, last = (F.floor((F.col("_lng") + sign * F.col("_spread") + 180) / 360 * F.col("_n")).cast("long") for sign in (-1, 1))
    columns = F.when(last - first + 1 >= F.col("_n"), F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.col("_n"))))
    return rows.withColumn("_c", F.explode(columns)).drop("_row", "_col", "_spread", "_n").withColumnRenamed("_r", "_row").withColumnRenamed("_c", "_col")


def _round(open_: DataFrame, km: float) -> DataFrame:
    """The undecided places that no earlier undecided place is near: the first of each cell, unless a place around it is earlier.

    Cells are so small that only the first of one can be kept, so a place meets one row for each cell around it.
    """
    first = open_.groupBy("_key", "_row", "_col").agg(F.min(F.struct("_order", "_id", "_lat", "_lng")).alias("_f")).select("_key", F.col("_f._order").alias("_order"), F.col("_f._id").alias("_id"), F.col("_f._lat").alias("_lat"), F.col("_f._lng").alias("_lng"))
    asked = _around(first, km).select("_key", "_row", "_col", *(F.col(c).alias(f"_f{c}") for c in ("_order", "_id", "_lat", "_lng")))
    earlier = open_.join(asked, ["_key", "_row", "_col"]).filter((F.struct("_order", "_id") < F.struct(F.col("_f_order").alias("_order"), F.col("_f_id").alias("_id"))) & (_km(F.col("_lat"), F.col("_lng"), F.col("_f_lat"), F.col("_f_lng")) < km))
    blocked = earlier.select("_key", F.col("_f_id").alias("_id")).distinct()
    return first.join(blocked, ["_key", "_id"], "left_anti")


def _near(places: DataFrame, kept: DataFrame, km: float) -> DataFrame:
    """(_key, _id, _k): places with the first kept one before them that is near; kept places lie at least ``km`` apart, so a cell holds one."""
    there = _around(kept, km).select("_key", "_row", "_col", *(F.col(c).alias(f"_k{c}") for c in ("_order", "_id", "_lat", "_lng")))
    met = places.join(there, ["_key", "_row", "_col"]).filter((F.struct("_order", "_id") > F.struct(F.col("_k_order").alias("_order"), F.col("_k_id").alias("_id"))) & (_km(F.col("_lat"), F.col("_lng"), F.col("_k_lat"), F.col("_k_lng")) < km))
    return met.groupBy("_key", "_id").agg(F.min(F.struct("_k_order", "_k_id")).alias("_k"))


def greedy_proximity(places: DataFrame, key: str, place_id: str, lat: str, lng: str, order: str, km: float, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(key, place_id, kept_id): places of a key in order; each goes to the first kept one nearer than ``km``, else is kept.

    Not transitive, so order decides; equal orders go by id, which names a place. Places without coordinates are kept. A
    key's places are parted wherever a stretch of latitude or longitude wider than ``km`` is empty; parts of up to
    ``fold_rows`` places are folded in order. Larger ones go by rounds: a place is kept when no earlier undecided place is
    near, and what is near it is then decided as well. What is left is parted anew after each round.
    """
    kind = dict(places.dtypes)
    # a null key is a key, and joins have to find it
    named = F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    placed = places.select(named.alias("_key"), F.col(place_id).alias("_id"), F.col(lat).cast("double").alias("_lat"), F.col(lng).cast("double").alias("_lng"), F.col(order).alias("_order"))
    nowhere = F.col("_lat").isNull() | F.col("_lng").isNull() | F.isnan("_lat") | F.isnan("_lng")
    placed = placed.withColumn("_none", nowhere)
    open_ = stored(_cells(placed.filter("NOT _none").drop("_none"), km), "places")
    every, kept = open_, []
    while True:
        parted = stored(_sized_parts(open_, km), "parts")
        small = parted.filter(F.col("_size") <= fold_rows)
        kept.append(stored(small.groupBy("_key", "_part").applyInPandas(_folded(km), f"_key string, _id {kind[place_id]}, _lat double, _lng double, _order {kind[order]}"), "kept"))
        open_ = parted.filter(F.col("_size") > fold_rows).select(*every.columns)
        if open_.isEmpty():
            break
        found = stored(_round(open_, km), "kept")
        kept.append(found.select("_key", "_id", "_lat", "_lng", "_order"))
        decided = _near(open_, found, km).select("_key", "_id").unionByName(found.select("_key", "_id"))
        open_ = stored(open_.join(decided, ["_key", "_id"], "left_anti"), "places")
    chosen = kept[0].select("_key", "_id", "_lat", "_lng", "_order")
    for more in kept[1:]:
        chosen = chosen.unionByName(more)
    chosen = stored(chosen, "kept") if len(kept) > 1 else chosen
    lost = _near(every.join(chosen.select("_key", "_id"), ["_key", "_id"], "left_anti"), chosen, km)
    answered = lost.select("_key", "_id", F.col("_k._k_id").alias("_kept")).unionByName(chosen.select("_key", "_id", F.col("_id").alias("_kept"))).unionByName(placed.filter("_none").select("_key", "_id", F.col("_id").alias("_kept")))
    return answered.select(F.when(F.col("_key") != "-", F.substring("_key", 2, 1 << 30)).cast(kind[key]).alias(key), F.col("_id").alias(place_id), F.col("_kept").alias("kept_id"))


def _sized_parts(open_: DataFrame, km: float) -> DataFrame:
    """Add ``_part``, what empty stretches divide, and its ``_size``.

    Gaps are sought among occupied rows of cells, then among the occupied columns of a stretch of rows, so only cells, not
    places, are sorted by key.
    """
    step = km / 111.2 * 0.7
    rows = open_.select("_key", "_row").distinct()
    along = W.partitionBy("_key").orderBy("_row")
    # two rows of cells without a place between them are more than km apart
    wide = int(-(-(km / 111.19 + 1e-6) // step)) + 1
    bands = rows.withColumn("_gap", F.coalesce(F.col("_row") - F.lag("_row").over(along) > wide, F.lit(True)).cast("long"))
    bands = bands.select("_key", "_row", F.sum("_gap").over(along).alias("_band"))
    cells = open_.groupBy("_key", "_row", "_col").agg(F.count("*").alias("_n"), F.min(F.pmod(F.col("_lng") + 180, F.lit(360.0))).alias("_west"), F.max(F.pmod(F.col("_lng") + 180, F.lit(360.0))).alias("_east"), F.max(F.abs("_lat")).alias("_polar")).join(bands, ["_key", "_row"])
    band = W.partitionBy("_key", "_band")
    east = band.orderBy("_west", "_row")
    angle = F.when(F.max("_polar").over(band) > 89, 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(km / EARTH_KM)) / F.cos(F.radians(F.max("_polar").over(band)))))) + 1e-6)
    reached = F.max("_east").over(east.rowsBetween(W.unboundedPreceding, -1))
    # the ends of the scale meet, so a band that reaches nearly round is one part
    round_ = F.max("_east").over(band) - F.min("_west").over(band) > 360 - 2 * angle
    cells = cells.withColumn("_gap", F.when(round_, False).otherwise(F.coalesce(F.col("_west") - reached > angle, F.lit(False))).cast("long"))
    cells = cells.withColumn("_part", F.struct("_band", F.sum("_gap").over(east.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_stretch")))
    cells = cells.withColumn("_size", F.sum("_n").over(W.partitionBy("_key", "_part")))
    return open_.join(cells.select("_key", "_row", "_col", "_part", "_size"), ["_key", "_row", "_col"])


def _folded(km: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The places that a fold of a part in order keeps."""
    import numpy as np

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_order", "_id"], kind="stable", na_position="first")
        spots = np.radians(frame[["_lat", "_lng"]].to_numpy(float))
        kept = np.empty_like(spots)
        places: list[int] = []
        for k, spot in enumerate(spots):
            a = kept[: len(places)]
            h = np.sin((spot[0] - a[:, 0]) / 2) ** 2 + np.cos(a[:, 0]) * np.cos(spot[0]) * np.sin((spot[1] - a[:, 1]) / 2) ** 2
            if not (2 * EARTH_KM * np.arcsin(np.sqrt(h)) < km).any():
                kept[len(places)] = spot
                places.append(k)
        return frame.iloc[places][["_key", "_id", "_lat", "_lng", "_order"]]

    return fold


def fill_forward(df: DataFrame, keys: Sequence[str], order: str, value: str, reset: Column | None = None) -> DataFrame:
    """Nulls take the last value before them, but none from before the last row at which ``reset`` holds; such a row keeps its own."""
    along = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v"))), ignorenulls=True).over(along)
    if reset is None:
        return df.withColumn(value, last["v"])
    cut = F.last(F.when(F.coalesce(reset, F.lit(False)), F.col(order)), ignorenulls=True).over(along)
    # one sort serves both windows
    return df.withColumn("_last", last).withColumn("_cut", cut).withColumn(value, F.when(F.col("_cut").isNull() | (F.col("_last.at") >= F.col("_cut")), F.col("_last.v"))).drop("_last", "_cut")


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str = "place") -> DataFrame:
    """Add each row's place within its key, from 0, in the order of ``order`` (no two rows of a key equal).

    Rows are dealt by ranges of (key, order) and numbered within their range; a key's ranges start where the ones before
    end, so a key that holds most rows is not sorted in one task.
    """
    ranged = stored(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    sums = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), start.alias("_start"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    own = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order)) - 1
    return ranged.withColumn("_own", own).join(sums, same).withColumn(name, F.col("_own") + F.col("_start")).select(*df.columns, name)


def with_next(df: DataFrame, keys: Sequence[str], order: str, name: str = "next") -> DataFrame:
    """Pair each boundary with the next one."""
    return df.withColumn(name, F.lead(order).over(W.partitionBy(*keys).orderBy(order)))
