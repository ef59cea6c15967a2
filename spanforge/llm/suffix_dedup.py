"""Removal of byte strings that occur more than once, by a distributed suffix array.

The suffix array is sparse. Texts are cut at content-defined anchors: every start i of a LENGTH-byte string has the anchor
a(i), the place of the least 8-byte hash in the WINDOW places from i on. Equal strings have equal anchors, so anchors play
the part of the difference cover's sampled positions. Only anchors whose next FOLLOWING bytes occur again can belong to a
repeat; they are the candidates, the others are left out exactly.

The symbol at an anchor is its FOLLOWING-byte string, named by its rank in a sort of all distinct ones. FOLLOWING bytes
settle where the next anchor stands, so symbol strings sort as their bytes do, and the difference-cover algorithm
(``difference_cover``) sorts the suffixes of the symbol strings, recursing on names until a name spans LENGTH bytes. The
remaining suffixes, those d bytes before an anchor, are merged in by these d bytes and the rank of the anchor's suffix:
a start repeats if and only if, among the anchors with the same d bytes before them, a neighbour in rank order shares
LENGTH - d bytes. Both are read from the bytes themselves, never from hashes.

Defined results: a null text is empty; matches do not cross documents; a start repeats if its LENGTH bytes start anywhere
else, in the same document, too; every byte of such strings is removed, the first occurrence as well; rows with equal ids
are separate documents; texts that occur more than once are kept as one text with a count; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, drop_path, release, shared_path, stored, stored_at, table
from spanforge.llm.difference_cover import suffix_ranks
from spanforge.llm.hashing import U, by_bytes, mix, prefix_hash, substring_hash

LENGTH, WINDOW, GRAM = 400, 196, 8
#: At least WINDOW + GRAM, so that a symbol settles where the next anchor stands.
FOLLOWING = LENGTH - WINDOW + 1
#: The most bytes that a start stands before its anchor.
BEFORE = WINDOW - 1
#: Anchors with the same symbol that one task compares; of larger groups only the distinct contexts are compared, and
#: more of these than CONTEXTS over many tasks.
GROUP, CONTEXTS = 1_000, 10_000
#: Anchors compared at once, about; a group is not split.
TOGETHER = 4_000
#: Bytes whose anchors and hashes are computed at once, about; places in a slice are packed into 24 bits.
SLICE = 1 << 21


def _places(data: np.ndarray) -> np.ndarray:
    """For each window of ``data`` the place of its least hash, the last of equals, over a slice of windows at a time."""
    n, parts, low_bits = len(data) - GRAM - WINDOW + 2, [], U((1 << 24) - 1)
    for low in range(0, n, SLICE):
        m = min(SLICE, n - low) + WINDOW - 1
        words = np.ndarray((m,), "<u8", data, offset=low, strides=(1,))
        least = (mix(words) & ~low_bits) | (low_bits - np.arange(m, dtype=np.uint64))
        width = 1
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
        parts.append((low_bits - (least & low_bits)).astype(np.int64) + low)
    return np.concatenate(parts)


def _following(data: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Hashes of what follows each of the rising places ``found``, over a slice of data at a time."""
    following, low = np.zeros(len(found), np.uint64), 0
    while low < len(found):
        high = int(np.searchsorted(found, found[low] + SLICE))
        first, own = found[low], slice(low, high)
        sums = prefix_hash(data[first : found[high - 1] + FOLLOWING])
        following[own] = substring_hash(sums, found[own] - first, found[own] - first + FOLLOWING)
        low = high
    return following


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its anchors and the first start of each, one more of both, and hashes of the symbols.

    The last anchor's symbol does not fit into the text; it has no hash. Anchors near the end may have no start.
    """
    data = np.frombuffer(b"".join(texts) + b"\0" * (WINDOW + GRAM), np.uint8)
    place = _places(data)
    sums, at = prefix_hash(data) if len(data) <= SLICE else None, 0
    for text in texts:
        size = len(text)
        if size < LENGTH:
            none = np.zeros(0, np.int64)
            yield none, none, none.view(np.uint64)
        else:
            own = place[at : at + size - WINDOW - GRAM + 2]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            found = own[first]
            full = int(np.searchsorted(found, at + size - FOLLOWING, "right"))
            whole = found[:full]
            following = _following(data, whole) if sums is None else substring_hash(sums, whole, whole + FOLLOWING)
            yield found[: full + 1] - at, first[: full + 1], following
        at += size


def _shortened(data: np.ndarray, at: np.ndarray, first: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's anchors without most of those in its periodic stretches, and how many bytes before each are left out.

    Side by side a period apart, with the same bytes all around them, anchors share one context. The last of them stay, as
    many as LENGTH bytes take, so every string of symbols agrees with the text's for LENGTH bytes; those left out, ``back``
    bytes in all, repeat as the first that stays does.
    """
    n = len(following)
    stays, back = np.ones(len(at), bool), np.zeros(n, np.int64)
    edge = np.diff(np.concatenate([[False], following[1:] == following[:-1], [False]]).astype(np.int8))
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        step = np.diff(at[i : j + 1])
        period = int(step[0])
        needed = (LENGTH - FOLLOWING) // period + 3
        if (j - i + 1 - needed) * period <= WINDOW or (step != period).any():
            continue
        low, high = at[i:j] - BEFORE, at[i:j] + LENGTH
        start, end = max(0, int(low[0])), min(len(data), int(high[-1]) + period)
        differ = np.concatenate([[0], np.cumsum(data[start : end - period] != data[start + period : end])])
        same, fits = np.zeros(j - i, bool), (low >= 0) & (high + period <= end)
        same[fits] = differ[high[fits] - start] == differ[low[fits] - start]
        _, begins, ends = _runs(same[None])
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            out = b - a + 2 - needed
            if out * period > WINDOW:
                stays[i + a : i + a + out] = False
                back[i + a + out] = out * period
    return at[stays], first[stays], following[stays[:n]], back[stays[:n]]


def _parse(docs: DataFrame, path: str) -> DataFrame:
    """Each document's length, digest, anchors and hashes, written to ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [b"" if t is None else t.encode() for t in frame["text"]]
            for low, high in by_bytes(texts, 1 << 18):
                rows = []
                for text, (at, first, following) in zip(texts[low:high], anchors(texts[low:high]), strict=True):
                    at, first, following, back = _shortened(np.frombuffer(text, np.uint8), at, first, following)
                    rows.append((len(text), hashlib.sha256(text).hexdigest(), at.astype(np.int32), first.astype(np.int32), following.view(np.int64), back.astype(np.int32)))
                yield pd.DataFrame(rows, columns=["n_bytes", "sha256", "at", "first", "following", "back"]).assign(doc_id=frame["doc_id"].array[low:high])

    schema = "doc_id long, n_bytes long, sha256 string, at array<int>, first array<int>, following array<long>, back array<int>"
    docs.select("doc_id", "text").mapInPandas(run, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _tails(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates' next anchor is none: their string of symbols ends with that anchor's, which no other text has."""
    return np.flatnonzero(np.append(after[:-1] != at[1:], True))


def _tail_hash(symbol: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(symbol, digest_size=8).digest(), "little", signed=True)


def _symbols(asked: DataFrame) -> DataFrame:
    """(h, symbol) of every candidate and tail of texts with their candidates (at, after, following)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: dict[int, bytes] = {}
            for text, at, after, following in zip(frame["text"], frame["at"], frame["after"], frame["following"], strict=True):
                data = text.encode()
                for h, a in zip(following.tolist(), at.tolist(), strict=True):
                    if h not in found:
                        found[h] = data[a : a + FOLLOWING]
                for a in after[_tails(at, after)].tolist():
                    found[_tail_hash(data[a : a + FOLLOWING])] = data[a : a + FOLLOWING]
            yield pd.DataFrame({"h": list(found), "symbol": list(found.values())})

    return asked.select("text", "at", "after", "following").mapInPandas(run, "h long, symbol binary")


def _strings(asked: DataFrame) -> DataFrame:
    """(tid, hs, need): each text's symbols by their hashes, and the most symbols that LENGTH bytes from a candidate on take."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for tid, text, at, after, following in zip(frame["tid"], frame["text"], frame["at"], frame["after"], frame["following"], strict=True):
                data, ends = text.encode(), _tails(at, after)
                places = np.insert(at, ends + 1, after[ends])
                hs = np.insert(following, ends + 1, [_tail_hash(data[a : a + FOLLOWING]) for a in after[ends].tolist()])
                # anchors left out of a periodic stretch leave a step that no others have; it counts as the shortest
                step = np.diff(places)
                step[(step > WINDOW) & ~np.isin(places[:-1], after[ends])] = 1
                along = np.concatenate([[0], np.cumsum(step)])
                need = np.searchsorted(along, along + LENGTH - FOLLOWING) - np.arange(len(along)) + 1
                rows.append((tid, hs, int(need.max())))
            yield pd.DataFrame(rows, columns=["tid", "hs", "need"])

    return asked.select("tid", "text", "at", "after", "following").mapInPandas(run, "tid long, hs array<long>, need int")


def _ranks(asked: DataFrame) -> DataFrame:
    """(tid, ranks): the rank of each of a text's symbol suffixes among all; its order is that of their first LENGTH bytes."""
    strings = stored(_strings(asked), "hashed")
    # symbols are named by their place in the order of their bytes
    ordered = _symbols(asked).distinct().repartitionByRange("symbol").sortWithinPartitions("symbol").select("h", (F.monotonically_increasing_id() + 1).alias("name"))
    names = stored(ordered.groupBy("h").agg(F.min("name").alias("name")), "names")
    named = strings.select("tid", F.posexplode("hs").alias("pos", "h")).join(names, "h").groupBy(F.col("tid").alias("sid"))
    named = stored(named.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("ts")), "strings")
    need, depth = strings.agg(F.max("need")).first()[0] or 1, 1
    while 3**depth < need:
        depth += 1
    return suffix_ranks(named, depth).select(F.col("sid").alias("tid"), "ranks")


def _members(asked: DataFrame, hot: bool) -> DataFrame:
    """A row for each candidate of a text: its rank, its starts at - most .. at - least, and the bytes around it.

    ``asked`` has texts with arrays of their candidates; those of groups above GROUP are taken with ``hot``, else the
    others. ``around`` holds the BEFORE bytes before the anchor, the nearest first, and LENGTH bytes from it on.
    """
    pad = b"\0"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts, n = [], 0
            for row in frame.itertuples(index=False):
                chosen = np.flatnonzero((row.m > 0) & ((row.m > GROUP) == hot))
                if not len(chosen):
                    continue
                data, at = row.text.encode(), row.at
                ends = _tails(at, row.after)
                places = np.delete(np.arange(len(at) + len(ends)), ends + 1 + np.arange(len(ends)))
                around = [data[max(0, a - BEFORE) : a][::-1].ljust(BEFORE, pad) + data[a : a + LENGTH].ljust(LENGTH, pad) for a in at[chosen].tolist()]
                parts.append(pd.DataFrame({
                    "following": row.following[chosen], "rank": row.ranks[places[chosen]], "tid": row.tid, "at": at[chosen], "back": row.back[chosen],
                    "least": at[chosen] - row.high[chosen], "most": at[chosen] - row.low[chosen], "around": around,
                }))
                n += len(chosen)
                if n > 5_000:
                    yield pd.concat(parts, ignore_index=True)
                    parts, n = [], 0
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return asked.mapInPandas(run, "following long, rank long, tid long, at int, back int, least int, most int, around binary")


def _matrix(around: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(around), np.uint8).reshape(len(around), BEFORE + LENGTH)


def _shared(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it, from the second row on."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def _as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true columns."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def repeating(following: np.ndarray, least: np.ndarray, most: np.ndarray, around: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first d, last d): starts that repeat, as distances before their anchor, for anchors in the order of (following, rank).

    Anchors with the same bytes all around them repeat wholly, as do those marked ``again``. Of the others, one for each
    context, starts d before the anchor meet that have the same d bytes before it and lie in one run of the rank order in
    which neighbours share LENGTH - d bytes.
    """
    left, right = around[:, :BEFORE], around[:, BEFORE:]
    shared = _shared(right)
    shared[following[1:] != following[:-1]] = 0
    run = np.concatenate([[0], np.cumsum(shared < LENGTH)])
    keys = np.concatenate([np.stack([run, least, most], axis=1).astype(">i4").view(np.uint8).reshape(len(run), -1), left], axis=1)
    _, first, number, count = np.unique(_as_strings(keys), return_index=True, return_inverse=True, return_counts=True)
    whole = again | (count[number] > 1)
    rows, low, high = [np.flatnonzero(whole)], [least[whole]], [most[whole]]
    one = np.sort(first)  # in rank order
    same = following[one[1:]] == following[one[:-1]]
    one = one[np.append(same, False) | np.append(False, same)]
    if len(one):
        n, flags = len(one), np.zeros((len(one), BEFORE + 1), bool)
        shared = _shared(right[one])
        shared[following[one[1:]] != following[one[:-1]]] = 0
        strings = _as_strings(left[one])
        order = np.argsort(strings, kind="stable")
        before = _shared(left[one][order])
        shallow, deep, left_run = least[one], most[one], np.zeros(n, np.int64)
        for d in range(BEFORE + 1):
            own = np.flatnonzero((shallow <= d) & (d <= deep))
            if len(own) < 2:
                continue
            left_run[order] = np.concatenate([[0], np.cumsum(before < d)])
            pair = (np.concatenate([[0], np.cumsum(shared < LENGTH - d)]) * n + left_run)[own]
            by = np.argsort(pair)
            equal = pair[by[1:]] == pair[by[:-1]]
            flags[own[by[np.append(equal, False) | np.append(False, equal)]], d] = True
        flags[whole[one]] = False
        row, a, b = _runs(flags)
        rows, low, high = [*rows, one[row]], [*low, a], [*high, b]
    return np.concatenate(rows), np.concatenate(low), np.concatenate(high)


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames in the order of ``following``, recut so that no group is split and about TOGETHER rows come at once."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= TOGETHER:
            frame = pd.concat(held, ignore_index=True)
            following = frame["following"].to_numpy()
            end = int(np.searchsorted(following, following[-1]))
            if end:
                yield frame.iloc[:end]
            held, n = [frame.iloc[end:]], len(frame) - end
    if n:
        yield pd.concat(held, ignore_index=True)


def _cold(members: DataFrame, fields: str) -> DataFrame:
    """(fields, first, last): starts that repeat in groups of at most GROUP rows; a row of ``weight`` above 1 repeats wholly."""
    names = [f.split()[0] for f in fields.split(", ")]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames):
            around, weight = _matrix(frame["around"]), frame["weight"].to_numpy()
            row, first, last = repeating(*(frame[c].to_numpy() for c in ("following", "least", "most")), around, weight > 1)
            yield frame[names].iloc[row].assign(first=first, last=last)

    rows = members.repartition("following").sortWithinPartitions("following", "rank")
    return rows.mapInPandas(compare, f"{fields}, first int, last int")


def _hot(contexts: DataFrame) -> DataFrame:
    """(context_no, first, last) for groups of any size: the runs of the rank order are found by one scan over all tasks, and
    starts are counted by (run, bytes before the anchor) with partial sums. Starts side by side are one range."""
    order = ["following", "rank", "context_no"]
    ranged = checkpoint(contexts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.spark_partition_id()))
    wanted = np.arange(LENGTH, LENGTH - BEFORE - 1, -1)  # bytes to share for d = 0, 1, ...

    def scan(frames: Iterator[pd.DataFrame], start: np.ndarray, at: int, before: tuple | None) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Each frame with the row number of the run's start for each row and d."""
        for whole in frames:
            for k in range(0, len(whole), 1_000):
                frame = whole.iloc[k : k + 1_000]
                right, following = _matrix(frame["around"])[:, BEFORE:], frame["following"].to_numpy()
                if before is None:
                    shared = np.concatenate([[0], _shared(right)])
                    shared[1:][following[1:] != following[:-1]] = 0
                else:
                    shared = _shared(np.concatenate([before[1], right]))
                    shared[following != np.append(before[0], following[:-1])] = 0
                number = np.arange(at, at + len(frame))
                starts = np.where(shared[:, None] < wanted, number[:, None], -1)
                starts[0] = np.maximum(starts[0], start)
                starts = np.maximum.accumulate(starts, axis=0)
                yield frame, starts
                start, at, before = starts[-1], at + len(frame), (following[-1], right[-1:])

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = last = None
        n = 0
        for frame, starts in scan(frames, np.full(BEFORE + 1, -1), 0, None):
            head = frame.iloc[0] if head is None else head
            last, n = (frame.iloc[-1], starts[-1]), n + len(frame)
        if last is not None:
            yield pd.DataFrame({"place": [head["place"]], "n": [n], "head": [head["around"]], "head_following": [head["following"]], "tail": [last[0]["around"]], "tail_following": [last[0]["following"]], "starts": [last[1]]})

    schema = "place int, n long, head binary, head_following long, tail binary, tail_following long, starts array<long>"
    carried, at, start, before = {}, 0, np.full(BEFORE + 1, -1), None
    for part in sorted(ranged.mapInPandas(ends, schema).collect(), key=lambda r: r.place):  # a row for each partition
        carried[part.place] = (start, at, before)
        own = np.array(part.starts)
        shared = 0
        if before is not None and before[0] == part.head_following:
            shared = int(_shared(np.concatenate([before[1], _matrix(pd.Series([part.head]))[:, BEFORE:]]))[0])
        # own starts are counted from this partition's first row; a start of 0 may lie further back
        start = np.where((own == 0) & (shared >= wanted), start, own + at)
        at, before = at + part.n, (part.tail_following, _matrix(pd.Series([part.tail]))[:, BEFORE:])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(frames, None)
        if first is None:
            return
        frames = (f for part in ([first], frames) for f in part)
        for frame, starts in scan(frames, *carried[int(first["place"].iat[0])]):
            left, h = _matrix(frame["around"])[:, :BEFORE], np.zeros(len(frame), np.uint64)
            for d in range(BEFORE + 1):
                own = ((frame["least"] <= d) & (d <= frame["most"])).to_numpy()
                if own.any():
                    yield pd.DataFrame({"run": starts[own, d], "d": d, "h": h[own].view(np.int64), "context_no": frame["context_no"].to_numpy()[own]})
                if d < BEFORE:
                    h = mix(h * U(3) + left[:, d].astype(np.uint64) + U(1))

    rows = ranged.mapInPandas(spread, "run long, d int, h long, context_no long")
    again = stored(rows.groupBy("run", "d", "h").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    each = rows.join(again, ["run", "d", "h"]).groupBy("context_no").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    # a context has each d once; neighbours are one range
    firsts = F.filter("ds", lambda d, i: (i == 0) | (F.get("ds", i - 1) < d - 1))
    lasts = F.filter("ds", lambda d, i: (i == F.size("ds") - 1) | (F.get("ds", i + 1) > d + 1))
    found = each.select("context_no", F.explode(F.arrays_zip(firsts.alias("first"), lasts.alias("last"))).alias("x")).select("context_no", "x.first", "x.last")
    return found.unionByName(ranged.filter("weight > 1").select("context_no", F.col("least").alias("first"), F.col("most").alias("last")))


def _repeats(asked: DataFrame) -> DataFrame:
    """(tid, low, high): arrays of the ranges of starts that occur again, a row for each text that has any, for texts, the
    candidates wanted of them and their ranks."""
    cold = _cold(_members(asked, False).withColumn("weight", F.lit(1)), "tid long, at int, back int")
    cold = cold.select("tid", F.array(F.struct((F.col("at") - F.col("last") - F.col("back")).alias("low"), (F.col("at") - F.col("first")).alias("high"))).alias("x"))

    def by_text(found: DataFrame) -> DataFrame:
        ranges = found.groupBy("tid").agg(F.flatten(F.collect_list("x")).alias("x"))
        return ranges.select("tid", F.col("x.low").alias("low"), F.col("x.high").alias("high"))

    large = asked.filter(F.exists("m", lambda m: m > GROUP))
    if not large.limit(1).count():
        return by_text(cold)
    # equal contexts of a large group are one row first
    context = F.sha2(F.concat("around", F.encode(F.concat_ws(",", "following", "least", "most"), "utf-8")), 256).alias("context")
    members = _members(large, True).select("*", context)
    contexts = members.groupBy("context", "following", "least", "most", "around").agg(F.count("*").alias("weight"), F.min("rank").alias("rank"))
    contexts = stored(contexts.withColumn("context_no", F.monotonically_increasing_id()), "contexts")
    release(asked.sparkSession)
    compared = contexts.drop("context")
    sizes = contexts.groupBy("following").agg(F.count("*").alias("m"))
    varied = stored(sizes.filter(F.col("m") > CONTEXTS).select("following"), "varied")
    found = _cold(compared.join(varied, "following", "left_anti"), "context_no long")
    if varied.limit(1).count():
        found = found.unionByName(_hot(compared.join(varied, "following", "left_semi")))
    # one row for each context, so a member finds one row whatever the number of its ranges
    found = found.groupBy("context_no").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    found = stored(found.join(contexts.select("context_no", "context"), "context_no").select("context", "ranges"), "context-repeats")
    release(asked.sparkSession)
    # the ranges stay one array, so no row is made for each range of a member
    moved = F.transform("ranges", lambda r: F.struct((F.col("at") - r["last"] - F.col("back")).alias("low"), (F.col("at") - r["first"]).alias("high")))
    hot = members.select("context", "tid", "at", "back").join(found, "context").select("tid", moved.alias("x"))
    return by_text(cold.unionByName(hot))


def _cover(n: int, lows: np.ndarray, highs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs from ranges of starts."""
    runs: list[list[int]] = []
    order = np.argsort(lows, kind="stable")
    for low, high in zip(np.asarray(lows)[order].tolist(), np.asarray(highs)[order].tolist(), strict=True):
        end = min(n, high + LENGTH)
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([low, end])
    return [(a, b) for a, b in runs]


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document of (doc_id, text) as (doc_id, n_bytes, sha256, whole), and the texts that lose a part: (doc_id, sha256, text, low, high).

    ``whole`` documents occur more than once and go whole. The second table has one row for each such text; its
    repeating starts are the ranges low..high.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "parsed")
    parsed = _parse(docs, path)
    info = stored(parsed.select("doc_id", "n_bytes", "sha256"), "texts")
    tid = F.xxhash64("sha256").alias("tid")
    first = parsed.filter(f"n_bytes >= {LENGTH}").groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_bytes", "at", "first", "following", "back")))
    distinct_path, repeated_path, candidates_path, groups_path = (shared_path(spark, x) for x in ("distinct", "repeated", "candidates", "groups"))
    distinct = stored_at(first.select(tid, "*"), distinct_path)
    drop_path(spark, path)
    release(spark)
    # of the texts only their names are needed from the candidates on
    names = stored(distinct.select("tid", "sha256", "doc_id", "copies"), "names")
    each = distinct.select("copies", F.explode("following").alias("following"))
    # written, so that the join deals its sides anew and can split a hash that is everywhere
    repeated = stored_at(each.groupBy("following").agg(F.sum("copies").alias("n")).filter("n > 1").select("following"), repeated_path)
    # each candidate with its starts, and where the next anchor is
    entry = f"""inline(transform(sequence(0, size(following) - 1), i -> struct(following[i] AS following, at[i] AS at, first[i] AS low,
        least(first[i + 1] - 1, CAST(n_bytes - {LENGTH} AS INT), at[i]) AS high, at[i + 1] AS after, back[i] AS back)))"""
    candidates = stored_at(distinct.selectExpr("tid", "copies", entry).join(repeated, "following"), candidates_path)
    del distinct, each, repeated
    drop_path(spark, distinct_path)
    drop_path(spark, repeated_path)
    release(spark)
    # groups with something to decide; of the other candidates only the symbols are needed
    groups = candidates.filter("low <= high").groupBy("following").agg(F.count("*").alias("m"), F.min("copies").alias("fewest")).filter("m > 1 AND fewest = 1")
    groups = stored_at(groups.select("following", F.col("m").cast("int").alias("m")), groups_path)
    fields = ["at", "after", "low", "high", "following", "back", "m"]
    sized = candidates.join(groups, "following", "left").withColumn("m", F.when(F.col("low") <= F.col("high"), F.coalesce("m", F.lit(0))).otherwise(0))
    arrays = sized.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("x")).filter(F.exists("x", lambda x: x["m"] > 0))
    arrays_path, texts_path, asked_path = (shared_path(spark, x) for x in ("arrays", "candidate-texts", "asked"))
    arrays = stored_at(arrays.select("tid", *(F.col(f"x.{c}").alias(c) for c in fields)), arrays_path)
    del candidates, groups, sized
    drop_path(spark, candidates_path)
    drop_path(spark, groups_path)
    release(spark)
    # the texts that matter, once each
    own = names.withColumnRenamed("doc_id", "carrier").join(arrays.select("tid"), "tid")
    keyed = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    texts = keyed.join(own, (keyed["sha256"] == own["sha256"]) & keyed["doc_id"].eqNullSafe(own["carrier"])).select("tid", "copies", own["sha256"], own["carrier"].alias("doc_id"), "text")
    texts = stored_at(texts, texts_path)
    release(spark)
    once = texts.select("tid", "text")
    if texts.groupBy("tid").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():  # rows with equal ids and texts
        once = once.dropDuplicates(["tid"])
    asked = stored_at(once.join(arrays, "tid"), asked_path)
    release(spark)
    ranks = _ranks(asked.select("tid", "text", "at", "after", "following"))
    release(spark)
    ranked = asked.join(ranks, "tid").select("tid", "text", *fields, "ranks")
    spans = stored(_repeats(ranked), "ranges")
    del asked, ranks, ranked, arrays
    for done in (asked_path, arrays_path):
        drop_path(spark, done)
    release(spark)
    partly = texts.filter("copies = 1").join(spans, "tid").select("doc_id", "sha256", "text", "low", "high")
    whole = names.filter("copies > 1").select("sha256").withColumn("whole", F.lit(True))
    return info.join(whole, "sha256", "left").withColumn("whole", F.coalesce("whole", F.lit(False))), partly


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and the digest of what it keeps."""
    info, partly = removed_spans(table(spark, sf_dir, "documents"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for sha, text, lows, highs in zip(frame["sha256"], frame["text"], frame["low"], frame["high"], strict=True):
                data, own, low = text.encode(), hashlib.sha256(), 0
                runs = _cover(len(data), lows, highs)
                for a, b in runs:
                    own.update(data[low:a])
                    low = b
                own.update(data[low:])
                rows.append((sha, sum(b - a for a, b in runs), len(runs), own.hexdigest()))
            yield pd.DataFrame(rows, columns=["sha256", "removed", "runs", "kept"])

    lost = partly.select("sha256", "text", "low", "high").mapInPandas(digest, "sha256 string, removed long, runs long, kept string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    zero = F.lit(0).cast("long")
    return info.join(lost, "sha256", "left").select(
        "doc_id", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1).cast("long")).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of their texts; characters cut in part go; every document stays."""
    _, partly = removed_spans(docs)
    spans = partly.select("sha256", "low", "high")
    # the row travels as one column, so that its columns may have any names
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    copies = keyed.groupBy("sha256").agg(F.count("*").alias("copies")).filter("copies > 1")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        out = []
        for text, low_starts, high_starts in zip(texts, lows, highs, strict=True):
            if low_starts is None:
                out.append(text)
                continue
            data, low, kept = text.encode(), 0, b""
            for a, b in _cover(len(data), low_starts, high_starts):
                kept += data[low:a]
                low = b
            out.append((kept + data[low:]).decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    text = F.col("row.text")
    whole = F.coalesce((F.col("copies") > 1) & (F.octet_length(text) >= LENGTH), F.lit(False))
    joined = keyed.join(spans, "sha256", "left").join(copies, "sha256", "left")
    joined = joined.withColumn("changed", whole | F.col("low").isNotNull()).withColumn("new", F.when(whole, F.lit("")).when(F.col("low").isNotNull(), cut(text, "low", "high")).otherwise(text))
    new = {"text": F.col("new"), "n_chars": F.length("new")}
    return joined.select(*(F.when(F.col("changed"), new[f.name].cast(f.dataType)).otherwise(F.col(f"row.`{f.name}`")).alias(f.name) if f.name in new else F.col(f"row.`{f.name}`").alias(f.name) for f in docs.schema))
