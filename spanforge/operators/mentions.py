"""How many documents mention each of any number of names, anywhere in their texts.

Every name is looked up by one run of GRAM bytes in it, the rarest among the names' runs. Documents pass once: a bitmap of
fixed size tells which of their runs may be one of those; only such runs leave the task, with the bytes around them, and
meet the names by a shuffle on the run. Names shorter than a run are their own runs and are counted in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.session import stored

GRAM = 8
#: Bits of the bitmap, and those of one block of it.
BITS, BLOCK_BITS = 26, 15
#: Bytes of text searched at once, about.
TOGETHER = 1 << 21
U = np.uint64
#: A byte that no UTF-8 text has.
APART = b"\xff"


def runs(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each place on as a number; ``data`` ends with GRAM spare bytes."""
    words = np.ndarray((len(data) - GRAM,), "<u8", data, strides=(1,))
    return words if size == GRAM else words & U((1 << 8 * size) - 1)


def places(grams: np.ndarray, size: int) -> np.ndarray:
    """Each run's bit."""
    x = (grams ^ U(size)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return (x >> U(64 - BITS)).astype(np.int64)


def _name_runs(names: DataFrame, name: str) -> DataFrame:
    """(name, size, offset, gram) for the runs of each name; a short name is one run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame[name]:
                data = text.encode()
                size = min(len(data), GRAM)
                grams = runs(np.frombuffer(data + b"\0" * (GRAM + 1), np.uint8), size)[: len(data) - size + 1]
                yield pd.DataFrame({"name": text, "size": size, "offset": np.arange(len(grams), dtype=np.int32), "gram": grams.view(np.int64), "bit": places(grams, size)})

    return names.select(name).mapInPandas(run, "name string, size int, offset int, gram long, bit long")


def _bitmap(triggers: DataFrame) -> np.ndarray:
    """The triggers' bits, a block at a time through the driver; 2**BITS bits in all."""
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    blocks = triggers.groupBy(F.shiftright("bit", BLOCK_BITS).alias("block")).agg(F.collect_set("bit").alias("bits"))  # 2**BLOCK_BITS at most
    for row in blocks.toLocalIterator():
        at = np.array(row.bits, np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def mention_counts(docs: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """(name, n_docs) for every name: documents whose text contains it anywhere; repeated names are one, the empty one is in every text."""
    spark = docs.sparkSession
    names = names.select(F.col(name).cast("string").alias(name)).filter(F.col(name).isNotNull()).distinct()
    each = _name_runs(names, name)
    frequency = each.groupBy("size", "gram").agg(F.count_distinct("name").alias("n"))
    rarest = each.join(frequency, ["size", "gram"]).groupBy("name").agg(F.min_by(F.struct("size", "offset", "gram", "bit"), F.struct("n", "offset")).alias("t"))
    triggers = stored(rarest.select("name", "t.*"), "triggers")
    found = triggers.agg(F.collect_set("size").alias("sizes"), F.max(F.when(F.col("size") == GRAM, F.col("offset"))).alias("before"), F.max(F.when(F.col("size") == GRAM, F.octet_length("name") - F.col("offset"))).alias("after")).first()
    sizes, before, after = sorted(found.sizes), found.before or 0, found.after or GRAM
    shared = spark.sparkContext.broadcast(_bitmap(triggers))

    def may_be(grams: np.ndarray, size: int) -> np.ndarray:
        at = places(grams, size)
        return np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    def search(texts: list[bytes]) -> Iterator[pd.DataFrame]:
        gap = APART * max(before, GRAM)
        joined = gap + b"".join(t + gap for t in texts) + APART * max(after, GRAM)
        data = np.frombuffer(joined, np.uint8)
        starts = np.cumsum([len(gap), *(len(t) + len(gap) for t in texts)])[:-1]
        for size in sizes:
            if not size:  # the empty name
                yield pd.DataFrame({"size": [0], "gram": [0], "n": [len(texts)], "around": [None]})
                continue
            grams = runs(data, size)
            at = may_be(grams, size)
            document = np.searchsorted(starts, at, "right") - 1
            at, document = at[document >= 0], document[document >= 0]
            own = pd.DataFrame({"gram": grams[at].view(np.int64), "document": document, "at": at})
            if size < GRAM:
                once = own.drop_duplicates(["gram", "document"]).groupby("gram").size()
                yield pd.DataFrame({"size": size, "gram": once.index.to_numpy(), "n": once.to_numpy(), "around": None})
                continue
            for (gram, _), places_ in own.groupby(["gram", "document"])["at"]:
                around = sorted({joined[a - before : a + after] for a in places_.tolist()})
                yield pd.DataFrame({"size": [size], "gram": [gram], "n": [1], "around": [around]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            batch, held = [], 0
            for t in frame[text]:
                batch.append(t.encode())
                held += len(batch[-1])
                if held >= TOGETHER:
                    yield from gathered(search(batch))
                    batch, held = [], 0
            if batch:
                yield from gathered(search(batch))

    def gathered(parts: Iterator[pd.DataFrame], most: int = 5_000) -> Iterator[pd.DataFrame]:
        some = []
        for part in parts:
            some.append(part)
            if len(some) >= most:
                yield pd.concat(some, ignore_index=True)
                some = []
        if some:
            yield pd.concat(some, ignore_index=True)

    hits = docs.select(text).filter(F.col(text).isNotNull()).mapInPandas(run, "size int, gram long, n long, around array<binary>")
    met = hits.join(triggers, ["size", "gram"])
    whole = F.expr(f"size < {GRAM} OR exists(around, w -> substring(w, {before} - offset + 1, octet_length(name)) = CAST(name AS BINARY))")
    counts = met.filter(whole).groupBy("name").agg(F.sum("n").alias("n_docs"))
    return names.join(counts.withColumnRenamed("name", name), name, "left").select(name, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
