"""Language identification with bit-sliced Bloom filters over byte n-grams.

Every cell of the filter holds one bit per language; the AND over an n-gram's cells is the mask of all languages that
contain it. A text's masks are counted per language, and each count is corrected by that language's false-positive rate
before the largest decides.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing was
learned; ties go to the smaller language value; rows with a null id are not learned from and count as held out;
a null lang is not learned from; equal rows are predicted each; a text of any length is counted whole, by itself if it
fills a batch; other columns, however named, are passed on by ``predict`` and not read by ``learn``; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import fold, stored, table
from spanforge.llm.hashing import U, by_bytes, mix

#: Bytes in an n-gram, and cells probed for each.
N, PROBES = 5, 3
#: Documents learned from for each language, about (chosen by a hash of the text), and n-grams kept for each.
SAMPLE_DOCS, GRAMS = 1_500, 60_000
#: Languages that the filters hold at most; more are an error.
LANGUAGES = 1_024
#: An n-gram is in a language if its rate there is at least this share of its highest rate in any.
LEAST_RATE = 0.25
CELL_BITS = 20
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Filters:
    languages: list[str]
    cells: np.ndarray  # (planes, 2**CELL_BITS) words of up to 64 languages each
    false_rate: np.ndarray


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes at every byte of all texts, which of them lie within a text, and the texts' starts."""
    padded = [b"\n" + t + b"\n" * N for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8)
    packed = np.zeros(len(data), np.uint64)
    for k in range(N):
        packed[: len(data) - k] |= data[k:].astype(np.uint64) << U(8 * k)
    sizes = np.array([len(p) for p in padded])
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(data), bool)
    for k in range(N - 1):
        inside[starts + sizes - 1 - k] = False
    return mix(packed), inside, starts


def probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield (hashes >> U(CELL_BITS * k)) & U((1 << CELL_BITS) - 1)


def learn(docs: DataFrame) -> Filters:
    """Filters from (text, lang) rows; every language's n-grams are counted over its sample of whole texts."""
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the filters hold {LANGUAGES} at most")
    if not languages:
        return Filters([], np.zeros((1, 1 << CELL_BITS), np.uint8), np.zeros(0))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, SAMPLE_DOCS / n))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(chance < F.element_at(share, F.col("lang"))).select("text", "lang")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                texts = [t.lower().encode() for t in part["text"]]
                for low, high in by_bytes(texts, 4 << 20):
                    hashes, inside, _ = grams(texts[low:high])
                    found, n = np.unique(hashes[inside], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": found.view(np.int64), "n": n})

    counted = stored(sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for item in totals.items() for x in item]), F.col("lang"))
    best = counted.withColumn("rate", rate)
    most = best.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = best.join(most, "gram").filter((F.col("n") > 1) & (F.col("rate") >= LEAST_RATE * F.col("most")))
    dtype = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= bits or bits == 64)
    cells = np.zeros((-(-len(languages) // 64), 1 << CELL_BITS), dtype)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    chosen = kept.withColumn("place", place).filter(F.col("place") <= GRAMS).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    for row in chosen.toLocalIterator():  # a row of at most GRAMS n-grams for each language
        k = languages.index(row.lang)
        for at in probes(np.array(row.grams, np.int64).view(np.uint64)):
            cells[k // 64][at] |= dtype(1 << k % 64)
    load = np.array([np.mean(cells[k // 64] >> dtype(k % 64) & dtype(1)) for k in range(len(languages))])
    return Filters(languages, cells, load**PROBES)


def popcounts(texts: list[bytes], filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each text found per language (texts x languages), and n-grams in all."""
    hashes, inside, starts = grams(texts)
    at = list(probes(hashes))
    out = np.empty((len(texts), len(filters.languages)))
    for plane, cells in enumerate(filters.cells):
        masks = cells[at[0]]
        for k in range(1, PROBES):
            masks &= cells[at[k]]
        masks[~inside] = 0
        for k in range(64 * plane, min(64 * plane + 64, len(filters.languages))):
            out[:, k] = np.add.reduceat((masks >> cells.dtype.type(k % 64) & cells.dtype.type(1)).astype(np.int32), starts)
    return out, np.add.reduceat(inside.astype(np.int64), starts)


def decide(found: np.ndarray, total: np.ndarray, false_rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and its share of the corrected counts."""
    true = np.maximum((found - total[:, None] * false_rate) / (1 - false_rate), 0) + 1e-9
    best = true.argmax(axis=1)
    return best, true[np.arange(len(true)), best] / true.sum(axis=1)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """Add lang_pred and score to rows with ``text``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        letters = [k for k, t in enumerate(texts) if t is not None and LETTER.search(t)] if own.languages else []
        lowered = [texts.iat[k].lower().encode() for k in letters]
        for low, high in by_bytes(lowered, 1 << 20):
            best, score = decide(*popcounts(lowered[low:high], own), own.false_rate)
            names[letters[low:high]] = np.array(own.languages, object)[best]
            scores[letters[low:high]] = score
        return pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, of("text").alias("__found")).select(*kept, "__found.lang_pred", "__found.score")


def held_out(remainder: int, modulus: int) -> Column:
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(True))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(1, 3))
    filters = learn(docs.filter("NOT held_out").select("text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")
