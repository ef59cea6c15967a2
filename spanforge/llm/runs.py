"""Periodic run detection by the runs theorem.

Words become integers in the order of a dictionary; a batch's suffix array is made by prefix doubling that only sorts what
is still tied. The longest Lyndon word at every position ends at the next smaller value of the inverse suffix array, under
the reversed order at the next greater one, and by the theorem every run has such words as its roots under one of the two
orders. Roots are extended in both directions by longest common extensions: LCP array and a sparse table of block minima.

Every document has an alphabet of its own and ends with a sign smaller than its words, so nothing crosses documents and
copies of one text cost no more than different texts.

Defined results: a null or empty text, or one of white space, has no words, no runs, four nulls and the digests of the
empty string; a row with a null id keeps its words as they are; equal rows are answered each; ties go to the smallest start, then
period; a very long text is a batch of its own, in memory linear in its words; of other columns only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import table
from spanforge.llm.hashing import by_bytes

#: Bytes of text handled together.
BATCH = 1 << 20
#: Entries of the LCP array under one entry of the sparse table.
BLOCK = 16
#: Vector steps before the positions that are left are followed one by one; fewer than FEW always are.
STEPS, LEAPS, FEW = 24, 400, 60


def encoded(documents: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as integers from 1, each document followed by a 0, and the n+1 offsets of the documents."""
    sizes = np.array([len(words) + 1 for words in documents], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.zeros(offsets[-1], np.int64)
    inside = np.ones(offsets[-1], bool)
    inside[offsets[1:] - 1] = False
    known: defaultdict[bytes, int] = defaultdict(count(1).__next__)  # a new word gets the next number
    codes[inside] = [known[word] for words in documents for word in words]
    return codes, offsets


def suffix_array(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, documents one after the other, and each position's place in it."""
    n = len(codes)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = document * (int(codes.max(initial=0)) + 1) + codes
    order, rank = np.arange(n), np.zeros(n, np.int64)
    tied, step = order, 0
    while len(tied):
        if step:
            key = rank[tied] * (n + 1) + rank[tied + step]
        by_key = np.argsort(key, kind="stable")
        tied, key = tied[by_key], key[by_key]
        at = np.arange(len(tied))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        if step:  # the members of a group of ties fill the places that the group holds
            old = rank[tied]
            new_group = np.concatenate([[True], old[1:] != old[:-1]])
            place = old + at - np.maximum.accumulate(np.where(new_group, at, 0))
        else:
            place = at
        order[place] = tied
        rank[tied] = place[np.maximum.accumulate(np.where(new_key, at, 0))]
        alone = new_key & np.concatenate([new_key[1:], [True]])
        tied = tied[~alone]
        step = max(1, 2 * step)
    return order, rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next place with a smaller value, or the length.

    All places leap at once over what is known to be greater; the few that are left after some leaps are followed from the right.
    """
    n = len(values)
    padded = np.append(values, np.iinfo(np.int64).min)
    after = np.arange(1, n + 2)
    after[n] = n
    open_ = np.arange(n)
    for _ in range(LEAPS):
        open_ = open_[padded[after[open_]] > padded[open_]]
        if not len(open_):
            return after[:n]
        if len(open_) < FEW:
            break
        after[open_] = after[after[open_]]
    for place in open_[::-1].tolist():
        own, to = padded[place], int(after[place])
        while padded[to] > own:
            to = int(after[to])
        after[place] = to
    return after[:n]


def common_prefixes(codes: np.ndarray, order: np.ndarray, rank: np.ndarray, document: np.ndarray) -> np.ndarray:
    """LCP of every suffix in order with the one before it; 0 across documents.

    Only where the words before both suffixes differ is anything compared; elsewhere the value is one less than at the
    position before. The compared lengths sum to O(n log n).
    """
    n = len(codes)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    apart = (before < 0) | (document[before] != document)
    before[apart] = -1
    length = np.zeros(n, np.int64)
    at = np.arange(n)
    counted = before <= 0
    counted |= at == 0
    inner = np.flatnonzero(~counted)
    counted[inner] = codes[inner - 1] != codes[before[inner] - 1]
    counted[1:] |= before[:-1] < 0  # nothing is known from a position without a neighbour
    open_ = np.flatnonzero(counted & (before >= 0))
    for _ in range(STEPS):  # a document's last sign never equals another position of the same document: no step leaves it
        left, right = open_ + length[open_], before[open_] + length[open_]
        open_ = open_[(codes[left] == codes[right]) & (codes[left] > 0)]
        if not len(open_):
            break
        length[open_] += 1
    for place in open_.tolist():
        left, right, step = place + int(length[place]), int(before[place] + length[place]), 64
        while True:
            a, b = codes[left : left + step], codes[right : right + step]
            wide = min(len(a), len(b))
            off = np.flatnonzero((a[:wide] != b[:wide]) | (a[:wide] == 0))
            if len(off):
                length[place] = left + int(off[0]) - place
                break
            left, right, step = left + wide, right + wide, 2 * step
    last = np.maximum.accumulate(np.where(counted, at, 0))
    by_position = np.maximum(length[last] - (at - last), 0)
    by_position[before < 0] = 0
    return by_position[order]


class Extensions:
    """Longest common extensions to the right, for many pairs of positions at once."""

    def __init__(self, lcp: np.ndarray, rank: np.ndarray):
        self.rank, self.n = rank, len(rank)
        blocks = -(-max(self.n, 1) // BLOCK)
        self.lcp = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        self.lcp[: self.n] = lcp
        self.levels = [self.lcp.reshape(blocks, BLOCK).min(axis=1)]
        while 2 ** len(self.levels) <= blocks:
            half = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Words that the suffixes at two different positions of one document share from their start."""
        a, b = self.rank[left], self.rank[right]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # the minimum of lcp[low:high]
        least = np.full(len(low), np.iinfo(np.int64).max)
        first, last = -(-low // BLOCK), high // BLOCK
        for k in range(BLOCK):  # the ends, or a range within one or two blocks
            for at in (low + k, high - 1 - k):
                inside = (at >= low) & (at < high)
                least[inside] = np.minimum(least[inside], self.lcp[at[inside]])
        whole = np.flatnonzero(last > first)
        if len(whole):
            depth = np.frexp((last - first)[whole].astype(float))[1] - 1
            for level in np.unique(depth):
                some = whole[depth == level]
                table_ = self.levels[level]
                least[some] = np.minimum(least[some], np.minimum(table_[first[some]], table_[last[some] - 2**level]))
        return least


def find_runs(codes: np.ndarray, offsets: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least ``least_exponent`` periods (3 or more: then the leftmost root stands twice), by start, then period."""
    empty = np.zeros(0, np.int64)
    if not len(codes):
        return empty, empty, empty
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order, rank = suffix_array(codes, offsets)
    n, found = len(codes), []
    extend = None
    for values in (rank, -rank):
        root_end = next_smaller(values)
        start = np.flatnonzero((codes > 0) & (root_end < n))
        period = root_end[start] - start
        # the leftmost root stands twice in the run: the words a period on are the same, and lie in the same document
        inside = (start + 2 * period <= offsets[document[start] + 1] - 1)
        start, period = start[inside], period[inside]
        same = (codes[start] == codes[start + period]) & (codes[start + period - 1] == codes[start + 2 * period - 1])
        start, period = start[same], period[same]
        if not len(start):
            continue
        extend = extend or Extensions(common_prefixes(codes, order, rank, document), rank)
        right = extend.of(start, start + period)
        start, period, right = (x[right >= period] for x in (start, period, right))
        # the leftmost root of a run: no root of this period ends where it starts
        key = start * (n + 1) + period
        leftmost = ~np.isin((start - period) * (n + 1) + period, key)
        start, period, right = start[leftmost], period[leftmost], right[leftmost]
        # before the leftmost root lies less than a period; the run's first word is found by halving
        low, high = np.maximum(start - period + 1, offsets[document[start]]), start.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            reaches = extend.of(middle, middle + period[open_]) >= start[open_] - middle
            high[open_] = np.where(reaches, middle, high[open_])
            low[open_] = np.where(reaches, low[open_], middle + 1)
        length = start + period + right - low
        kept = length >= np.maximum(least_length, least_exponent * period)
        found.append(np.stack([low[kept], period[kept], length[kept]]))
    if not found:
        return empty, empty, empty
    start, period, length = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, length, period


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the contract takes them: in one document of ten a stretch is made periodic."""
    h = zlib.crc32(str(int(doc_id)).encode()) if doc_id is not None and doc_id == doc_id else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def runs_of(documents: Sequence[list[bytes]], least_length: int = 6, least_exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Of each document its runs (start, length, period) by start, then period."""
    codes, offsets = encoded(documents)
    start, length, period = find_runs(codes, offsets, least_length, least_exponent)
    edges = np.searchsorted(start, offsets)
    rows = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    return [[(s - base, m, q) for s, m, q in rows[low:high]] for base, low, high in zip(offsets[:-1].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _rows(ids: list, texts: list[bytes], alter: bool, whole: bool) -> Iterator[tuple]:
    documents = [altered(t.split(), i) if alter else t.split() for i, t in zip(ids, texts, strict=True)]
    for doc_id, words, runs in zip(ids, documents, runs_of(documents), strict=True):
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        start, length, period = best or (None, None, None)
        text = b" ".join(collapsed(words, runs))
        row = (doc_id, len(runs), start, length, period, 1000 * length // period if best else None)
        if whole:
            yield *row, [{"start": s, "length": m, "period": q} for s, m, q in runs], text.decode()
        else:
            yield *row, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(text).hexdigest()


FIXED = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long"


def _detected(docs: DataFrame, alter: bool, schema: str) -> DataFrame:
    names = [part.split()[0] for part in FIXED.split(", ")] + [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [b"" if t is None else t.encode() for t in frame["text"]]
            ids = [None if pd.isna(i) else int(i) for i in frame["doc_id"]]
            for low, high in by_bytes(texts, BATCH):
                columns = zip(*_rows(ids[low:high], texts[low:high], alter, "runs_sha256" not in names), strict=True)
                yield pd.DataFrame({name: pd.array(c, "Int64") if k < 6 else list(c) for k, (name, c) in enumerate(zip(names, columns, strict=True))})

    return docs.select("doc_id", "text").mapInPandas(run, f"{FIXED}, {schema}")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text) its runs, the strongest of them, and the text with every run collapsed to its first period."""
    return _detected(docs, False, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's runs as digests."""
    return _detected(table(spark, sf_dir, "documents"), True, "runs_sha256 string, collapsed_sha256 string")
