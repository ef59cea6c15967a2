"""Source divergence audit with integer-dictionary encoding.

Texts are counted per task: terms get integers, counts of a group are a bincount over them. The terms that a language keeps
are sorted in the order of their UTF-8 bytes and dealt to tasks by ranges; a stretch of that dictionary is a sorted array in
which the counted terms find their ids by searchsorted, and the counts of all groups are dense vectors over it. Shares,
divergences and the order of equal values come from those vectors; only sums for pairs of sources and each group's best
terms leave a task. All arithmetic is in integers.

Defined results: null text, lang and source are ''; a language that keeps no term gives its pairs the value 0 and no term
rows; a group without terms still has its rows of pairs, a language's only source has none; equal rows are counted each;
null or repeated ids do not matter, as ids are not read; an empty table gives no row; a very long text is counted in
pieces of its own batch, a term of any length is one term; other columns are left unread.

The groups (lang, source) go to every task: the result has a row for every two sources of a language, so they are always
fewer than the square root of its rows. Counts are exact up to 9 * 10**15 terms of a group and 10**9 terms of a dictionary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import ASCII_UPPER, stored, table
from spanforge.llm.hashing import by_bytes

#: Bytes that belong to terms are kept, A-Z lower-cased; all others become blanks.
LETTERS = bytes(c + 32 if chr(c) in ASCII_UPPER else c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
#: Documents of a language in which a term must stand, thousand-millionths of a share, and ranks of terms.
LEAST_DOCS, SCALE_STEPS, TERM_RANKS = 3, 3, 200
#: Counts that a task holds before it hands them on, and entries of a dense matrix.
HELD, DENSE = 4_000_000, 1 << 20


class Tally:
    """Counts of one language's terms by source: ids in a dictionary, a row of occurrences and documents for each source."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.counts: dict[str, np.ndarray] = {}

    def add(self, sources: list[str], texts: list[bytes]) -> None:
        tokens = [t.translate(LETTERS).split() for t in texts]
        flat = np.array([self.ids[w] for words in tokens for w in words], np.int64)
        sizes = [len(words) for words in tokens]
        names = {s: k for k, s in enumerate(dict.fromkeys(sources))}
        group_of = np.array([names[s] for s in sources], np.int64)
        n = max(len(self.ids), 1)
        occurrences = np.bincount(np.repeat(group_of, sizes) * n + flat, minlength=n * len(names))
        in_document = np.unique(np.repeat(np.arange(len(texts)), sizes) * n + flat)
        documents = np.bincount(group_of[in_document // n] * n + in_document % n, minlength=n * len(names))
        for name, k in names.items():
            new = np.stack([x[k * n : k * n + n] for x in (occurrences, documents)])
            old = self.counts.get(name)
            if old is not None:
                new[:, : old.shape[1]] += old
            self.counts[name] = new

    def held(self) -> int:
        return len(self.ids) * (2 + len(self.counts))

    def rows(self, lang: str) -> Iterator[pd.DataFrame]:
        """A row for each source and term, and one without a term for each source."""
        yield pd.DataFrame({"lang": lang, "source": list(self.counts), "term": None, "n": 0, "d": 0})
        terms = sorted(self.ids)
        place = np.array([self.ids[t] for t in terms], np.int64)
        for source, counts in self.counts.items():
            whole = np.zeros((2, len(terms)), np.int64)
            whole[:, : counts.shape[1]] = counts[:, : len(terms)]
            n, d = whole[:, place]
            found = np.flatnonzero(n)
            for low in range(0, len(found), 50_000):
                some = found[low : low + 50_000]
                yield pd.DataFrame({"lang": lang, "source": source, "term": [terms[k].decode() for k in some.tolist()], "n": n[some], "d": d[some]})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, d documents), and a row with a null term for each group; dealt by (lang, term)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies: defaultdict[str, Tally] = defaultdict(Tally)
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                texts, sources = [t.encode() for t in part["text"]], part["source"].tolist()
                for low, high in by_bytes(texts, 2 << 20):
                    tallies[lang].add(sources[low:high], texts[low:high])
            if sum(t.held() for t in tallies.values()) > HELD:
                for lang, tally in tallies.items():
                    yield from tally.rows(lang)
                tallies.clear()
        for lang, tally in tallies.items():
            yield from tally.rows(lang)

    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = plain.mapInPandas(run, "lang string, source string, term string, n long, d long")
    # tasks have summed already; dealt by term, the sums of groups and of documents need no further exchange
    return counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def kept_terms(counts: DataFrame) -> DataFrame:
    """Rows of terms in enough documents of their language, ``first`` for one row of each; rows without a term stay."""
    own = Window.partitionBy("lang", "term")
    placed = counts.select("*", F.sum("d").over(own).alias("in_docs"), (F.row_number().over(own.orderBy("source")) == 1).alias("first"))
    return placed.filter((F.col("in_docs") >= LEAST_DOCS) | F.col("term").isNull()).select("lang", "source", "term", "n", "first")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), by long division in steps of a thousand."""
    if np.any(totals >= (1 << 63) // 1000):
        raise OverflowError("a group has more terms than 64 bits can divide exactly")
    quotient, rest = np.divmod(counts + 1, totals)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, totals)
        quotient = quotient * 1000 + digit
    return quotient + 1


class Groups:
    """The sources of each language, their counts of kept terms, and the language's dictionary size."""

    def __init__(self, rows: list):
        self.sources: dict[str, list[str]] = {}
        self.totals: dict[str, np.ndarray] = {}
        self.terms: dict[str, int] = {}
        by_lang = defaultdict(list)
        for r in rows:
            by_lang[r.lang].append(r)
        for lang, own in by_lang.items():
            own.sort(key=lambda r: r.source)
            self.sources[lang] = [r.source for r in own]
            self.totals[lang] = np.array([r.n for r in own], np.int64)
            self.terms[lang] = sum(r.terms for r in own)


def dense(lang: str, chunk: pd.DataFrame, groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """A stretch of the dictionary in order, and the counts of every source over it."""
    written = chunk["term"].to_numpy(object)
    terms = written[np.concatenate([[True], written[1:] != written[:-1]])]
    ids = np.searchsorted(terms, written)
    rows = pd.Index(groups.sources[lang]).get_indexer(chunk["source"])
    counts = np.zeros((len(groups.sources[lang]), len(terms)), np.int64)
    counts[rows, ids] = chunk["n"].to_numpy()
    return terms, counts


def divergences(lang: str, chunk: pd.DataFrame, groups: Groups) -> tuple[Iterator[tuple[int, np.ndarray]], Iterator[pd.DataFrame]]:
    """For each source its sums against all sources of the language over a stretch of the dictionary, and its best terms there."""
    terms, counts = dense(lang, chunk, groups)
    v, totals = groups.terms[lang], groups.totals[lang]
    p = shares(counts, totals[:, None] + v)
    q = shares(counts.sum(axis=0), totals.sum() + v)

    def pairs() -> Iterator[tuple[int, np.ndarray]]:
        for k, own in enumerate(p):
            apart = own - p
            yield k, (apart * apart // p).sum(axis=1)

    def best() -> Iterator[pd.DataFrame]:
        for k, source in enumerate(groups.sources[lang]):
            ids = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            value = (p[k][ids] - q[ids]) ** 2 // q[ids]
            top = np.argsort(-value, kind="stable")[:TERM_RANKS]  # ids are in the order of the terms
            if len(top):
                yield pd.DataFrame({"lang": lang, "source": source, "part": "term", "item": terms[ids[top]], "value": value[top]})

    return pairs(), best()


def _chunks(frames: Iterator[pd.DataFrame], groups: Groups) -> Iterator[tuple[str, pd.DataFrame]]:
    """Stretches of sorted rows: of one language, of about as many terms as make a dense matrix of DENSE entries, no term in two."""
    rest = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        while len(rest):
            lang = rest["lang"].iat[0]
            own = int((rest["lang"] == lang).sum())
            new = rest["term"].iloc[:own].ne(rest["term"].iloc[:own].shift())
            most = max(1, DENSE // len(groups.sources[lang]))
            ends = np.flatnonzero(new)
            if len(ends) > most:
                end = int(ends[most])
            elif own < len(rest):
                end = own
            else:
                break
            yield lang, rest.iloc[:end]
            rest = rest.iloc[end:]
    if rest is not None and len(rest):
        yield rest["lang"].iat[0], rest


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from the other sources of its language and its most typical terms."""
    spark = docs.sparkSession
    kept = stored(kept_terms(term_counts(docs)), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum((F.col("first") & F.col("term").isNotNull()).cast("long")).alias("terms"))
    groups = stored(sums, "groups")
    shared = spark.sparkContext.broadcast(Groups(groups.collect()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums, summed = shared.value, {}, None

        def handed(lang: str) -> Iterator[pd.DataFrame]:
            names = np.array(own.sources[lang], object)
            for k in sorted(sums):
                others = np.arange(len(names)) != k
                yield pd.DataFrame({"lang": lang, "source": names[k], "part": "pair", "item": names[others], "value": sums[k][others]})
            sums.clear()

        for lang, chunk in _chunks(frames, own):
            if summed not in (None, lang):
                yield from handed(summed)
            summed = lang
            pairs, best = divergences(lang, chunk, own)
            for k, values in pairs:
                sums[k] = sums[k] + values if k in sums else values
                if len(values) ** 2 > DENSE:  # too many pairs to hold them for the next stretch
                    yield from handed(lang)
            yield from best
        if summed is not None:
            yield from handed(summed)

    ranges = kept.filter("term IS NOT NULL").select("lang", "term", "source", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    found = stored(ranges.mapInPandas(run, "lang string, source string, part string, item string, value long"), "divergences")
    without = groups.join(groups.groupBy("lang").agg(F.sum("terms").alias("all_terms")).filter("all_terms = 0"), "lang").select("lang", "source")
    zeros = without.join(without.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = found.filter("part = 'pair'").select("lang", "source", "item", "value").unionAll(zeros).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [
        pairs.withColumn("part", F.lit("pair")).withColumn("rank", place),
        found.filter("part = 'term'").withColumn("rank", place).filter(F.col("rank") <= TERM_RANKS),
    ]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(*columns).unionAll(ranked[1].select(*columns))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
    WITH docs AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
    counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    totals AS (SELECT lang, source, sum(n) AS n FROM counted GROUP BY lang, source),
    p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + v) AS p
      FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counted c USING (lang, source, term) LEFT JOIN totals t USING (lang, source)),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(all_n) + any_value(v)) AS q
      FROM p JOIN sizes USING (lang) JOIN (SELECT lang, sum(n) AS all_n FROM totals GROUP BY lang) USING (lang) GROUP BY lang, term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
