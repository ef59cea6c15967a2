"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, other). Small transducers, one for each concern,
are composed into one machine; walking a clause through it multiplies each insult's or threat's weight by what its
context says: aimed at someone, negated, reported. A clause with a threat is first walked backwards, by a machine that
marks threats whose target stands behind them. A text's score joins its clauses' scores by noisy or. Insults and
their weights are learned from labelled texts, word by word and by word beginnings; the other lists are fixed.

Defined results: a null, empty or blank text scores 0; texts are scored whole; equal texts get equal scores; labels
without a value are not learned from, a document with several labels counts as toxic if any says so; with nothing
learned only the fixed lists count; ids only choose the fold.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import fold, table

#: Labelled texts learned from, at most about (chosen by a hash of the text); words and beginnings kept, at most.
SAMPLE_DOCS, WORDS_KEPT, BEGINNINGS_KEPT = 24_000, 4_000, 1_000
BEGINNING_SIZES = (4, 5, 6)
REJECT = 0.3

# fixed values
THREATS = "kill hurt destroy burn shoot stab hang töten umbringen vernichten verletzen tuer détruire brûler frapper matar destruir quemar golpear".split()
TARGETS = "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't nicht kein keine niemals ne pas jamais aucun nunca jamás ni".split()
REPORTS = "said says say told quoted wrote claimed alleged sagte sagt behauptete schrieb dit disait déclare écrit dijo dice afirmó escribió".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, AIMED = "ITYNR.t"
Arc = tuple[int, str, float]


@dataclass(frozen=True)
class Transducer:
    """Deterministic; an arc gives the next state, the symbol written and a factor. Without an arc: stay, copy, 1."""

    arcs: dict[tuple[int, str], Arc] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> Arc:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def compose(first: Transducer, second: Transducer, symbols: str = "ITYNR.it") -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``; only reachable pairs become states."""
    numbers, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        pair = todo.pop()
        for symbol in symbols:
            a, middle, x = first.step(pair[0], symbol)
            b, out, y = second.step(pair[1], middle)
            if (a, b) not in numbers:
                numbers[a, b] = len(numbers)
                todo.append((a, b))
            arcs[numbers[pair], symbol] = (numbers[a, b], out, x * y)
    return Transducer(arcs)


def negation(reach: int = 3, factor: float = 0.5) -> Transducer:
    """An insult or threat within ``reach`` words of a negation is weakened."""
    arcs: dict[tuple[int, str], Arc] = {(s, NEGATION): (reach, NEGATION, 1.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x, factor if x in (INSULT, THREAT, AIMED) else 1.0) for x in (INSULT, THREAT, AIMED, TARGET, REPORT, OTHER)}
    return Transducer(arcs)


def reported(factor: float = 0.6) -> Transducer:
    """What follows a verb of saying in its clause is someone else's."""
    return Transducer({(0, REPORT): (1, REPORT, 1.0)} | {(1, x): (1, x, factor) for x in (INSULT, THREAT, AIMED)})


def ahead() -> Transducer:
    """Read from a clause's end: a threat before someone is addressed is aimed."""
    return Transducer({(0, TARGET): (1, TARGET, 1.0), (1, THREAT): (1, AIMED, 1.0)})


def target(factor: float = 1.25) -> Transducer:
    """After someone is addressed an insult or a threat is aimed; written as small letters. A threat may be aimed already."""
    return Transducer({(0, TARGET): (1, TARGET, 1.0), (1, INSULT): (1, "i", factor), (1, THREAT): (1, AIMED, 1.0)})


def insult(base: float = 0.8) -> Transducer:
    return Transducer({(0, x): (0, x, base) for x in "Ii"})


def threat(aimed: float = 0.5, loose: float = 0.02) -> Transducer:
    return Transducer({(0, AIMED): (0, AIMED, aimed), (0, THREAT): (0, THREAT, loose)})


def grammar() -> Transducer:
    machine = negation()
    for part in (reported(), target(), insult(), threat()):
        machine = compose(machine, part)
    return machine


@dataclass
class Lexicon:
    words: dict[str, float]
    beginnings: dict[str, float]

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in BEGINNING_SIZES:
            best = max(best, self.beginnings.get(word[:n], 0.0)) if len(word) > n else best
        return best


FIXED = dict.fromkeys(THREATS, THREAT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)


class Scorer:
    def __init__(self, lexicon: Lexicon, machine: Transducer):
        self.lexicon, self.machine = lexicon, machine
        self.ahead = ahead()
        self.seen: dict[str, float] = {}

    def insult_weight(self, word: str) -> float:
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[word] = self.lexicon.weight(word)
        return known

    def look_ahead(self, symbols: list[str]) -> list[str]:
        """The symbols with what a walk from the clause's end says."""
        state, marked = 0, []
        for symbol in reversed(symbols):
            state, out, _ = self.ahead.step(state, symbol)
            marked.append(out)
        return marked[::-1]

    def clauses(self, text: str) -> Iterator[tuple[str, float]]:
        """Clauses with an insult or a threat, and their scores."""
        weigh = self.insult_weight
        hot = [w for w in {*WORD.findall(text)} if weigh(w) > 0 or FIXED.get(w) == THREAT]
        if not hot:
            return
        for clause in CLAUSE.split(text):
            if not any(w in clause for w in hot):
                continue
            state, calm = 0, 1.0
            words = WORD.findall(clause)
            owns = [weigh(word) for word in words]
            symbols = [INSULT if own > 0 else FIXED.get(word, OTHER) for word, own in zip(words, owns, strict=True)]
            if THREAT in symbols:
                symbols = self.look_ahead(symbols)
            for own, symbol in zip(owns, symbols, strict=True):
                state, out, factor = self.machine.step(state, symbol)
                if out in "IiTt":
                    calm *= 1 - min(0.99, factor * (own or 1.0))
            if calm < 1:
                yield clause, 1 - calm

    def score(self, text: str | None) -> float:
        calm = 1.0
        for _, own in self.clauses((text or "").lower()):
            calm *= 1 - own
        return 1 - calm


def learn(texts: DataFrame) -> Lexicon:
    """Weights from rows (text, toxic 0/1).

    Texts are counted by the least hash of their longer words, so that a toxic text and its near copies count about once.
    A word is kept if nine in ten of the texts that it occurs in are toxic and chance would not give that to any word of
    the vocabulary; its weight is the share of toxic, with one clean text assumed.
    """
    known = texts.filter("text IS NOT NULL AND toxic IS NOT NULL")
    share = min(1.0, SAMPLE_DOCS / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("text", F.col("toxic").cast("int").alias("toxic"))

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                found = {*WORD.findall(text.lower())}
                kind = min((zlib.crc32(w.encode()) for w in found if len(w) > 5), default=0)
                rows += [(w, int(toxic), kind) for w in found | {""}]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["word", "toxic", "kind"])
                    rows = []
            yield pd.DataFrame(rows, columns=["word", "toxic", "kind"])

    each = sample.mapInPandas(words, "word string, toxic int, kind long").distinct()
    counts = each.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    counts = counts.filter("bad > 0 OR word = ''").persist()
    total = counts.filter("word = ''").first()
    if total is None or not total.bad:
        counts.unpersist()
        return Lexicon({}, {})
    base = min(0.9, total.bad / (total.bad + total.good))
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    # log-likelihood ratio of the word's own share of toxic texts against the share of all
    surprise = F.col("bad") * F.log(share / base) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    weight = F.col("bad") / (F.col("bad") + F.col("good") + 1)

    def chosen(rows: DataFrame, n: int) -> DataFrame:
        return rows.filter((share >= 0.9) & (surprise >= math.log(20 * max(1, n)))).withColumn("weight", weight)

    single = chosen(counts.filter("word <> ''"), counts.count()).orderBy(F.desc("weight"), "word").limit(WORDS_KEPT)
    single = {r.word: r.weight for r in single.collect()}
    counts.unpersist()
    # beginnings need the clean counts of all words
    heads = each.filter("word <> ''").select("word", "toxic", "kind", F.explode(F.array(*map(F.lit, BEGINNING_SIZES))).alias("n")).filter(F.length("word") > F.col("n"))
    heads = heads.withColumn("head", F.left("word", F.col("n"))).groupBy("head").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("word"))).alias("kinds")
    )
    heads = heads.filter("kinds >= 3").persist()
    begin = chosen(heads, heads.count()).orderBy(F.desc("weight"), "head").limit(BEGINNINGS_KEPT)
    rows = {r["head"]: r for r in begin.collect()}
    # a beginning whose texts are nearly all those of a longer one is no evidence of its own
    begin = {h: r.weight for h, r in rows.items() if not any(o != h and o.startswith(h) and rows[o].bad >= 0.9 * r.bad for o in rows)}
    heads.unpersist()
    return Lexicon(single, begin)


def score_column(spark: SparkSession, lexicon: Lexicon, text: str = "text") -> Column:
    """The score of a text column."""
    shared = spark.sparkContext.broadcast((lexicon, grammar()))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return score(F.col(text))


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Add score and predicted to rows with ``text``; columns of these names are replaced."""
    return docs.withColumn("score", score_column(docs.sparkSession, lexicon)).withColumn("predicted", F.when(F.col("score") >= REJECT, 1).otherwise(0))


def clean_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without the rows that score REJECT or more."""
    return docs.filter(score_column(docs.sparkSession, lexicon) < REJECT)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold."""
    marks = labels.filter((fold("doc_id", 4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(marks, "doc_id").select("text", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score_texts(docs, lexicon)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", "predicted")
