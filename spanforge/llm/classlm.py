"""Brown class-based n-gram scoring.

Exchange clustering puts words into classes so that class bigrams predict best. A text's probability is the product, over
its tokens, of the class transition and of the word's emission from its class, both smoothed:

    P(w | v) = P(class(w) | class(v)) * (c(w) + 1) / (c(class) + types(class) + 1)

where the last term keeps one unseen word's share for every class. Words are counted over all training texts. Exchange
clustering moves HEAD frequent words and SHAPES word endings (the last two bytes) between the classes over the bigrams of
all training texts. Then every other word of the dictionary gets the class under which its own neighbours, counted over
all training texts, are likeliest, and so does every ending beyond the SHAPES by the neighbours of the words outside the
dictionary that have it; words outside it, seen or not, have their ending's class. Transitions and class sizes
are counted with these classes. The dictionary holds the most frequent words, one in SHARE of all but DICTIONARY at least
and MOST_WORDS at most; it goes to every task.

The counts of words outside the dictionary are joined by shuffle, so the score of every token uses its own count whatever
the vocabulary's size.

Defined results: a null, empty or blank text is its end token alone; equal rows are scored and counted each; rows with a
null id are held out; with nothing to learn from every token has probability 1; a word with equally good classes goes to
the first of them; a very long text is one row and is counted and scored whole; only doc_id, text and held_out are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import fold, stored, table
from spanforge.llm.hashing import WHITE, U, by_bytes, prefix_hash, substring_hash

HEAD, SHAPES, CLASSES = 1024, 510, 64
DICTIONARY, SHARE, MOST_WORDS = 200_000, 8, 2_000_000
#: Words whose neighbours one task adds up.
TOGETHER = 4_000
ROUNDS = 6
#: The end token's hash and last two bytes; no word has these bytes.
END, END_SHAPE = 0, 0x2020
PRIOR = 5.0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and last two bytes of every text's tokens, its end token last, and the n+1 offsets."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    white = WHITE[data]
    before = np.concatenate([[True], white[:-1]])
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
    hashes = substring_hash(prefix_hash(data), starts, ends)
    hashes[hashes == END] = U(1)
    shapes = data[ends - 1].astype(np.int64)
    shapes |= np.where(ends - starts > 1, data[ends - 2], 0).astype(np.int64) << 8
    offsets = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    stops = offsets[1:]
    return np.insert(hashes, stops, U(END)), np.insert(shapes, stops, END_SHAPE), offsets + np.arange(len(offsets))


def _batches(frames: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    for frame in frames:
        texts = ["" if t is None else t for t in frame[column]]
        for low, high in by_bytes(texts, 1 << 20):
            yield frame.iloc[low:high], [t.encode().lower() for t in texts[low:high]]


def word_counts(training: DataFrame) -> DataFrame:
    """(h, shape, c) of every word of (text) rows; each task sends its batches' sums."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, texts in _batches(frames, "text"):
            hashes, shapes, _ = tokens(texts)
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            yield pd.DataFrame({"h": found.view(np.int64), "shape": shapes[first].astype(np.int32), "c": n})

    each = training.select("text").mapInPandas(count, "h long, shape int, c long")
    return each.groupBy("h").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Items:
    """Which item a token is: frequent words by hash (sorted), the others by shape."""

    hashes: np.ndarray
    shapes: np.ndarray  # 65,536 item numbers

    @property
    def rest(self) -> np.ndarray:
        """Which endings have no item of their own."""
        return self.shapes == HEAD + SHAPES + 1

    @property
    def n(self) -> int:
        return HEAD + SHAPES + 2

    def of(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, self.shapes[shapes])


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """(h, shape, c) of up to ``most`` words, most frequent first: all above a count that a histogram finds, and of the count
    where they end those of the smallest hashes, so nothing else is sent."""
    bins = counts.groupBy(F.floor(F.log2("c") * 64).alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
    total, whole, part = 0, None, None
    for row in bins:
        if total + row.n > most:
            part = row["bin"]
            break
        total, whole = total + row.n, row["bin"]
    own, wanted, found = F.floor(F.log2("c") * 64), counts.select("h", "shape", "c"), []
    if whole is not None:
        found.append(wanted.filter(own >= whole).toPandas())
    if part is not None and total < most:
        found.append(wanted.filter(own == part).orderBy(F.desc("c"), "h").limit(most - total).toPandas())
    none = pd.DataFrame({"h": np.zeros(0, np.int64), "shape": np.zeros(0, np.int32), "c": np.zeros(0, np.int64)})
    return pd.concat(found or [none], ignore_index=True).sort_values(["c", "h"], ascending=[False, True])


def choose_items(counts: DataFrame, frequent: pd.DataFrame) -> Items:
    words = frequent["h"].to_numpy(np.int64).view(np.uint64)
    words = words[words != U(END)]  # the end is an item of its own
    head = np.sort(words[:HEAD]) if len(words) else np.array([1], np.uint64)
    common = counts.filter(F.col("h") != END).groupBy("shape").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "shape").limit(SHAPES).collect()
    shapes = np.full(1 << 16, HEAD + SHAPES + 1, np.int64)
    for k, row in enumerate(common):
        shapes[row["shape"]] = HEAD + k
    shapes[END_SHAPE] = HEAD + SHAPES
    return Items(head, shapes)


def bigram_counts(training: DataFrame, items: Items) -> np.ndarray:
    """Counts of item after item over all training texts, an end token before each text; a table of bounded size."""
    shared, n, slices = training.sparkSession.sparkContext.broadcast(items), items.n, 48

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total = shared.value, np.zeros(n * n, np.int64)
        for _, texts in _batches(frames, "text"):
            hashes, shapes, offsets = tokens(texts)
            now = own.of(hashes, shapes)
            # the token before a text's first is the end token of the text before it
            last = np.concatenate([[own.shapes[END_SHAPE]], now[:-1]])
            pairs, times = np.unique(last * n + now, return_counts=True)
            total[pairs] += times
        for k, part in enumerate(np.array_split(total, slices)):
            at = np.flatnonzero(part)
            if len(at):
                yield pd.DataFrame({"slice": [k], "at": [at.astype(np.int32).tobytes()], "n": [part[at].tobytes()]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        k = int(part["slice"].iat[0])
        total = np.zeros(len(np.array_split(np.empty(n * n, np.bool_), slices)[k]), np.int64)
        for at, times in zip(part["at"], part["n"], strict=True):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(times, np.int64)
        at = np.flatnonzero(total)
        return pd.DataFrame({"slice": [k], "at": [at.astype(np.int32).tobytes()], "n": [total[at].tobytes()]})

    schema = "slice int, at binary, n binary"
    table_ = np.zeros(n * n, np.int64)
    parts = np.array_split(table_, slices)  # views
    for row in training.select("text").mapInPandas(count, schema).groupBy("slice").applyInPandas(add, schema).toLocalIterator():
        parts[row.slice][np.frombuffer(row.at, np.int32)] = np.frombuffer(row.n, np.int64)
    return table_.reshape(n, n)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each item: each item in turn moves to the class that gives the training bigrams most likelihood.

    With N(a, b) the class bigrams, the likelihood is the sum of N log N over them, less those of the class sums before
    and after; a move changes the rows and columns of two classes only. The end token keeps a class to itself.
    """
    n, end = len(bigrams), HEAD + SHAPES
    mass = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = [int(i) for i in np.argsort(-mass, kind="stable") if i != end and mass[i]]
    own = np.zeros(n, np.int64)
    for k, item in enumerate(order):
        own[item] = k % (classes - 1)
    own[end] = classes - 1
    one = np.zeros((n, classes))
    one[np.arange(n), own] = 1
    after, before = bigrams @ one, bigrams.T.astype(float) @ one  # item -> class, class -> item
    joint = one.T @ after

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    free = np.arange(classes - 1)
    for _ in range(rounds):
        moved = 0
        for item in order:
            old = own[item]
            out, into, self_ = after[item].copy(), before[item].copy(), float(bigrams[item, item])
            # counts without the item
            out[old] -= self_
            into[old] -= self_
            joint[old] -= out
            joint[:, old] -= into
            joint[old, old] -= self_
            rows, columns = joint.sum(axis=1), joint.sum(axis=0)
            gain = h(joint[free] + out).sum(axis=1) - h(joint[free]).sum(axis=1)
            gain += (h(joint[:, free] + into[:, None]) - h(joint[:, free])).sum(axis=0)
            corner = joint[free, free]
            gain += h(corner + out[free] + into[free] + self_) - h(corner + out[free]) - h(corner + into[free]) + h(corner)
            out_sum, into_sum = out.sum() + self_, into.sum() + self_
            gain -= h(rows[free] + out_sum) - h(rows[free]) + h(columns[free] + into_sum) - h(columns[free])
            new = int(free[gain.argmax()])
            joint[new] += out
            joint[:, new] += into
            joint[new, new] += self_
            if new != old:
                moved += 1
                own[item] = new
                after[:, old] -= bigrams[:, item]
                after[:, new] += bigrams[:, item]
                before[:, old] -= bigrams[item]
                before[:, new] += bigrams[item]
        if not moved:
            break
    return own


@dataclass
class Classes:
    """The class of every token: dictionary words by hash (sorted), all others by shape."""

    words: np.ndarray
    of_word: np.ndarray
    of_shape: np.ndarray  # 65,536 classes

    def of(self, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, places in the dictionary, and whether the words are there."""
        if not len(self.words):
            return self.of_shape[shapes], np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        found = self.words[at] == hashes
        return np.where(found, self.of_word[at], self.of_shape[shapes]), at, found


@dataclass
class Model:
    classes: Classes
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 of each class's denominator
    counts: np.ndarray  # of the dictionary's words
    total: int
    types: int


def before(classes: np.ndarray) -> np.ndarray:
    """The class before each token; before a text's first that is the end's, which ends the text before it."""
    return np.concatenate([[CLASSES - 1], classes[:-1]])


def smoothed(joint: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) of class bigrams."""
    prior = (joint.sum(axis=0) + 1) / (joint.sum() + CLASSES)
    return np.log10((joint + PRIOR * prior) / (joint.sum(axis=1, keepdims=True) + PRIOR))


def class_sizes(counts: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""
    shared = counts.sparkSession.sparkContext.broadcast(classes)

    def by_class(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            k, _, _ = shared.value.of(frame["h"].to_numpy(np.int64).view(np.uint64), frame["shape"].to_numpy(np.int64))
            yield pd.DataFrame({"k": np.arange(CLASSES), "c": np.bincount(k, frame["c"].to_numpy(float), CLASSES).astype(np.int64), "n": np.bincount(k, minlength=CLASSES)})

    size, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in counts.mapInPandas(by_class, "k int, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        size[row.k], types[row.k] = row.c, row.n
    return size, types


def class_bigrams(training: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of class after class over all training texts."""
    shared = training.sparkSession.sparkContext.broadcast(classes)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for _, texts in _batches(frames, "text"):
            hashes, shapes, _ = tokens(texts)
            now, _, _ = shared.value.of(hashes, shapes)
            total += np.bincount(before(now) * CLASSES + now, minlength=CLASSES * CLASSES)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    joint = np.zeros(CLASSES * CLASSES, np.int64)
    for row in training.select("text").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        joint[row["at"]] = row.n
    return joint.reshape(CLASSES, CLASSES)


def likeliest(training: DataFrame, classes: Classes, fixed: np.ndarray, transition: np.ndarray, size: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """The class of every dictionary word: for those not ``fixed`` that under which its neighbours in the training texts, and
    its emission, are likeliest; the end's class is left to the end. With ``rest``, a mark for each of the 65,536 endings, the
    classes of all endings follow those of the words: a marked one's is chosen alike, by the words outside the dictionary
    that have it."""
    n_words, n = len(classes.words), 2 * CLASSES
    shared = training.sparkSession.sparkContext.broadcast((classes, fixed if n_words else np.ones(1, bool), np.zeros(1 << 16, bool) if rest is None else rest))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kept, open_ = shared.value
        for _, texts in _batches(frames, "text"):
            hashes, shapes, _ = tokens(texts)
            now, at, found = own.of(hashes, shapes)
            free = np.flatnonzero(np.where(found, ~kept[at], open_[shapes]))  # never the end, so each has a next token
            number = np.where(found, at, n_words + shapes)[free]
            pairs = np.concatenate([number * n + before(now)[free], number * n + CLASSES + now[np.minimum(free + 1, len(now) - 1)]])
            pairs, times = np.unique(pairs, return_counts=True)
            yield pd.DataFrame({"pair": pairs, "n": times})

    pairs = training.select("text").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    per_class = np.log10(size + 1)
    likelihood = np.concatenate([transition, transition.T])  # by class before, then by class behind

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        word, near = np.divmod(frame["pair"].to_numpy(np.int64), n)
        low = word.min() // TOGETHER * TOGETHER
        table_ = np.zeros((TOGETHER, n))
        table_[word - low, near] = frame["n"].to_numpy(float)
        value = table_ @ likelihood - table_[:, :CLASSES].sum(axis=1)[:, None] * per_class
        own = np.unique(word)
        return pd.DataFrame({"word": own, "k": value[own - low, : CLASSES - 1].argmax(axis=1)})

    grouped = pairs.withColumn("part", F.floor(F.col("pair") / (n * TOGETHER))).groupBy("part")
    out = np.concatenate([classes.of_word, classes.of_shape])
    found = grouped.applyInPandas(choose, "word long, k int").toPandas()  # a row for each word of the dictionary and each ending at most
    out[found["word"].to_numpy()] = found["k"].to_numpy()
    return out[:n_words] if rest is None else out


def train(training: DataFrame, counts: DataFrame) -> Model:
    """A model from (text) rows and their stored ``word_counts``."""
    totals = counts.agg(F.sum("c").alias("c"), F.count("*").alias("n")).first()
    frequent = most_frequent(counts, min(MOST_WORDS, max(DICTIONARY, totals.n // SHARE)))
    items = choose_items(counts, frequent)
    bigrams = bigram_counts(training, items)
    of_item = exchange(bigrams)
    words = frequent["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, numbers, shapes = words[order], frequent["c"].to_numpy(np.int64)[order], frequent["shape"].to_numpy(np.int64)[order]
    item = items.of(words, shapes)
    classes = Classes(words, of_item[item], of_item[items.shapes])
    one = np.zeros((items.n, CLASSES))
    one[np.arange(items.n), of_item] = 1
    first = smoothed(one.T @ bigrams @ one)
    size, _ = class_sizes(counts, classes)
    # the end stays by itself; the clustered words keep their classes
    chosen = likeliest(training, classes, (item < HEAD) | (words == U(END)), first, size, items.rest)
    classes = Classes(words, chosen[: len(words)], chosen[len(words) :])
    size, types = class_sizes(counts, classes)
    transition = smoothed(class_bigrams(training, classes))
    return Model(classes, transition if totals.n else transition * 0, np.log10(size + types + 1), numbers, totals.c or 0, totals.n)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to (doc_id, held_out, text) rows; the text goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_total, n_types, complete = model.total, model.types, model.types <= len(model.counts)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own, row = shared.value, TaskContext.get().partitionId() << 36
        counted = own.counts if len(own.counts) else np.zeros(1, np.int64)
        for frame, texts in _batches(frames, "text"):
            hashes, shapes, offsets = tokens(texts)
            classes, at, found = own.classes.of(hashes, shapes)
            steps = own.transition[before(classes), classes] - own.emission[classes]
            logs = np.where(found, np.log10(counted[at] + 1), 0.0)
            starts, open_ = offsets[:-1], ~found
            rest = [] if complete else [x.view(np.int64) for x in np.split(hashes[open_], np.cumsum(np.add.reduceat(open_.astype(np.int64), starts))[:-1])]
            yield pd.DataFrame({
                "row_id": row + np.arange(len(texts)), "doc_id": frame["doc_id"].array, "held_out": frame["held_out"].array, "n_tokens": np.diff(offsets), "known": np.add.reduceat((found & (counted[at] > 0)).astype(np.int64), starts),
                "logs": np.add.reduceat(logs, starts), "steps": np.add.reduceat(steps, starts), "rest": rest if rest else [None] * len(texts),
            })
            row += len(texts)

    schema = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, logs double, steps double, rest array<long>"
    walked = stored(docs.select("doc_id", "held_out", "text").mapInPandas(walk, schema), "walked")
    rare = walked.select("row_id", F.explode("rest").alias("h")).join(counts.select("h", "c"), "h")
    rare = rare.groupBy("row_id").agg(F.sum(F.log10(F.col("c") + 1)).alias("more_logs"), F.count("*").alias("more_known"))
    joined = walked.drop("rest").join(rare, "row_id", "left").fillna({"more_logs": 0.0, "more_known": 0})
    logs = F.col("logs") + F.col("more_logs")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(n_total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n_total + n_types + 1))).alias("base_score"), (logs + F.col("steps")).alias("score"),
    )


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(fold("doc_id", 7) == 2, F.lit(True)))
    training = docs.filter("NOT held_out").select("text")
    counts = stored(word_counts(training), "word-counts")
    return score(docs, train(training, counts), counts)
