"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of the rows; every row is put into its leaf. A query walks the tree best bin first:
it goes down to the nearest leaf and keeps the branches not taken in a priority queue, from which it goes on, until it has
visited as many leaves as calibration found necessary. Calibration compares a bounded set of queries with brute force over
all rows and widens the visits until their recall is reached.

Nearness is the largest inner product. Vectors are therefore put on a common sphere for the tree: one more component
makes all norms equal, so that the nearest in distance is the largest product.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part;
rows with equal ids are separate candidates, but one query (the least vector), and none is a candidate of its own id; ties
go to the smaller vec_id; a query visits leaves until they hold k other rows, so it gets k, or all candidates if there are
fewer; shorter vectors end in zeros; an empty table gives no rows; only vec_id and embedding are read, whatever else a
table has and however it is named.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import stored, table
from spanforge.llm.vectors import best, even, matrix, query_blocks, usable

#: Rows of the sample that the tree is fitted on: all up to SAMPLE, then one in SHARE, at most MOST, so that the tree grows
#: with the table; children of a node; sample rows in a leaf.
SAMPLE, SHARE, MOST, BRANCHES, LEAF = 20_000, 100, 120_000, 8, 48
#: Queries for calibration, and the recall to reach on them.
CALIBRATION, RECALL = 128, 0.95
#: Queries, and rows of neighbouring leaves, that meet at once; larger leaves are split.
BLOCK, CELL = 2_048, 8_192


@dataclass
class Tree:
    """Nodes in arrays: ``children[node]`` are node numbers, empty for a leaf; ``leaf[node]`` is its leaf number or -1."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    norm: float  # the squared norm that all vectors are lifted to

    @property
    def leaves(self) -> int:
        return int(self.leaf.max(initial=-1)) + 1

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Rows with the component that makes their norms equal; longer rows than the sample's longest get none."""
        return np.hstack([vectors, np.sqrt(np.maximum(self.norm - (vectors**2).sum(axis=1), 0))[:, None]])

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node."""
        lifted, out = self.lift(vectors), np.empty(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf[node]
                continue
            near = nearest(lifted[rows], self.centres[kids])
            todo += [(int(kid), rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of queries, put on the sphere, to all centres, less the queries' own norm."""
        length = np.maximum(np.sqrt((queries**2).sum(axis=1)), 1e-300)[:, None]
        lifted = np.hstack([queries / length * np.sqrt(self.norm), np.zeros((len(queries), 1))])
        return (self.centres**2).sum(axis=1) - 2 * lifted @ self.centres.T

    def visits(self, queries: np.ndarray, most: int, sizes: np.ndarray | None = None, least: np.ndarray | None = None) -> list[list[int]]:
        """For each query its leaves in best-bin-first order: ``most``, and more until they hold ``least`` rows by ``sizes``."""
        kids_of, leaf = [k.tolist() for k in self.children], self.leaf.tolist()
        rows_in = np.zeros(self.leaves, np.int64) if sizes is None else sizes
        out = []
        for q, far in enumerate(self.distances(queries).tolist()):
            queue, found, wanted, held = [(0.0, 0)], [], 0 if least is None else int(least[q]), 0
            while queue and (len(found) < most or held < wanted):
                _, node = heapq.heappop(queue)
                while kids := kids_of[node]:
                    first = min(kids, key=far.__getitem__)
                    for kid in kids:
                        if kid != first:
                            heapq.heappush(queue, (far[kid], kid))
                    node = first
                found.append(leaf[node])
                held += int(rows_in[found[-1]])
            out.append(found)
        return out


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    own = nearest(rows, centres)
    for _ in range(rounds):
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        again = nearest(rows, centres)
        if (again == own).all():
            break
        own = again
    return centres, own


def fit(sample: np.ndarray, seed: int = 11) -> Tree:
    """A tree over the distinct rows of a bounded sample."""
    rng, distinct = np.random.default_rng(seed), np.unique(sample, axis=0)
    tree = Tree(np.zeros((1, distinct.shape[1] + 1)), [np.zeros(0, int)], np.full(1, -1), float((distinct**2).sum(axis=1).max(initial=0)))
    lifted = tree.lift(distinct)
    centres, leaf, todo, leaves = [lifted.mean(axis=0)], [-1], [(0, np.arange(len(lifted)))], 0
    while todo:
        node, rows = todo.pop()
        if len(rows) > LEAF:
            middle, own = k_means(lifted[rows], min(BRANCHES, len(rows)), rng)
            used = np.unique(own)
            if len(used) > 1:
                tree.children[node] = np.arange(len(centres), len(centres) + len(used))
                for k in used:
                    todo.append((len(centres), rows[own == k]))
                    centres.append(middle[k])
                    leaf.append(-1)
                    tree.children.append(np.zeros(0, int))
                continue
        leaf[node] = leaves
        leaves += 1
    tree.centres, tree.leaf = np.array(centres), np.array(leaf)
    return tree


def exact_scores(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products summed in one order, so that equal vectors have equal scores wherever they stand."""
    return (candidates * query).sum(axis=1)


def _top(query_id: int, query: np.ndarray, ids: np.ndarray, candidates: np.ndarray, rough: np.ndarray, k: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best; ``rough`` are their matrix products, ``rows`` their rows of ``candidates`` if not all."""
    other = np.flatnonzero(ids != query_id)
    ids, rough, rows = ids[other], rough[other], other if rows is None else rows[other]
    if len(rough) > k:
        floor = np.partition(rough, len(rough) - k)[len(rough) - k]
        kept = np.flatnonzero(rough >= floor - 1e-9 * max(1.0, abs(floor)))
        if len(kept) > 8 * k:  # a tie of many copies: the smallest ids of each vector are enough
            _, same = np.unique(candidates[rows[kept]], axis=0, return_inverse=True)
            order = np.lexsort((ids[kept], same.ravel()))
            ordered = same.ravel()[order]
            place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
            kept = kept[order[place < k]]
    else:
        kept = np.arange(len(rough))
    scores = exact_scores(query, candidates[rows[kept]])
    at = best(scores, ids[kept], k)
    return ids[kept][at], scores[at]


def brute_force(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_ids, scores) of a bounded set of queries over all rows, block by block."""
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, queries))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_ids, own = shared.value
        for frame in frames:
            for start in range(0, len(frame), BLOCK):
                part = frame.iloc[start : start + BLOCK]
                ids, candidates = part["vec_id"].to_numpy(np.int64), matrix(part["embedding"])
                rough = own @ candidates.T
                rows = [(int(i), *_top(int(i), q, ids, candidates, r, k)) for i, q, r in zip(own_ids, own, rough, strict=True)]
                yield pd.DataFrame(rows, columns=["query_id", "vec_ids", "scores"])

    found = vectors.mapInPandas(local, "query_id long, vec_ids array<long>, scores array<double>")
    return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best over a query's partial lists; a list has k entries at most, and there is one for each block visited."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        ids, scores = np.concatenate(part["vec_ids"].tolist()), np.concatenate(part["scores"].tolist())
        at = best(scores, ids, k)
        return pd.DataFrame({"query_id": [part["query_id"].iat[0]], "vec_ids": [ids[at]], "scores": [scores[at]]})

    return found.groupBy("query_id").applyInPandas(merge, "query_id long, vec_ids array<long>, scores array<double>")


@dataclass
class Index:
    tree: Tree
    rows: DataFrame  # (vec_id, embedding, leaf)
    sizes: np.ndarray  # rows in each leaf
    visits: int
    recall: float


def build(vectors: DataFrame, calibration: DataFrame, k: int, recall: float = RECALL) -> Index | None:
    """Fit on a sample, index every row of ``vectors`` (vec_id, embedding), and calibrate on some rows of ``calibration``."""
    spark = vectors.sparkSession
    n = vectors.count()
    if not n:
        return None
    chance = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    wanted = min(MOST, max(SAMPLE, n // SHARE))
    # equal ids share their chance, so the sample has a bound of its own
    sample = vectors.filter(chance < min(1.0, wanted / n) * (1 << 30)).select("embedding").limit(2 * wanted).toPandas()
    if not len(sample):
        sample = vectors.select("embedding").limit(wanted).toPandas()
    tree = fit(matrix(sample["embedding"]))
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.assign(matrix(column)), dtype="int32")

    rows = stored(vectors.withColumn("leaf", leaf("embedding")), "kmeans-tree")
    sizes = np.zeros(tree.leaves, np.int64)
    for row in rows.groupBy("leaf").count().collect():  # a bounded number of leaves
        sizes[row.leaf] = row["count"]
    m = calibration.count()
    some = calibration.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < min(1.0, CALIBRATION / max(m, 1)) * (1 << 30))
    for ids, queries in query_blocks(some):
        true = brute_force(rows.select("vec_id", "embedding"), ids, queries, k).collect()
        # where the true neighbours are: a bounded set of ids
        wanted = spark.createDataFrame(pd.DataFrame({"vec_id": np.unique(np.concatenate([r.vec_ids for r in true] or [np.zeros(0, int)])).astype(np.int64)}), "vec_id long")
        leaf_of = {r.vec_id: r.leaf for r in rows.join(F.broadcast(wanted), "vec_id").select("vec_id", "leaf").collect()}
        place = dict(zip(ids.tolist(), queries, strict=True))
        needed: list[int] = []
        walks = tree.visits(np.array([place[r.query_id] for r in true]).reshape(len(true), queries.shape[1]), tree.leaves)
        for r, walk in zip(true, walks, strict=True):
            order = {x: at + 1 for at, x in enumerate(walk)}
            needed += [order[leaf_of[i]] for i in r.vec_ids]
        if needed:
            needed.sort()
            visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]
            return Index(tree, rows, sizes, visits, float(np.mean(np.array(needed) <= visits)))
        break
    return Index(tree, rows, sizes, tree.leaves, 1.0)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each query (vec_id, embedding).

    Neighbouring leaves form cells of about CELL rows; a query goes to each cell once, with its leaves there, and brings
    back one list. Large leaves are several parts, and the queries of a cell come BLOCK at a time: rows are repeated for
    each part of a cell's queries, queries for each part of its rows.
    """
    spark = queries.sparkSession
    # one query for each id; its own rows are no candidates
    own = queries.groupBy("vec_id").agg(F.min("embedding").alias("query"), F.count("*").alias("rows")).select(F.col("vec_id").alias("query_id"), "query", "rows")
    n = own.count()
    cells = (np.cumsum(index.sizes) - index.sizes) // CELL
    shared, visits = spark.sparkContext.broadcast((index.tree, index.sizes, cells)), index.visits

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, sizes, cell_of = shared.value
        for frame in frames:
            for start in range(0, len(frame), 64):
                part, rows = frame.iloc[start : start + 64], []
                found = tree.visits(matrix(part["query"]), visits, sizes, part["rows"].to_numpy() + k)
                for query_id, query, leaves in zip(part["query_id"], part["query"], found, strict=True):
                    leaves = np.sort(np.array(leaves, np.int32))
                    there, at = np.unique(cell_of[leaves], return_index=True)
                    rows += [(query_id, query, int(c), x) for c, x in zip(there, np.split(leaves, at[1:]), strict=True)]
                yield pd.DataFrame(rows, columns=["query_id", "query", "cell", "leaves"])

    spread = own.repartition(max(spark.sparkContext.defaultParallelism, n // BLOCK + 1))
    own = stored(spread.mapInPandas(walk, "query_id long, query array<double>, cell long, leaves array<int>"), "visits")
    asked, held = Counter({r["cell"]: r["count"] for r in own.groupBy("cell").count().collect()}), Counter()
    for cell, size in zip(cells.tolist(), index.sizes.tolist(), strict=True):
        held[cell] += size
    # a row for each cell, of which there are no more than leaves
    sizes = spark.createDataFrame([(c, max(1, -(-held[c] // CELL)), max(1, -(-asked[c] // BLOCK))) for c in sorted(held)], "cell long, row_parts int, query_parts int")
    leaf_cells = spark.createDataFrame([(leaf, c) for leaf, c in enumerate(cells.tolist())], "leaf int, cell long")

    def part_of(column: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(parts)).cast("int")

    rows = index.rows.join(F.broadcast(leaf_cells), "leaf").join(F.broadcast(sizes), "cell")
    rows = rows.withColumn("row_part", part_of("vec_id", "row_parts")).withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    own = own.join(F.broadcast(sizes), "cell").withColumn("query_part", part_of("query_id", "query_parts")).withColumn("row_part", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)))

    def compare(asking: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asking) and len(part):
            part = part.sort_values("leaf", kind="stable")
            ids, candidates, leaf = part["vec_id"].to_numpy(np.int64), matrix(part["embedding"]), part["leaf"].to_numpy()
            for start in range(0, len(asking), 256):
                some = asking.iloc[start : start + 256]
                vectors = matrix(some["query"])
                for query_id, query, leaves, rough in zip(some["query_id"], vectors, some["leaves"], vectors @ candidates.T, strict=True):
                    visited = np.isin(leaf, leaves)
                    if not visited.all():
                        rough = rough[visited]
                        found.append((int(query_id), *_top(int(query_id), query, ids[visited], candidates, rough, k, np.flatnonzero(visited))))
                    else:
                        found.append((int(query_id), *_top(int(query_id), query, ids, candidates, rough, k)))
        return pd.DataFrame(found, columns=["query_id", "vec_ids", "scores"])

    cell = ["cell", "row_part", "query_part"]
    own, rows = own.select(*cell, "query_id", "query", "leaves"), rows.select(*cell, "vec_id", "embedding", "leaf")
    found = own.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInPandas(compare, "query_id long, vec_ids array<long>, scores array<double>")
    ranked = merged(found, k).select("query_id", F.posexplode(F.arrays_zip("vec_ids", "scores")).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found of every twentieth vector among all others."""
    vectors = even(stored(usable(table(spark, sf_dir, "embeddings"), allow_zero=False), "vectors"))
    queries = vectors.filter(F.col("vec_id") % 20 == 0)
    index = build(vectors, queries, 20)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, queries, 20)
