"""Exact top-k inner products by a three-phase uniform threshold.

The components are split into LISTS parts; a candidate's score is the sum of its scores in these lists. Phase 1 gathers
each list's local best entries and lowest entry for every query; what is known of the entries' sums gives a lower bound
t of the k-th best score. Phase 2 broadcasts the cutoff: an entry's excess over its list's lowest must, in one list at
least, reach (t - sum of the lowest) / LISTS, or its sum cannot reach t; these entries are collected. Phase 3 raises
the bound by the collected sums, drops what can no longer reach it, and resolves the remaining scores exactly.

Copies of one vector tie for every query, so of each vector only the rows that ties can choose are searched, the k + 1
smallest ids; whatever the number of copies, no query gathers them.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
components are floored to integers first, so scores are exact (as 64-bit integers); ties go to the smaller vec_id; rows
with equal ids are separate candidates, but one query (the least vector), and none is a candidate of its own id; fewer
candidates than k give all of them; shorter vectors end in zeros, an empty one is all zeros; an empty table gives no rows;
only vec_id and embedding are read, whatever else a table has and however it is named. Components beyond 2**20 in size
times 1024 could carry a product of long vectors past 64 bits; such input is out of the score's range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.common import shared_path, stored, table
from spanforge.llm.vectors import best, even, matrix, query_blocks, usable

LISTS = 2
SCALE = 1024
ROWS = 2_048


def _product(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these are exact."""
    bound = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1]
    if bound < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    return queries.astype(np.int64) @ candidates.T.astype(np.int64)


def _parts(width: int) -> list[slice]:
    edges = np.linspace(0, width, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for frame in frames:
        for start in range(0, len(frame), ROWS):
            part = frame.iloc[start : start + ROWS]
            yield part["vec_id"].to_numpy(np.int64), matrix(part["embedding"])


def choosable(vectors: DataFrame, k: int) -> DataFrame:
    """The rows that can be among some query's k best: of each vector the k + 1 smallest ids, of each of these k rows.

    Spark limits the groups before they are shuffled, so a vector that is everywhere meets nowhere.
    """
    same_id = Window.partitionBy("embedding", "vec_id").orderBy(F.lit(0))
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    once = vectors.withColumn("n", F.row_number().over(same_id)).filter(F.col("n") <= k).drop("n")
    return once.withColumn("n", F.dense_rank().over(by_id)).filter(F.col("n") <= k + 1).drop("n")


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k best among ``vectors``; both are (vec_id, embedding of integers)."""
    spark = vectors.sparkSession
    path = shared_path(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, block in query_blocks(queries):
        _search_block(vectors, ids, block, k, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _search_block(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, schema: str) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((query_ids, queries))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Phase 1: each block's best entries of each list and their scores in all lists, and each list's lowest."""
        own_ids, own = shared.value
        for ids, candidates in _blocks(frames):
            scores = np.stack([_product(own[:, s], candidates[:, s]) for s in _parts(own.shape[1])])
            rows = []
            for q, own_id in enumerate(own_ids):
                other = ids != own_id
                kept = np.unique(np.concatenate([np.flatnonzero(other)[best(s[q][other], ids[other], k)] for s in scores]))
                rows.append((own_id, scores[:, q].min(axis=1).tobytes(), ids[kept].tobytes(), scores[:, q].sum(axis=0)[kept].tobytes()))
            yield pd.DataFrame(rows, columns=["query_id", "low", "ids", "sums"])

    def bound(part: pd.DataFrame) -> pd.DataFrame:
        low = np.stack([np.frombuffer(x, np.int64) for x in part["low"]]).min(axis=0)
        sums = np.sort(np.frombuffer(b"".join(part["sums"]), np.int64))[::-1]
        # with fewer than k known sums nothing may be left out
        least = int(sums[k - 1]) if len(sums) >= k else int(low.sum())
        return pd.DataFrame({"query_id": [part["query_id"].iat[0]], "low": [low.tobytes()], "least": [least]})

    gathered = vectors.mapInPandas(local, "query_id long, low binary, ids binary, sums binary")
    # a bounded number of queries, so of bounds
    bounds = {r.query_id: (np.frombuffer(r.low, np.int64), r.least) for r in gathered.groupBy("query_id").applyInPandas(bound, "query_id long, low binary, least long").collect()}
    cutoffs = spark.sparkContext.broadcast(bounds)

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Phase 2: entries that reach the cutoff in some list."""
        from pyspark import TaskContext

        own_ids, own = shared.value
        for number, (ids, candidates) in enumerate(_blocks(frames)):
            block = (TaskContext.get().partitionId() << 32) + number  # ids may repeat; this is unique over the job
            scores = np.stack([_product(own[:, s], candidates[:, s]) for s in _parts(own.shape[1])])
            rows = []
            for q, own_id in enumerate(own_ids):
                low, least = cutoffs.value[own_id]
                # LISTS * excess >= least - sum of lows, in integers
                reach = ((scores[:, q] - low[:, None]) * LISTS >= least - low.sum()) & (ids != own_id)
                for j in range(LISTS):
                    at = np.flatnonzero(reach[j])
                    if len(at):
                        rows.append((own_id, j, ids[at].tobytes(), at.astype(np.int32).tobytes(), scores[j, q, at].tobytes(), block))
            yield pd.DataFrame(rows, columns=["query_id", "list", "ids", "at", "scores", "block"])

    def remain(part: pd.DataFrame) -> pd.DataFrame:
        """Phase 3: what can still reach the raised bound."""
        query_id = int(part["query_id"].iat[0])
        low, least = cutoffs.value[query_id]
        places: dict[tuple[int, int, int], list[int | None]] = {}
        for j, ids, at, scores, block in zip(part["list"], part["ids"], part["at"], part["scores"], part["block"], strict=True):
            for i, p, s in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(at, np.int32).tolist(), np.frombuffer(scores, np.int64).tolist(), strict=True):
                places.setdefault((int(block), p, i), [None] * LISTS)[j] = s
        ids = np.array([p[2] for p in places], np.int64)
        seen = np.array([[np.nan if s is None else s for s in x] for x in places.values()])
        missing = np.isnan(seen)
        # an entry that is missing lies between its list's lowest and the cutoff
        lower = np.where(missing, low, seen).sum(axis=1)
        most = low + max(0, -(-(least - int(low.sum())) // LISTS) - 1)
        upper = np.where(missing, np.maximum(most, low), seen).sum(axis=1)
        if len(lower) >= k:
            least = max(least, np.partition(lower, len(lower) - k)[len(lower) - k])
        return pd.DataFrame({"query_id": query_id, "vec_id": np.unique(ids[upper >= least])})

    entries = vectors.mapInPandas(collect, "query_id long, list int, ids binary, at binary, scores binary, block long")
    open_ = entries.groupBy("query_id").applyInPandas(remain, "query_id long, vec_id long")
    open_ = open_.groupBy("vec_id").agg(F.collect_list("query_id").alias("query_ids"))

    def resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_ids, own = shared.value
        for frame in frames:
            ids, candidates, rows = frame["vec_id"].to_numpy(np.int64), matrix(frame["embedding"]), []
            for i, wanted, candidate in zip(ids, frame["query_ids"], candidates, strict=True):
                at = np.searchsorted(own_ids, np.asarray(wanted, np.int64))
                rows += zip(own_ids[at].tolist(), [int(i)] * len(at), _product(own[at], candidate[None])[:, 0].tolist(), strict=True)
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    exact = vectors.join(open_, "vec_id").mapInPandas(resolve, "query_id long, vec_id long, score long")

    def top(part: pd.DataFrame) -> pd.DataFrame:
        at = best(part["score"].to_numpy(), part["vec_id"].to_numpy(), k)
        return part.iloc[at].assign(rank=np.arange(1, len(at) + 1, dtype=np.int32))[["query_id", "rank", "vec_id", "score"]]

    return exact.groupBy("query_id").applyInPandas(top, schema)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector among all others, by integer inner product."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    vectors = stored(vectors.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * SCALE).cast("double"))), "floored")
    vectors = even(vectors)
    return search(stored(choosable(vectors, 10), "choosable"), vectors.filter(F.col("vec_id") % 100 == 0), 10)
