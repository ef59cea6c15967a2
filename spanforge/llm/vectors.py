"""What the two vector searches share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries handled at once; more are taken block by block.
QUERY_BLOCK = 2_048


def usable(vectors: DataFrame, allow_zero: bool = True) -> DataFrame:
    """(vec_id, embedding as doubles) of rows with an id, a vector and only finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    return kept if allow_zero else kept.filter(F.exists("embedding", lambda x: x != 0))


def even(vectors: DataFrame) -> DataFrame:
    """Vectors shorter than the longest end in zeros, so that all have one length."""
    row = vectors.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if row.low == row.high:
        return vectors
    zeros = F.array_repeat(F.lit(0.0), F.lit(row.high) - F.size("embedding"))
    return vectors.withColumn("embedding", F.concat("embedding", zeros))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, block by block, each of bounded size."""
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # one query for each id
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK)
    for k in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)
        frame = part.toPandas().sort_values("vec_id", kind="stable")
        if len(frame):
            yield frame["vec_id"].to_numpy(np.int64), matrix(frame["embedding"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= floor)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
