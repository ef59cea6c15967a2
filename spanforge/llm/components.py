"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, fewer_tasks, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    Each round hangs a node's larger neighbours on the smallest node known near it, so paths shorten geometrically;
    the edge table never grows, and neighbour lists are never gathered.
    """
    now = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    n = now.count()
    most = 2 * n  # no step has more rows than the edges both ways
    now = fewer_tasks(now, most)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = fewer_tasks(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), most)
        large = fewer_tasks(both.filter("b > a").join(least, "a"), most).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = fewer_tasks(large.filter("a <> b").distinct(), most)
        lower = fewer_tasks(large.groupBy("a").agg(F.min("b").alias("m")), most)
        small = fewer_tasks(large.join(lower, "a"), most).select(F.col("b").alias("x"), "m").filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        after = checkpoint(fewer_tasks(small.distinct(), most))
        left = after.count()
        if left == n and not fewer_tasks(after.exceptAll(now), most).limit(1).count():
            break
        now, n = after, left
        # the round's shuffle files and the table before it are done with
        del both, least, large, lower, small, after
        release(now.sparkSession)
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
