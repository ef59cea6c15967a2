"""One review queue from several sources, in the order in which a person should take it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.classify import first_match

CATEGORIES = ("corpus", "out_of_scope", "silent_source", "needs_a_person")


def review_queue(docs: DataFrame, orders: DataFrame, events: DataFrame) -> DataFrame:
    """(category, kind, id) of all that needs review; every row is kept and tagged."""
    category = first_match([(F.col("text").isNull() | (F.col("n_chars") < 50), "corpus"), (F.col("source") == "src1", "out_of_scope"), (F.col("text").contains("the of"), "silent_source")], "needs_a_person")
    parts = [
        docs.select(category.alias("category"), F.lit("document").alias("kind"), F.col("doc_id").alias("id")),
        orders.select(F.lit("out_of_scope").alias("category"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")),
        events.select(F.lit("needs_a_person").alias("category"), F.lit("event").alias("kind"), F.col("event_id").alias("id")),
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
