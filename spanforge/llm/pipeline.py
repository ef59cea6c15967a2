"""A training-data pipeline over ``documents``: each stage works on what the stage before it kept.

Defined results: a null or empty text is clean, no near-duplicate of anything, has no repeated strings, takes part in the
mix once, and encodes to the end id alone; rows with equal ids are documents of their own; of equal rows, and of documents
within the threshold, that of the smallest id stays, a null id last; a null source is a source; an empty table gives no
rows; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import minhash, mixing, pieces, suffix_dedup, toxicity
from spanforge.llm.common import drop_path, importable, release, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the rejecting score stay."""
    importable(spark)
    lexicon = toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.clean_texts(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 over five-word shingles stays."""
    importable(spark)
    return minhash.one_of_each(docs, width=5, percent=80)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the 400-byte strings that occur more than once."""
    importable(spark)
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and sampled so that each source's words meet its target."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and whether they decode to the text."""
    importable(spark)
    encoded = pieces.decode_documents(pieces.encode_documents(docs.select("doc_id", "lang", "source", "text"), spans=False))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", drop_repeated_strings),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: No SQL states these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and reread; what a stage read goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
        release(spark)
    return docs
