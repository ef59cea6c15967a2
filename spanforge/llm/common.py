"""What the corpus operators share: table access, folds, tokens, checkpoints."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch, about; a single longer row is a batch of its own.
BATCH_BYTES = 2 << 20
#: Small rows (numbers only) that one task handles at least.
ROWS_IN_TASK = 50_000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it is not installed and no --py-files ship it (local sessions)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    bounded_batches(spark)


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python BATCH_BYTES at a time, unless the session asks for less: by rows alone a batch of long texts has no bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None) or ""
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id gives null."""
    return F.crc32(F.col(id_column).cast("string")) % modulus


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, the context's checkpoint
    folder, or on one machine a temporary one. A cluster without such a folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif re.match(r"local(\[|$)", context.master):
            folder = tempfile.mkdtemp(prefix="spanforge-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/spanforge/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back."""
    return stored_at(df, shared_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """Write to ``path`` and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fewer_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` small rows in as few tasks as they need, where the session deals them to more.

    Loops over few rows would otherwise start the session's number of tasks in every step. Tables that fill these tasks stay
    as they are, with the partitioning that they have.
    """
    tasks = max(1, -(-rows // ROWS_IN_TASK))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints that finished steps have left; it waits for the JVM to collect."""
    gc.collect()  # Python's own references first
    spark.sparkContext._jvm.System.gc()
