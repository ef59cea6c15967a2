"""Sessions and table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, about; a single longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def local_session(app: str = "spanforge", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python BATCH_BYTES at a time, unless the session asks for less: by rows alone a batch of long texts has no bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None) or ""
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table."""
    importable(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores dealt anew, before work that is heavy per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session find this package where it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, or on one machine a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spanforge-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(spark: SparkSession) -> None:
    """See that the session has a folder for reliable checkpoints, that of ``spark.checkpoint.dir`` where it is set."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(scratch(spark, "checkpoints"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked through Spark's own file system layer."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that what builds on it does not compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
