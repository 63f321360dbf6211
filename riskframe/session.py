"""Session helpers: a local session for tests and benches, and durable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints have a folder: the one that ``spark.checkpoint.dir`` names, in local mode a temporary one if it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="riskframe-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new name below the shared checkpoint folder, for tables that one stage hands to the next."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        checkpoint_folder(spark)
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    system, target = _located(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the caller wrote itself."""
    system, target = _located(spark, path)
    system.delete(target, True)


def slices(spark: SparkSession) -> int:
    """How many parts compute-heavy stages are cut into: the cluster's shuffle setting, at least its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """Even parts for work whose cost is per row, not per byte.

    Adaptive execution merges small shuffles by size, which would leave a heavy kernel or a training loop
    on one core; an explicit number of parts is left as it is.
    """
    return df.repartition(parts or slices(df.sparkSession), *by)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    Used where a table is read by several later stages or grows inside a loop; a lost executor then
    costs a re-read of the written blocks, not a re-run of the history.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
