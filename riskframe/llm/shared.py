"""Tables kept in the shared folder, and joins whose small side is broadcast only after its rows were counted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids or parameters that a join may broadcast: about 100 MB at 100 bytes a row. More rows are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes that a table with binary values may broadcast.
BROADCAST_BYTES = 32_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode without that setting, a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="riskframe-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: later stages and lost executors reread files."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``bound`` rows. ``df`` should be stored: its rows are counted."""
    return F.broadcast(df) if df.count() <= bound else df


def small_blobs(df: DataFrame, column: str, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its binary ``column`` has at most ``bound`` bytes, 32 a row added. It should be stored."""
    total = df.agg(F.sum(F.octet_length(column) + 32)).first()[0] or 0
    return F.broadcast(df) if total <= bound else df


def tasks(spark: SparkSession) -> int:
    """Parts of a shuffle whose work is per row, which adaptive execution would merge by bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
