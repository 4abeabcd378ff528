"""Small helpers around the Spark session: checkpoint folder, scratch paths, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
UNPACKED_FACTOR = 8
PARTITION_BYTES = 16 * 1024 * 1024
MAX_PARTITIONS = 20_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting a temporary folder serves, but only where driver and tasks are one process: on a cluster every
    executor would write to its own disk and reading back would miss files, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not is_one_process(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="basecov-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def is_one_process(master: str) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    This cuts the lineage, so that lost executors do not replay it and several readers can share the result; the
    written table also has a known size, which later broadcast decisions rely on.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate (an upper bound for filters, projections and semi joins); None when not available."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def fits_broadcast(df: DataFrame, copies: int = 1) -> bool:
    """Whether ``copies`` of each row fit the limit; estimates of files are compressed sizes, so room is left for unpacking."""
    size = estimated_bytes(df)
    return size is not None and size * UNPACKED_FACTOR * copies <= BROADCAST_LIMIT_BYTES


def partitions_by_size(df: DataFrame) -> int | None:
    """Partitions of about ``PARTITION_BYTES`` unpacked, where those are more than the session's; None otherwise.

    None too for a size that is not known: the estimate is then as large as a number can be.
    """
    size = estimated_bytes(df)
    wanted = 0 if size is None else -(-size * UNPACKED_FACTOR // PARTITION_BYTES)
    return wanted if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < wanted <= MAX_PARTITIONS else None


def broadcast_or_merge(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a side that was found small; otherwise ask for a shuffled join, which can split skewed keys."""
    return F.broadcast(df) if small else df.hint("merge")


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only when the plan's size estimate is below the limit; otherwise leave it to Catalyst and AQE."""
    return F.broadcast(df) if fits_broadcast(df) else df
