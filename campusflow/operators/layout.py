"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.utils import is_remote

from campusflow.session import checkpoint_dir


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over at least ``min_partitions`` (default: the cluster's cores)
    when it has fewer, so CPU-heavy row work (regexes over whole texts) uses every core.

    A file with one row group scans as one task; on a cluster, inputs with
    many splits already have enough partitions and this is a no-op.  The
    partition count comes from the plan, no job runs.
    """
    if is_remote():  # a Spark Connect client sees no partitions: leave it to the planner
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    current = df.rdd.getNumPartitions()
    if current >= target:
        return df
    return df.repartition(target)


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small derived frame once when several consumers read it (a top-k feeding
    lookups, per-course counts feeding a top-k and a relabelling).

    Checkpointed to the shared folder: nothing stays in executor storage, and
    Spark's cleaner removes the files once nobody refers to the frame.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
