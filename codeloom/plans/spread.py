"""Even partitions for steps whose cost lies in the processor, not in reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of stored input (compressed, as the sources report it) that a partition of a heavy step gets at most.
PARTITION_BYTES = 16 << 20
#: Sources of unknown size report more than this.
UNKNOWN = 1 << 60


def stored_bytes(df: DataFrame) -> int:
    """The size of what a plan reads: that of its leaves, as estimates of joins and unions multiply; 0 where no source knows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def partitions_for(df: DataFrame, partition_bytes: int = PARTITION_BYTES) -> int:
    """Three waves over the cluster's cores at least, more where the data need it."""
    spark = df.sparkSession
    return int(min(200_000, max(3 * spark.sparkContext.defaultParallelism, -(-stored_bytes(df) // partition_bytes))))


def spread(df: DataFrame, *key: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows by a hash of ``key``, over as many partitions as cores and size ask for.

    A hash keeps the placement fixed when a lost task is run again, which round robin does only by sorting.
    The key must be nearly unique; whole rows move, never parts of a text.
    """
    return df.repartition(partitions_for(df, partition_bytes), F.xxhash64(*key))
