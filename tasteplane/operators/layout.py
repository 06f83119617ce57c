"""How many partitions large shuffles have, so that a task holds no more on larger tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

PARTITIONS = "spark.sql.shuffle.partitions"
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def set_partitions(spark: SparkSession, asked: int) -> int:
    """Shuffles of the session start with ``asked`` partitions if that is more than it has; AQE puts small ones together. The number for ``repartition``."""
    spark.conf.set(_INITIAL, str(max(int(spark.conf.get(PARTITIONS)), asked)))
    return partitions(spark)


def partitions(spark: SparkSession) -> int:
    """How many partitions a ``repartition`` of large data gets (AQE leaves these alone): what ``set_partitions`` was asked, or one a core."""
    own = int(spark.conf.get(PARTITIONS))
    asked = int(spark.conf.get(_INITIAL, None) or own)
    return asked if asked > own else min(own, spark.sparkContext.defaultParallelism)
