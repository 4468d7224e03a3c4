"""Session settings for tests, benchmarks and jobs of a known input size."""

from __future__ import annotations

from pyspark.sql import SparkSession

MEGABYTE = 1024 * 1024
INPUT_PER_PARTITION = 1024 * MEGABYTE


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Upper number of shuffle partitions; adaptive execution merges what is small.

    Reports read about a quarter of the bytes of the files, so a gigabyte of input gives
    some 256 MB to shuffle, which a task sorts in memory.
    """
    return max(cores, -(-input_bytes // INPUT_PER_PARTITION))


def build_session(master: str, cores: int, input_bytes: int = 0, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("boxmetrics")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the caller of every expression doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Sorted reports cut their ranges by a sample of this many rows for each.
        .config("spark.sql.execution.rangeExchange.sampleSizePerPartition", "400")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes, cores)))
        .config("spark.sql.files.maxPartitionBytes", str(256 * MEGABYTE))
        # Also decides how large the files of a layer become.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(256 * MEGABYTE))
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
