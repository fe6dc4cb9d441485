"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Everything here is a runtime SQL setting.  Shuffle width is left to the cluster, from WIDTH on:
# AQE coalesces small partitions and splits skewed ones.
REQUIRED_CONF = {
    # Text timestamps without an offset are read as UTC wall clock.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when that costs one more shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What a task gathers before it sorts.  Keys and numbers of a join become rows of text several times as wide, and
    # at Spark's 64 MB their sort, for one row per key, went to disk.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # A task keeps a file open for each part it writes, up to so many parts, instead of sorting its rows by part.
    "spark.sql.maxConcurrentOutputFileWriters": "200",
}
#: Partitions of a shuffle before AQE coalesces them, at least: few would each grow with the input and spill. Up to 200,
#: map tasks write without a sort of their own.
WIDTH = 200
#: Largest measured size of a side that is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
_MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"


def broadcast_measured(spark: SparkSession) -> None:
    """Sides that AQE has measured are broadcast up to BROADCAST_BYTES, which spares facts a shuffle; none are where the session
    broadcasts nothing.  What Spark only estimates, from files that are packed, keeps the session's own limit."""
    own = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if own < 0:
        spark.conf.unset(_MEASURED)
    else:
        spark.conf.set(_MEASURED, str(max(own, BROADCAST_BYTES)))


def tune(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    width = max(WIDTH, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(width))
    broadcast_measured(spark)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("carelake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # No call-site capture per Column call: planning is most of a small query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
