"""Session settings the jobs are designed for. All are runtime SQL settings, so an existing session can take them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Joins carry no broadcast hints: Spark broadcasts a side only when its measured size is under
# spark.sql.autoBroadcastJoinThreshold, else it shuffles, and a hot key's partition is split at run time.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when the plan above the join would have reused its partitioning
    # (the extra exchange sits behind a partial aggregate or a per-partition top-k).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Feed files are small and many: a task opens some hundreds of them, and listing their folders takes few tasks.
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
    # Pages may be long: a Python helper gets a few hundred at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, app_name: str = "presslake", driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
