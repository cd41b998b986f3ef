"""A session with the settings that the plans here count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",  # coalesces small shuffles and splits skewed joins at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "mnemoflow", master: str | None = None, checkpoint: str | None = None, **more: str) -> SparkSession:
    """checkpoint: the folder that all executors share, for scratch tables; needed on a cluster.

    Leave spark.sql.shuffle.partitions high on a cluster (two or three for each core): adaptive execution merges what is small.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
