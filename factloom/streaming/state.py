"""Settings that streams with keyed state need, and what they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state of any form needs this store. A stream that was started with another one keeps that:
    its checkpoint names it."""
    spark.conf.set(PROVIDER, ROCKSDB)


def kept(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The rows (key, value) of a state variable, as of a stream's last finished batch."""
    read = spark.read.format("statestore").option("stateVarName", variable)
    return read.load(checkpoint).select("key", "value")
