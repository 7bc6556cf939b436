"""Sessions with the settings that the engine is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts and code are long cells: small batches keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.python.worker.reuse": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("factloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
