"""Change rates over event time, and files that arrive as a stream. Batch and stream share the plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import work_dir


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events with ts as a timestamp in UTC; on a stream, with a watermark."""
    cast = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return cast.withWatermark("ts", late) if cast.isStreaming else cast


def tumbling(events: DataFrame, width: str) -> DataFrame:
    counted = timed(events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("changes"))
    return counted.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "changes")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    counted = timed(events).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("changes"))
    return counted.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "changes")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    counted = timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("changes"))
    return counted.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "changes")


def distinct_files(files: DataFrame) -> DataFrame:
    """Files of a stream with a time of arrival, each checksum once within the watermark."""
    signed = files.withColumn("checksum", F.sha2(F.col("code").cast("binary"), 256))
    return signed.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["repo_id", "file_path", "checksum"])


def arrivals(spark: SparkSession, files: DataFrame, name: str) -> DataFrame:
    """Writes files to a folder, streams them from there and returns what the stream lets through."""
    folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files.withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = distinct_files(spark.readStream.schema(schema).parquet(f"{folder}/in")).select("repo_id", "file_path", "checksum")
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
