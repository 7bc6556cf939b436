"""A running summary of files that arrive: totals by repository and language, kept up as files change.

The state holds the counts of each file's last version. A file that arrives takes its earlier counts
back: what passes on is the difference, summed by repository and language before it is written, so the
totals are the sum of a log of small differences. Nothing but the file is a key, so a large repository
is spread over all tasks.

An older version that comes late changes nothing. A file without code is gone: its counts are taken
back and its state is cleared. With `keep`, a file that hasn't come again for so long goes too, by a
timer in event time.

Each batch's differences are written to a folder of its own by its number, again if it is run again,
so a restart from the checkpoint neither loses nor repeats any.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.extract import COUNTS, file_counts
from ..operators.store import delete, exists, work_dir
from .state import keyed_state

TOTALS = ("files", *COUNTS)
_STATE = "language string, version long, checksum string, " + ", ".join(f"{c} long" for c in COUNTS)
_OUT = "repo_id string, language string, " + ", ".join(f"{c} long" for c in TOTALS)


class FileState(StatefulProcessor):
    """Keyed by repo_id and file_path."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def taken_back(self, key: tuple) -> Iterator[Row]:
        language, version, _, *counts = self.last.get()
        if self.keep_ms is not None:
            self.handle.deleteTimer(version + self.keep_ms)
        yield Row(repo_id=key[0], language=language, files=-1, **{c: -n for c, n in zip(COUNTS, counts, strict=True)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # of one version the text with the largest checksum counts, a file that is gone least
        new = max(rows, key=lambda r: (r["version"], r["checksum"] or ""))
        if self.last.exists():
            _, version, checksum, *_ = self.last.get()
            if (new["version"], new["checksum"] or "") < (version, checksum):
                return
            yield from self.taken_back(key)
        if new["checksum"] is None:
            self.last.clear()
            return
        counts = {c: new[c] for c in COUNTS}
        self.last.update((new["language"], new["version"], new["checksum"], *counts.values()))
        if self.keep_ms is not None:
            self.handle.registerTimer(new["version"] + self.keep_ms)
        yield Row(repo_id=key[0], language=new["language"], files=1, **counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            yield from self.taken_back(key)
            self.last.clear()

    def close(self) -> None:
        pass


def differences(files: DataFrame, keep: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """repo_id, language and what is added to each total, a row or two for each file that changes.

    files: a stream of repo_id, commit_sha, file_path, language, code and arrived, a time by which
    versions of a file are told apart.
    """
    import pandas as pd

    keyed_state(files.sparkSession)
    if keep:
        files = files.withWatermark("arrived", delay)
    counted = file_counts(files.withColumn("version", F.unix_millis("arrived")), ["version"])
    columns = ["repo_id", "file_path", "language", "version", "checksum", *COUNTS]
    state = FileState(int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None)
    return counted.select(*columns).groupBy("repo_id", "file_path").transformWithState(state, _OUT, "Append" if keep else "Update", "EventTime" if keep else "None")


def keep_totals(files: DataFrame, path: str, checkpoint: str, keep: str | None = None, delay: str = "0 seconds", **trigger) -> StreamingQuery:
    """Runs the summary: differences of batch N go to `path`/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("repo_id", "language").agg(*(F.sum(c).alias(c) for c in TOTALS))
        summed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    write_stream = differences(files, keep, delay).writeStream.foreachBatch(write).outputMode("append" if keep else "update")
    return write_stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """repo_id, language and its totals as of the last batch; those without files are left out."""
    bases = [r["upto"] for r in spark.read.parquet(f"{path}/base").select("upto").distinct().collect()] if exists(spark, f"{path}/base") else []
    parts, after = spark.read.option("basePath", path).schema(f"{_OUT}, batch long").parquet(f"{path}/batch=*"), max(bases, default=-1)
    parts = parts.where(F.col("batch") > after).drop("batch")
    if bases:
        parts = parts.unionByName(spark.read.parquet(f"{path}/base").where(F.col("upto") == after).drop("upto"))
    summed = parts.groupBy("repo_id", "language").agg(*(F.sum(c).alias(c) for c in TOTALS))
    return summed.where("files <> 0")


def compact(spark: SparkSession, path: str) -> None:
    """Sums the batches so far into one; those of a stream that runs meanwhile are left for the next time.

    The base is written whole before any batch goes, and names the batches that it holds, so a failure
    between the two counts none twice.
    """
    old = [r["upto"] for r in spark.read.parquet(f"{path}/base").select("upto").distinct().collect()] if exists(spark, f"{path}/base") else []
    found = sorted(r["batch"] for r in spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("batch").distinct().collect())
    done = [n for n in found if n > max(old, default=-1)][:-1]  # a restart may run the last one again
    if not done:
        return
    upto = done[-1]
    parts = spark.read.option("basePath", path).schema(f"{_OUT}, batch long").parquet(*(f"{path}/batch={n}" for n in done)).drop("batch")
    if old:
        parts = parts.unionByName(spark.read.parquet(f"{path}/base").where(F.col("upto") == max(old)).drop("upto"))
    parts.groupBy("repo_id", "language").agg(*(F.sum(c).alias(c) for c in TOTALS)).coalesce(1).write.mode("overwrite").parquet(f"{path}/base/upto={upto}")
    for n in [n for n in found if n <= upto]:
        delete(spark, f"{path}/batch={n}")
    for n in old:
        delete(spark, f"{path}/base/upto={n}")


def summarised(spark: SparkSession, files: DataFrame) -> str:
    """Lets files (with a column `version`) arrive as a stream, in four batches or more, and returns the folder of their totals."""
    folder = f"{work_dir(spark)}/running-{uuid.uuid4().hex}"
    timed = files.withColumn("arrived", F.timestamp_seconds("version")).drop("version")
    timed.write.parquet(f"{folder}/in")
    written = spark.read.parquet(f"{folder}/in")
    stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", -(-len(written.inputFiles()) // 4)).parquet(f"{folder}/in")
    keep_totals(stream, f"{folder}/totals", f"{folder}/state").awaitTermination()
    return f"{folder}/totals"
