"""Counts by windows of event time in append mode, with late rows kept instead of dropped.

Spark drops rows that come after their window closed before any operator sees them. Here the state
asks the watermark itself: a row of an open window is counted, a row of a closed one passes on as it
is, and a window whose end the watermark passes is emitted once and leaves the state. So closed windows,
open ones (read from the state) and late rows together are all rows.

A key and window may hold any share of the rows: they are counted in `salts` parts, which `closed()`
and `open_windows()` add up, so a busy key is spread over as many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.store import work_dir
from .state import kept, keyed_state

SALTS = 8


class Windows(StatefulProcessor):
    """Keyed by the columns of `keys`, start and salt."""

    def __init__(self, keys: list[str], carried: list[str], width_ms: int):
        self.keys, self.carried, self.width_ms = keys, carried, width_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def ends(self, key: tuple) -> int:
        start = pd.Timestamp(key[-2])
        start = start.tz_localize(timezone.utc) if start.tzinfo is None else start
        return int(start.timestamp() * 1000) + self.width_ms

    def row(self, kind: str, key: tuple, n: int) -> dict:
        return {"kind": kind, **dict(zip(self.keys, key, strict=False)), "start": key[-2], "changes": n}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, added = self.ends(key), 0
        late = end <= timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            if late:
                yield pdf[self.carried].assign(**self.row("late", key, 1))[self.columns()]
            added += len(pdf)
        if not late:
            before = self.count.get()[0] if self.count.exists() else 0
            self.count.update((before + added,))
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.count.exists():
            n = self.count.get()[0]
            self.count.clear()
            yield pd.DataFrame([self.row("window", key, n) | dict.fromkeys(self.carried)])[self.columns()]

    def columns(self) -> list[str]:
        return ["kind", *self.keys, "start", "changes", *self.carried]

    def close(self) -> None:
        pass


def with_late(events: DataFrame, keys: list[str], width: str, delay: str, carried: list[str] | None = None, ts: str = "ts", salts: int = SALTS) -> DataFrame:
    """kind (window or late), keys, start, changes and the columns of `carried` (null for windows).

    events: a stream with a time `ts`. width and delay are intervals such as `1 hour`; a row without
    time is in no window and doesn't pass. A late row has one change.
    """
    keyed_state(events.sparkSession)
    carried = [ts] if carried is None else carried
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    start = F.window(ts, width)["start"]
    # a computed column is no event time to Spark, so rows aren't dropped on their way
    plain = {c: F.timestamp_micros(F.unix_micros(c)) if c == ts else F.col(c) for c in carried}
    dealt = timed.select(*keys, start.alias("start"), F.pmod(F.xxhash64(*events.columns), F.lit(salts)).alias("salt"), *(c.alias(n) for n, c in plain.items() if n not in keys))
    carried = [c for c in carried if c not in keys]
    kinds = {f.name: f.dataType for f in dealt.schema}
    schema = T.StructType(
        [T.StructField("kind", T.StringType()), *(T.StructField(k, kinds[k]) for k in keys), T.StructField("start", T.TimestampType()), T.StructField("changes", T.LongType())]
        + [T.StructField(c, kinds[c]) for c in carried]
    )
    width_ms = int(pd.Timedelta(width).total_seconds() * 1000)
    return dealt.groupBy(*keys, "start", "salt").transformWithStateInPandas(Windows(keys, carried, width_ms), schema, "Append", "EventTime")


def keep(found: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the rows of with_late() to a table in folders by kind, each row once whatever fails."""
    write = found.writeStream.format("parquet").partitionBy("kind").outputMode("append")
    return write.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def closed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """keys, start, changes of the windows that have closed."""
    return spark.read.parquet(path).where("kind = 'window'").groupBy(*keys, "start").agg(F.sum("changes").alias("changes"))


def late(spark: SparkSession, path: str) -> DataFrame:
    """The late rows."""
    return spark.read.parquet(path).where("kind = 'late'").drop("kind", "changes")


def open_windows(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """keys, start, changes so far of the windows that are still open."""
    own = [F.col(f"key.{k}").alias(k) for k in (*keys, "start")]
    return kept(spark, checkpoint, "count").select(*own, F.col("value.n").alias("n")).groupBy(*keys, "start").agg(F.sum("n").alias("changes"))


def accounted(spark: SparkSession, events: DataFrame, keys: list[str], width: str, delay: str, carried: list[str]) -> DataFrame:
    """kind (window, open or late), keys, start, changes of events that arrive as a stream, by the parts of a column `part`."""
    folder = f"{work_dir(spark)}/late-{uuid.uuid4().hex}"
    for part in sorted(r["part"] for r in events.select("part").distinct().collect()):  # a part is a few batches of its own
        events.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
    written = spark.read.parquet(f"{folder}/in")
    stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", -(-len(written.inputFiles()) // 3)).parquet(f"{folder}/in")
    keep(with_late(stream, keys, width, delay, carried, salts=2), f"{folder}/out", f"{folder}/state").awaitTermination()
    lates = late(spark, f"{folder}/out").groupBy(*keys, "start").agg(F.count("*").alias("changes"))
    parts = {"window": closed(spark, f"{folder}/out", keys), "open": open_windows(spark, f"{folder}/state", keys), "late": lates}
    named = [df.select(F.lit(kind).alias("kind"), *keys, "start", "changes") for kind, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])
