"""Shared plumbing: written tables, tree sums of fixed-size arrays, bounded label samples, bounded batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_REMAINDER = 2
#: Rows and bytes of an Arrow batch, at most (a longer row is a batch of its own).
BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python workers hold a few MB, as both keep several at a time."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def released() -> None:
    """Gives memory that this worker has freed back to the system; workers live on between tasks."""
    from . import textops

    textops.forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, a function of a task's batches, that keeps no freed memory once the task is done."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            released()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master a temporary folder where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = tempfile.mkdtemp(prefix="factloom-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir") + "/factloom-work"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that written() made, oldest first.
_made: list[str] = []


def written(df: DataFrame, name: str, partition: str | None = None, **options: object) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").options(**options)
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    _made.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written(), once nothing lazy reads them any more; others stay."""
    for df in tables:
        if path := getattr(df, "written_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _made:
        _made.remove(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a written table; tables that were written on the way to it are deleted."""
    before = set(_made)
    out = written(make(), name)
    for path in [p for p in _made if p not in before and p != out.written_path]:
        _delete(out.sparkSession, path)
    return out


def held_out(doc_id: str | Column = "doc_id") -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def bounded_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """At most `bound` labelled rows that aren't held out: (doc_id, text, label).

    The rows with the smallest hash of doc_id are taken, so the sample depends on the data alone.
    Ids whose labels contradict each other, and null ids or labels, are left out. Of rows that repeat
    an id the text with the least hash is taken, so there are at most `bound` rows whatever the ids.
    Only the ids (at most `bound` of them) are broadcast.
    """
    ids = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .select("doc_id", "label")
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(target)), "doc_id")
        .limit(bound)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")


def pack_arrays(part: int, array: np.ndarray, chunks: int) -> pd.DataFrame:
    """Rows (part, chunk, data) that tree_sum() adds up; chunks of zeros only are left out."""
    rows = [
        (part, k, zlib.compress(np.ascontiguousarray(piece).tobytes(), 1))
        for k, piece in enumerate(np.array_split(array.ravel(), chunks))
        if piece.any()
    ]
    return pd.DataFrame(rows, columns=["part", "chunk", "data"])


ARRAYS = "part int, chunk int, data binary"


def tree_sum(parts: DataFrame, shape: tuple[int, ...], dtype: str, chunks: int, fan_in: int = 64) -> np.ndarray:
    """Adds equally shaped arrays, one from each partition, fan_in at a time; returns the sum.

    parts: rows of pack_arrays() with the same dtype. What reaches the driver is one array of the
    given shape, however large the input. Sums of an unsigned dtype stop at its largest number.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in pdf["data"]:
            piece = np.frombuffer(zlib.decompress(data), dtype=dtype)
            total = piece.copy() if total is None else total + piece
            if total.dtype.kind == "u":
                total[total < piece] = np.iinfo(dtype).max  # unsigned sums stop at the largest number
        return pd.DataFrame(
            {"part": [int(pdf["part"].min()) // fan_in], "chunk": [int(pdf["chunk"].iloc[0])], "data": [zlib.compress(total.tobytes(), 1)]}
        )

    left = max(1, parts.rdd.getNumPartitions())
    while True:
        parts = parts.groupBy("chunk", F.floor(F.col("part") / fan_in).alias("g")).applyInPandas(add, ARRAYS)
        left = -(-left // fan_in)
        if left <= 1:
            break
    out = np.zeros(shape, dtype=dtype)
    pieces = np.array_split(out.ravel(), chunks)
    for row in parts.collect():
        pieces[row["chunk"]] += np.frombuffer(zlib.decompress(bytes(row["data"])), dtype=dtype)
    return out
