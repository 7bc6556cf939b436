"""Tables of facts: layout, replacing the facts of files, and what need not be extracted again."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Predicates of facts, with room for those of languages of one's own; beyond that a task sorts again.
PREDICATES = 16


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one on a local master where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def write_facts(facts: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Facts as Parquet by predicate, so a relation reads its own files only."""
    spark = facts.sparkSession
    path = path or f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with unsorted(spark):
        facts.write.partitionBy("predicate").parquet(path)
    return spark.read.schema(facts.schema).parquet(path)


@contextmanager
def unsorted(spark: SparkSession) -> Iterator[None]:
    """Tasks that write by predicate keep a file open for each of them, so none sorts all of its facts first."""
    key, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set(key, max(int(before), PREDICATES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tables that the calls of tidy functions that are running have cut, innermost last.
_cut: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, to end its lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _cut:
        _cut[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result as a table; the tables that it cut on the way are deleted."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _cut.append([])
        try:
            made = f(*args, **kwargs)
            own, _cut[-1] = _cut[-1], []
            found = cut(made, f.__name__)
        finally:
            kept = _cut.pop()
        if _cut:
            _cut[-1].extend(kept)
        for path in own:
            delete(found.sparkSession, path)
        return found

    return run


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


KEY = ["repo_id", "file_path"]


def manifest(files: DataFrame) -> DataFrame:
    """repo_id, file_path, checksum of files."""
    return files.select(*KEY, F.sha2(F.col("code").cast("binary"), 256).alias("checksum"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose checksum isn't in the manifest."""
    signed = files.withColumn("checksum", F.sha2(F.col("code").cast("binary"), 256))
    return signed.join(known, [*KEY, "checksum"], "left_anti").drop("checksum")


def replace_files(stored: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """stored without the facts of `files`, and fresh."""
    return stored.join(files.select(*KEY).distinct(), KEY, "left_anti").unionByName(fresh)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("repo_id string, file_path string, commit_sha string, checksum string, version string").parquet(path)


def unknown_files(signed: DataFrame, path: str, version: str) -> DataFrame:
    """Files (KEY, checksum) that the manifest at path doesn't hold by checksum and version of the parsers."""
    spark = signed.sparkSession
    if not exists(spark, path):
        return signed
    known = read_manifest(spark, path).where(F.col("version") == version).select(*KEY, "checksum")
    return signed.join(known, [*KEY, "checksum"], "left_anti")


def upsert(fresh: DataFrame, path: str, buckets: int = 64, files: DataFrame | None = None) -> None:
    """Replaces the facts of all files in fresh in a table that is partitioned by a hash of the file.

    files: those that were read (repo_id, file_path), if some may give no facts any more. fresh is
    evaluated once; only the partitions that hold such files are read and written again.
    """
    spark = fresh.sparkSession
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
    fresh = cut(fresh.withColumn("bucket", bucket), "fresh")
    files = fresh.select(*KEY, "bucket").distinct() if files is None else files.select(*KEY).distinct().withColumn("bucket", bucket)
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        fresh.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        return
    hit = [r["bucket"] for r in files.select("bucket").distinct().collect()]  # at most `buckets`
    stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(hit))
    merged = cut(replace_files(stored, fresh.select(*stored.columns), files), "upsert")
    # few files a bucket, and large buckets over several tasks
    merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in set(hit) - {r["bucket"] for r in merged.select("bucket").distinct().collect()}:  # an overwrite leaves these as they were
        empty = jvm.Path(f"{path}/bucket={bucket}")
        empty.getFileSystem(spark._jsc.hadoopConfiguration()).delete(empty, True)
