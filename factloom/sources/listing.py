"""Source trees in two phases: folders are dealt to tasks, which list the files; then files are read, dealt by size.

The driver walks folders and holds nothing but their names. What git ignores is left out by asking git
about names: on the driver for folders, level by level, and in tasks for the files of their folders.
Results equal those of `source_tree`.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..lang.registry import language_of
from ..operators.store import cut
from .tree import PARTITION_BYTES

SCHEMA = "repo_id string, commit_sha string, file_path string, language string, bytes bigint, place string"
CODE = "repo_id string, commit_sha string, file_path string, language string, code string, bytes bigint, error string"
#: Folders of a task, about, and tasks at least.
FOLDERS, TASKS = 500, 8


def git(top: str, *args: str, text: bytes | None = None) -> bytes | None:
    """What git says, or nothing outside a work tree. An exit of 1 is an answer without lines."""
    try:
        done = subprocess.run(["git", "-C", top, *args], input=text, capture_output=True, check=False)
    except OSError:
        return None
    return done.stdout if done.returncode in (0, 1) else None


def ignored(top: str, names: list[str]) -> set[str]:
    """Those of the names below top that git ignores; tracked ones aren't."""
    said = git(top, "check-ignore", "-z", "--stdin", text=b"\0".join(map(os.fsencode, names)) + b"\0") if names else None
    return {os.fsdecode(n) for n in (said or b"").split(b"\0") if n}


def folders(top: str) -> Iterator[str]:
    """Folders to list, relative to top, which is the empty name: none that is hidden, ignored, a link or a repository of its own."""
    tracked = git(top, "ls-files", "-ciz", "--exclude-standard")
    within = tracked is not None
    forced: set[str] = set()  # folders on the way to files that are tracked though they are ignored
    for name in (tracked or b"").split(b"\0"):
        folder = os.path.dirname(os.fsdecode(name))
        while folder and folder not in forced:
            forced.add(folder)
            folder = os.path.dirname(folder)
    level = [""]
    while level:
        yield from level
        below = []
        for folder in level:
            try:
                with os.scandir(os.path.join(top, folder)) as entries:
                    names = [e.name for e in entries if not e.name.startswith(".") and e.is_dir(follow_symlinks=False)]
            except OSError:
                continue
            below += [os.path.join(folder, n) for n in sorted(names) if not (within and os.path.exists(os.path.join(top, folder, n, ".git")))]
        gone = ignored(top, below) - forced if within else set()
        level = [f for f in below if f not in gone]


class Folders(InputPartition):
    def __init__(self, tops: list[tuple[str, list[str]]], files: list[str]):
        self.tops, self.files = tops, files


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.own = json.loads(options.get("languages", "{}"))

    def real(self, path: str) -> str:
        return os.path.join(self.options.get("cwd", ""), path)

    def partitions(self) -> Sequence[InputPartition]:
        found: list[tuple[str, str]] = []
        named: list[str] = []
        for top in (self.options.get("path") or ".").split(","):
            if os.path.isfile(self.real(top)):
                named.append(top)
            else:
                found += [(top, folder) for folder in folders(self.real(top))]
        n = max(1, min(len(found), max(int(self.options.get("partitions", TASKS)), -(-len(found) // int(self.options.get("folders", FOLDERS))))))
        parts = []
        for k in range(n):
            tops: dict[str, list[str]] = {}
            for top, folder in found[k * len(found) // n : (k + 1) * len(found) // n]:
                tops.setdefault(top, []).append(folder)
            parts.append(Folders(list(tops.items()), named if k == 0 else []))
        return parts

    def read(self, partition: Folders) -> Iterator[tuple]:
        skipped = [p for p in self.options.get("ignore_patterns", "").split(",") if p]
        repo, sha = self.options.get("repo_id", "unknown"), self.options.get("commit_sha", "HEAD")

        def row(path: str, size: int) -> Iterator[tuple]:
            if not any(fnmatch(path, p) or p in path for p in skipped):
                yield repo, sha, path, language_of(path, self.own), size, self.real(path)

        for path in partition.files:  # a file that is named is kept whatever its extension
            yield from row(path, os.path.getsize(self.real(path)))
        for top, names in partition.tops:
            real, sizes = self.real(top), {}
            for folder in names:
                try:
                    with os.scandir(os.path.join(real, folder)) as entries:
                        for e in entries:
                            if not e.name.startswith(".") and language_of(e.name, self.own) and e.is_file(follow_symlinks=False):
                                sizes[os.path.join(folder, e.name)] = e.stat(follow_symlinks=False).st_size
                except OSError:
                    continue
            for name in sorted(sizes.keys() - ignored(real, list(sizes))):
                yield from row(os.path.join(top, name), sizes[name])


class SourceListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceListing)


def dealt_by_size(listing: DataFrame, each: int = PARTITION_BYTES, least: int = TASKS) -> DataFrame:
    """The listing as a table, in partitions of about `each` bytes of the files it names."""
    listing = cut(listing, "listing")
    size = listing.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    return listing.repartition(max(least, -(-size // each)), "file_path")


def checksums(listing: DataFrame) -> DataFrame:
    """The listing with `checksum`, the SHA-256 of the file's bytes (null if it can't be read); no text leaves the task."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for place in batch.column("place").to_pylist():
                try:
                    with open(place, "rb") as f:
                        sums.append(hashlib.file_digest(f, "sha256").hexdigest())
                except OSError:
                    sums.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "checksum"])

    return listing.mapInArrow(signed, SCHEMA + ", checksum string")


def read_code(listing: DataFrame) -> DataFrame:
    """repo_id, commit_sha, file_path, language, code, bytes, error of the files of a listing.

    A file that can't be read or isn't UTF-8 has an error and no code.
    """
    kept = ("repo_id", "commit_sha", "file_path", "language")
    schema = pa.schema([(c, pa.int64() if c == "bytes" else pa.string()) for c in (*kept, "code", "bytes", "error")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # a file is a batch of its own, as it may be of any size
                code = size = error = None
                try:
                    with open(row["place"], "rb") as f:
                        raw = f.read()
                    code, size = raw.decode("utf-8"), len(raw)
                except (OSError, UnicodeDecodeError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in kept} | {"code": code, "bytes": size, "error": error}], schema=schema)

    return listing.select(*kept, "place").mapInArrow(read, CODE)
