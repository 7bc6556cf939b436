"""Source trees as a data source: `spark.read.format("source_tree").option("path", ...)`.

Spark's file sources skip names that start with `_` or `.`, so `__init__.py` would be lost; this one
lists files itself. Inside a git work tree, what git ignores is left out. Files are dealt to
partitions of about `partition_bytes` (`partitions` of them at least), and read where they are parsed. A file that can't be read or isn't UTF-8 is a
row with an error and no code. Filters on language and path reach the listing.
"""

from __future__ import annotations

import heapq
import json
import os
import subprocess
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringContains

from ..lang.registry import language_of

SCHEMA = "repo_id string, commit_sha string, file_path string, language string, code string, bytes bigint, error string"
PARTITION_BYTES = 32 << 20


def walk(top: str) -> Iterator[str]:
    """Files below a folder, by git's rules in a work tree, else without hidden names; sorted."""
    try:
        listed = subprocess.run(["git", "-C", top, "ls-files", "-coz", "--exclude-standard"], capture_output=True, check=True).stdout
        names = [os.path.join(top, os.fsdecode(n)) for n in listed.split(b"\0") if n]
        hidden = [n for n in names if any(p.startswith(".") for p in os.path.relpath(n, top).split(os.sep))]
        yield from sorted({n for n in names if os.path.isfile(n) and not os.path.islink(n)} - set(hidden))
    except (OSError, subprocess.CalledProcessError):
        for folder, folders, names in os.walk(top):
            folders[:] = sorted(d for d in folders if not d.startswith("."))
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not name.startswith(".") and os.path.isfile(path) and not os.path.islink(path):
                    yield path


def dealt(sized: list[tuple[int, tuple]], each: int, least: int) -> list[list[tuple]]:
    """Items in groups of about `each` in size, `least` groups where there are as many items; the largest items first."""
    n = max(1, min(len(sized), max(least, -(-sum(size for size, _ in sized) // each))))
    heap: list[tuple[int, int, list]] = [(0, k, []) for k in range(n)]
    for size, item in sorted(sized, reverse=True, key=lambda x: (x[0], x[1][0])):
        total, k, items = heapq.heappop(heap)
        items.append(item)
        heapq.heappush(heap, (total + size, k, items))
    return [items for _, _, items in sorted(heap, key=lambda x: x[1])]


class Chunk(InputPartition):
    def __init__(self, files: list[tuple[str, str | None]]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.own = json.loads(options.get("languages", "{}"))
        self.languages: list[str] = []
        self.parts: list[str] = []

    def real(self, path: str) -> str:
        """Paths are relative to the caller's folder, and are kept as they were given in results."""
        return os.path.join(self.options.get("cwd", ""), path)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("language",):
                self.languages.append(f.value)
            elif isinstance(f, StringContains) and f.attribute == ("file_path",):
                self.parts.append(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        ignored = [p for p in self.options.get("ignore_patterns", "").split(",") if p]
        found: list[tuple[int, str, str | None]] = []
        for top in (self.options.get("path") or ".").split(","):
            real = self.real(top)
            if os.path.isfile(real):  # a file that is named is kept whatever its extension
                paths = [top]
            else:
                paths = [os.path.join(top, os.path.relpath(p, real)) for p in walk(real) if language_of(p, self.own)]
            for path in paths:
                language = language_of(path, self.own)
                if any(fnmatch(path, p) or p in path for p in ignored) or any(x != language for x in self.languages) or not all(x in path for x in self.parts):
                    continue
                found.append((os.path.getsize(self.real(path)), path, language))
        each = int(self.options.get("partition_bytes", PARTITION_BYTES))
        return [Chunk(files) for files in dealt([(size, (path, language)) for size, path, language in found], each, int(self.options.get("partitions", "8")))]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        repo, sha = self.options.get("repo_id", "unknown"), self.options.get("commit_sha", "HEAD")
        for path, language in partition.files:
            try:
                with open(self.real(path), "rb") as f:
                    raw = f.read()
                yield repo, sha, path, language, raw.decode("utf-8"), len(raw), None
            except (OSError, UnicodeDecodeError) as e:
                yield repo, sha, path, language, None, None, str(e)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Also turns on pushdown into data sources, which Spark leaves off and this source needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
