"""Source files that arrive in a folder, as a stream: `spark.readStream.format("source_arrivals")`.

Each listing that finds new or changed files, or misses known ones, makes an entry of a log: a numbered
file that names them with their size and time. An offset is a number of the log, so a batch that is
run again reads the same files, and what was listed but not yet planned when a stream stopped comes
next. A listing takes at most `max_files` and `max_bytes` (one file at least), the oldest first; the
rest is left for the next.

A file that has changed again since it was listed is a row with an error and no code; its new state
arrives with a later entry. A file that is gone is a row without code. Both are told apart by `error`.

Options: path, log (a folder for this stream alone; by default a hidden one below path), repo_id,
commit_sha, ignore_patterns, max_files, max_bytes, partition_bytes, partitions. With a trigger of
`availableNow` Spark asks such a source once, so a run takes one batch.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..lang.registry import language_of
from .tree import PARTITION_BYTES, dealt, walk
from .tree import SCHEMA as TREE

SCHEMA = TREE + ", arrived timestamp"
MAX_FILES, MAX_BYTES = 10_000, 1 << 30
#: Entries after which the log is summed up.
SNAPSHOT = 100


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int | None, int, int]]):
        self.files = files  # path, size (None: gone), time of change, time of arrival in microseconds


class ArrivalLog:
    """Numbered entries in a folder, and snapshots of what all entries up to a number have seen."""

    def __init__(self, folder: str):
        self.folder = folder

    def numbers(self, kind: str) -> list[int]:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(f".{kind}"))

    def read(self, number: int, kind: str = "entry") -> dict:
        with open(f"{self.folder}/{number}.{kind}", encoding="utf-8") as f:
            return json.load(f)

    def write(self, number: int, content: dict, kind: str = "entry") -> None:
        """Whole or not at all; fails where that entry is there, as then another stream uses this log."""
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{number}.{kind}"
        with open(f"{path}.{os.getpid()}.tmp", "w", encoding="utf-8") as f:
            json.dump(content, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f.name, path)
        finally:
            os.unlink(f.name)

    def seen(self, upto: int | None = None) -> tuple[int, dict[str, list[int]]]:
        """The last number, and path: [size, time] of all files that are there as of it."""
        base = max((n for n in self.numbers("snapshot") if upto is None or n <= upto), default=0)
        found = self.read(base, "snapshot")["seen"] if base else {}
        last = base
        for n in self.numbers("entry"):
            if n > base and (upto is None or n <= upto):
                for path, size, changed in self.read(n)["files"]:
                    if size is None:
                        found.pop(path, None)
                    else:
                        found[path] = [size, changed]
                last = n
        return last, found

    def sum_up(self, upto: int) -> None:
        if upto not in self.numbers("snapshot"):
            self.write(upto, {"seen": self.seen(upto)[1]}, "snapshot")
        for kind, before in (("entry", upto - SNAPSHOT), ("snapshot", upto)):  # Spark may ask for some batches again
            for n in self.numbers(kind):
                if n <= before - (kind == "snapshot"):
                    os.unlink(f"{self.folder}/{n}.{kind}")


class ArrivalsReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.own = json.loads(options.get("languages", "{}"))
        self.path = options["path"]
        self.log = ArrivalLog(options.get("log") or os.path.join(self.path, ".factloom-arrivals"))
        self.last: int | None = None
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def listed(self) -> dict[str, list[int]]:
        ignored = [p for p in self.options.get("ignore_patterns", "").split(",") if p]
        found = {}
        for path in walk(self.path):
            if language_of(path, self.own) and not any(fnmatch(path, p) or p in path for p in ignored):
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                found[path] = [stat.st_size, stat.st_mtime_ns]
        return found

    def latestOffset(self) -> dict:
        if self.last is None:
            self.last, self.known = self.log.seen()
        found = self.listed()
        new = sorted(((sign[1], path, sign[0]) for path, sign in found.items() if self.known.get(path) != sign))
        files: list[tuple[str, int | None, int]] = []
        size = 0
        for changed, path, n in new:
            if files and (len(files) >= int(self.options.get("max_files", MAX_FILES)) or size + n > int(self.options.get("max_bytes", MAX_BYTES))):
                break
            files.append((path, n, changed))
            size += n
        files += [(path, None, sign[1]) for path, sign in self.known.items() if path not in found]
        if files:
            self.log.write(self.last + 1, {"arrived": time.time_ns() // 1000, "files": files})
            self.last += 1
            for path, n, changed in files:
                if n is None:
                    del self.known[path]
                else:
                    self.known[path] = [n, changed]
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found = []
        for n in range(start["entry"] + 1, end["entry"] + 1):
            entry = self.log.read(n)
            found += [((size or 0), (path, size, changed, entry["arrived"])) for path, size, changed in entry["files"]]
        each, least = int(self.options.get("partition_bytes", PARTITION_BYTES)), int(self.options.get("partitions", "8"))
        return [Files(files) for files in dealt(found, each, least)] if found else []

    def read(self, partition: Files) -> Iterator[tuple]:
        import datetime as d

        repo, sha = self.options.get("repo_id", "unknown"), self.options.get("commit_sha", "HEAD")
        for path, size, changed, arrived in partition.files:
            own = (repo, sha, path, language_of(path, self.own))
            at = d.datetime.fromtimestamp(arrived / 1e6, d.timezone.utc)
            if size is None:
                yield *own, None, None, None, at
                continue
            try:
                with open(path, "rb") as f:
                    raw = f.read()
                stat = os.stat(path)
                if (stat.st_size, stat.st_mtime_ns) != (size, changed):
                    yield *own, None, None, "changed since it was listed", at
                else:
                    yield *own, raw.decode("utf-8"), len(raw), None, at
            except (OSError, UnicodeDecodeError) as e:
                yield *own, None, None, str(e), at

    def commit(self, end: dict) -> None:
        if end["entry"] and end["entry"] % SNAPSHOT == 0:
            self.log.sum_up(end["entry"])


class SourceArrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_arrivals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ArrivalsReader:
        return ArrivalsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceArrivals)
