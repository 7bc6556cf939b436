"""Git as a data source: `spark.read.format("git_diff").option("path", repo).option("spec", "a..b")`.

Without a spec it compares the index with HEAD; a..b and a...b compare two trees (the second from the
merge base only with merge_base=true); any other spec compares a commit with its first parent.
Renames aren't sought: they are a deletion and an addition. Blobs are read in the tasks, by one
git process each; a task gets `partition_rows` changes at most, and there are `partitions` tasks at least.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..lang.registry import language_of

SCHEMA = "path string, language string, status string, before string, after string"
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
NO_BLOB = "0" * 40
PARTITION_ROWS = 1_000
STATUS = {"A": "added", "C": "added", "M": "modified", "D": "deleted", "R": "renamed"}


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, check=True).stdout


def parse_spec(spec: str | None) -> tuple[str, str | None, str | None]:
    """(mode, base, head)."""
    if spec is None:
        return "staged", None, None
    for mark in ("...", ".."):
        if mark in spec:
            base, _, head = spec.partition(mark)
            return "range", base, head
    return "commit", None, spec


def has_head(repo: str) -> bool:
    try:
        git(repo, "rev-parse", "--verify", "-q", "HEAD")
        return True
    except subprocess.CalledProcessError:
        return False


def changes(repo: str, spec: str | None, merge_base: bool = False) -> list[tuple[str, str, str, str]]:
    """(path, status, blob before, blob after) by path."""
    mode, base, head = parse_spec(spec)
    if mode == "staged":
        raw = git(repo, "diff-index", "--cached", "--no-renames", "--full-index", "-r", "-z", "HEAD" if has_head(repo) else EMPTY_TREE)
    else:
        if mode == "commit":
            parents = git(repo, "rev-list", "--parents", "-n1", head).decode().split()[1:]
            base = parents[0] if parents else EMPTY_TREE
        elif merge_base and "..." in spec:
            base = git(repo, "merge-base", base, head).decode().strip()
        raw = git(repo, "diff-tree", "--no-renames", "--full-index", "-r", "-z", base, head)
    out, parts = [], raw.split(b"\0")
    for meta, path in zip(parts[::2], parts[1::2], strict=False):
        fields = meta.decode().lstrip(":").split()
        if len(fields) == 5 and (status := STATUS.get(fields[4][0])):
            out.append((os.fsdecode(path), status, fields[2], fields[3]))
    return sorted(out)


class BlobReader:
    """Blobs of a repository by id, through one git process."""

    def __init__(self, repo: str):
        command = ["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"]
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def __enter__(self) -> BlobReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def text(self, oid: str) -> str | None:
        """Null where there is none, or it isn't UTF-8."""
        if set(oid) == {"0"}:
            return None
        self.process.stdin.write(oid.encode() + b"\n")
        self.process.stdin.flush()
        fields = self.process.stdout.readline().split()
        if not fields:  # the process is gone: an error of the task, not a blob that isn't there
            raise OSError(f"git cat-file ended before {oid}")
        if len(fields) != 3:
            return None
        raw = self.process.stdout.read(int(fields[2]))
        self.process.stdout.read(1)
        try:
            return raw.decode("utf-8") if fields[1] == b"blob" else None
        except UnicodeDecodeError:
            return None


def repo_context(path: str = ".") -> tuple[str, str]:
    """(repo_id, commit_sha): of the remote origin, of another remote, the folder's name, or unknown."""
    try:
        top = git(path, "rev-parse", "--show-toplevel").decode().strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown", "HEAD"
    remotes = git(top, "remote").decode().split()
    repo = None
    for remote in sorted(remotes, key=lambda r: r != "origin"):
        repo = repo or repo_id(git(top, "remote", "get-url", remote).decode().strip())
    sha = git(top, "rev-parse", "HEAD").decode().strip() if has_head(top) else "HEAD"
    return repo or os.path.basename(top) or "unknown", sha


def repo_id(url: str) -> str | None:
    """owner/repo of a remote's URL."""
    if url.startswith("git@") and ":" in url:
        path = url.split(":", 1)[1]
    elif url.startswith(("https://", "http://", "ssh://")) and "/" in url.split("://", 1)[1]:
        path = url.split("://", 1)[1].split("/", 1)[1]
    else:
        return None
    path = path.strip("/")
    while path.endswith(".git"):
        path = path[:-4]
    return path.strip("/") or None


class Blobs(InputPartition):
    def __init__(self, rows: list[tuple[str, str, str, str]]):
        self.rows = rows


class DiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.repo = options.get("path") or "."
        self.own = json.loads(options.get("languages", "{}"))

    def partitions(self) -> Sequence[InputPartition]:
        found = changes(self.repo, self.options.get("spec"), self.options.get("merge_base") == "true")
        most = int(self.options.get("partition_rows", PARTITION_ROWS))
        n = max(1, min(len(found), max(int(self.options.get("partitions", "8")), -(-len(found) // most))))
        return [Blobs(found[k::n]) for k in range(n)]

    def read(self, partition: Blobs) -> Iterator[tuple]:
        with BlobReader(self.repo) as blobs:
            for path, status, before, after in partition.rows:
                text = blobs.text(after)
                if text is None and status in ("added", "modified") and set(after) == {"0"}:
                    try:
                        with open(os.path.join(self.repo, path), encoding="utf-8") as f:
                            text = f.read()
                    except (OSError, UnicodeDecodeError):
                        text = None
                yield path, language_of(path, self.own), status, blobs.text(before), text


class GitDiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DiffReader:
        return DiffReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitDiff)
