"""The engine: lens (source to facts), named queries, diff and review."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang.registry import language_of, own_extensions
from .operators import diff as compare
from .operators import queries as q
from .operators.extract import FACTS, Relations, extract_facts
from .operators.sketches import estimates, file_sketches, merged
from .operators.store import KEY, cut, exists, read_manifest, unknown_files, upsert
from .sources import git, listing, patch, tree

QUERIES: dict[str, Callable[[Relations], DataFrame]] = {
    "orphans": q.orphans,
    "test_gaps": q.test_gaps,
    "intent_mismatches": q.intent_mismatches,
    "dependency_cycles": q.dependency_cycles,
    "security_concerns": q.security_concerns,
    "hotspots": lambda r: q.complexity(r).orderBy(F.desc("complexity"), "name", "file_path").limit(20),
    "summary": q.summary,
}


#: Of the parsers; facts of another version are extracted anew.
VERSION = "3"
#: Folders of a store that files are dealt to; a lens rewrites those of changed files. Fixed for all stores.
BUCKETS = 64


class Engine:
    """store: a folder for facts; beside it lie `<store>.manifest` (which files, by checksum and last
    commit, the facts stand for), `<store>.sketches` and `<store>.changes`."""

    def __init__(self, spark: SparkSession, store: str | None = None, repo_id: str | None = None):
        self.spark, self.store, self.repo_id = spark, store, repo_id
        #: Files that the last lens() with a store read as text.
        self.parsed = 0
        listing.register(spark)
        tree.register(spark)
        git.register(spark)

    def listing(self, paths: list[str], language: str | None = None, ignore: list[str] | None = None) -> DataFrame:
        """The files of source trees by name and size; tasks list the folders."""
        first = paths[0] if paths else "."
        repo, sha = git.repo_context(os.path.dirname(first) or "." if os.path.isfile(first) else first)
        read = self.spark.read.format("source_listing").option("path", ",".join(paths or ["."])).option("cwd", os.getcwd())
        read = read.option("repo_id", self.repo_id or repo).option("commit_sha", sha)
        found = read.option("ignore_patterns", ",".join(ignore or [])).option("languages", own_extensions()).load()
        return found.where(F.col("language") == language.lower()) if language else found

    def files(self, paths: list[str], language: str | None = None, ignore: list[str] | None = None) -> DataFrame:
        return listing.read_code(listing.dealt_by_size(self.listing(paths, language, ignore)))

    def lens(self, paths: list[str], language: str | None = None, ignore: list[str] | None = None, prune: bool = False) -> DataFrame:
        """Facts of source trees. With a store, only files whose checksum it doesn't know are read as text
        and parsed, and replace their facts there; with prune, files that are gone from these trees lose theirs."""
        if not self.store:
            return extract_facts(self.files(paths, language, ignore))
        signed = cut(listing.checksums(listing.dealt_by_size(self.listing(paths, language, ignore))), "signed")
        changed = cut(unknown_files(signed, f"{self.store}.manifest", VERSION), "changed")
        self.parsed = changed.count()
        replaced = changed.select(*KEY)
        if prune:
            replaced = replaced.unionByName(self.gone(paths, signed))
        facts = cut(extract_facts(listing.read_code(changed)), "facts")
        self.log_changes(changed, replaced, facts)
        upsert(facts, self.store, BUCKETS, replaced)
        upsert(file_sketches(Relations(facts)), f"{self.store}.sketches", BUCKETS, replaced)
        # last, so that a run that fails before is done again
        seen = signed.select(*KEY, "commit_sha", "checksum", F.lit(VERSION).alias("version"))
        upsert(seen.where("checksum is not null"), f"{self.store}.manifest", BUCKETS, signed.select(*KEY).unionByName(replaced))
        return self.facts()

    def log_changes(self, changed: DataFrame, replaced: DataFrame, facts: DataFrame) -> None:
        """Adds to `<store>.changes` the functions of these files that differ from those that the store has.

        A run is named by the files it found, so one that failed and is done again writes the same folder.
        """
        if not exists(self.spark, self.store):
            return
        own = changed.agg(F.coalesce(F.sum(F.xxhash64(*KEY, "checksum").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()[0]
        before = Relations(self.facts().join(replaced.distinct(), KEY, "left_semi"))
        found = compare.function_diff(before, Relations(facts)).select("repo_id", "file_path", "name", "change")
        sha = changed.select("repo_id", "commit_sha").distinct()
        found.join(sha, "repo_id", "left").write.mode("overwrite").parquet(f"{self.store}.changes/run={own}")

    def changes(self) -> DataFrame:
        """repo_id, file_path, name, changes: how often lens() has found a function's signature or calls modified."""
        if not exists(self.spark, f"{self.store}.changes"):
            return self.facts().select("repo_id", "file_path", "name", F.lit(0).cast("long").alias("changes")).limit(0)
        log = self.spark.read.schema("repo_id string, file_path string, name string, change string, commit_sha string").parquet(f"{self.store}.changes")
        return log.where("change = 'modified'").groupBy("repo_id", "file_path", "name").agg(F.count("*").alias("changes"))

    def gone(self, paths: list[str], found: DataFrame) -> DataFrame:
        """Files of the manifest below these paths that the listing no longer has."""
        manifest = f"{self.store}.manifest"
        if not exists(self.spark, manifest):
            return found.select(*KEY).limit(0)
        below = F.lit(False)
        for path in paths or ["."]:
            below = below | (F.col("file_path") == path) | F.startswith("file_path", F.lit(os.path.join(path, "")))
        repo = found.select("repo_id").distinct()
        return read_manifest(self.spark, manifest).where(below).select(*KEY).join(repo, "repo_id", "left_semi").join(found.select(*KEY), KEY, "left_anti")

    def facts(self, commit: str | None = None) -> DataFrame:
        """Stored facts; of a commit, those of the files that were last seen in it, whenever they were parsed."""
        stored = self.spark.read.schema(FACTS).parquet(self.store)
        if commit is None:
            return stored
        if not exists(self.spark, f"{self.store}.manifest"):
            return stored.where(F.col("commit_sha") == commit)
        seen = read_manifest(self.spark, f"{self.store}.manifest").where(F.col("commit_sha") == commit).select(*KEY)
        return stored.join(seen, KEY, "left_semi").withColumn("commit_sha", F.lit(commit)).select(*FACTS.names)

    def sketches(self, by: list[str]) -> DataFrame:
        """Counts, distinct callees and quantiles of complexity of the store's files by any of their columns."""
        return estimates(merged(self.spark.read.parquet(f"{self.store}.sketches"), by))

    def query(self, name: str, commit: str | None = None, facts: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
        """history: stored commits in order (commit_sha, ordinal), by which hotspots rates change; without it by
        the changes that the store has logged, and without a store by complexity alone."""
        if name == "hotspots" and history is not None:
            return q.hotspots(Relations(self.facts(commit) if facts is None else facts), Relations(self.facts()), history)
        if name == "hotspots" and self.store and facts is None:
            return q.hotspots_by(Relations(self.facts(commit)), self.changes())
        if name not in QUERIES:
            raise ValueError(f"unknown query {name!r}; there are {sorted(QUERIES)}")
        return QUERIES[name](Relations(self.facts(commit) if facts is None else facts))

    def diffs(self, spec: str | None = None, repo: str = ".", patch_text: str | None = None, pair: tuple[str, str, str] | None = None, only: list[str] | None = None) -> DataFrame:
        """File diffs of a git spec, a patch, or one pair (path, before, after); one of them at a time."""
        if sum(x is not None for x in (spec, patch_text, pair)) > 1:
            raise ValueError("a spec, a patch and a pair of files exclude one another")
        if patch_text is not None:
            found = self.spark.createDataFrame([(d,) for d in [patch_text]], "text string")
            found = patch.parse_patches(found.withColumn("id", F.lit(0)), "id").drop("id", "file")
        elif pair is not None:
            found = self.spark.createDataFrame([(pair[0], language_of(pair[0]), "modified", pair[1], pair[2])], git.SCHEMA)
        else:
            read = self.spark.read.format("git_diff").option("path", os.path.abspath(repo)).option("languages", own_extensions())
            found = (read.option("spec", spec) if spec else read).load()
        if only:
            found = found.where(F.exists(F.array(*map(F.lit, only)), lambda p: F.contains(F.col("path"), p)))
        return found

    def diff(self, diffs: DataFrame, goal: str = "", language: str | None = None) -> dict[str, DataFrame]:
        before, after = compare.diff_facts(diffs, language)
        changed = compare.function_diff(before, after)
        return {"changes": changed, "alignment": compare.alignment(changed, goal), "concerns": compare.concerns(before, after, goal)}

    def review(self, diffs: DataFrame, goal: str = "", queries: tuple[str, ...] = ("orphans", "test_gaps")) -> dict[str, DataFrame]:
        """The parts of a review as tables; those that fail are rows of `errors`."""
        return compare.settled_review(self.spark, compare.review_parts(diffs, goal, queries))
