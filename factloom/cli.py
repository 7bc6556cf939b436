"""python -m factloom.cli lens|query|diff|review|status"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from .config import Config
from .engine import QUERIES, Engine
from .session import session
from .sources.git import repo_context


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom")
    top.add_argument("--config", default=".factloom.toml")
    top.add_argument("--store")
    top.add_argument("--output", choices=("text", "json"), default="text")
    top.add_argument("--limit", type=int, default=100, help="rows that are shown")
    commands = top.add_subparsers(dest="command", required=True)
    lens = commands.add_parser("lens")
    lens.add_argument("paths", nargs="*", default=["."])
    lens.add_argument("--language")
    lens.add_argument("--prune", action="store_true", help="drop stored facts of files that are gone")
    query = commands.add_parser("query")
    query.add_argument("name", choices=sorted(QUERIES))
    query.add_argument("--commit")
    query.add_argument("--path", default=".")
    for name in ("diff", "review"):
        c = commands.add_parser(name)
        c.add_argument("spec", nargs="?")
        c.add_argument("--goal", default="")
        if name == "diff":
            mode = c.add_mutually_exclusive_group()
            mode.add_argument("--patch")
            mode.add_argument("--stdin", action="store_true")
            mode.add_argument("--before")
            c.add_argument("--after")
            c.add_argument("-f", "--files", action="append")
            c.add_argument("--language")
        else:
            c.add_argument("-q", "--queries", action="append")
    commands.add_parser("status")
    return top


def show(df: DataFrame, how: str, limit: int) -> None:
    if how == "json":
        for row in df.limit(limit).toJSON().toLocalIterator():
            print(row)
    else:
        df.show(limit, truncate=False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config.load(args.config)
    if args.command == "status":
        repo, sha = repo_context(".")
        print(f"repo {config.repo_id or repo} at {sha:.8}; store {config.resolve_store(args.store)}")
        return 0
    engine = Engine(session("local[*]"), config.resolve_store(args.store), config.repo_id)
    if args.command == "lens":
        show(engine.lens(args.paths, args.language, config.ignore_patterns, args.prune).groupBy("predicate").count(), args.output, args.limit)
    elif args.command == "query":
        facts = None if engine.store else engine.lens([args.path], ignore=config.ignore_patterns)
        show(engine.query(args.name, args.commit, facts), args.output, args.limit)
    else:
        text = pair = None
        if args.command == "diff" and (args.patch or args.stdin):
            text = sys.stdin.read() if args.stdin else open(args.patch, encoding="utf-8").read()
        elif args.command == "diff" and args.before:
            pair = (args.after, open(args.before, encoding="utf-8").read(), open(args.after, encoding="utf-8").read())
        diffs = engine.diffs(args.spec, ".", text, pair, getattr(args, "files", None))
        if diffs.isEmpty():
            print("no changes")
            return 0
        if args.command == "diff":
            parts = engine.diff(diffs, args.goal, args.language)
        else:
            parts = engine.review(diffs, args.goal, tuple(args.queries or ("orphans", "test_gaps")))
        for name, df in parts.items():
            print(name)
            show(df, args.output, args.limit)
    return 0


if __name__ == "__main__":
    sys.exit(main())
