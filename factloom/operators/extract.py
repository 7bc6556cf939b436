"""Source files to facts, and facts to typed relations.

Parsing is the only Python here: one map over files with no shuffle. Everything after it is
DataFrame work on the relations.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import COLUMNS, file_facts, own_languages
from ..lang.registry import EXTENSIONS
from ..functions.scalar import checksum, escape_text, loc

PROVENANCE = ("repo_id", "commit_sha", "file_path")
_LONGS = frozenset(("seq", "line", "arity", "position", "called_arity"))
#: All facts in one sparse table; a predicate fills the columns of its relation.
FACTS = T.StructType(
    [*(T.StructField(c, T.StringType()) for c in (*PROVENANCE, "language")), *(T.StructField(c, T.LongType() if c in _LONGS else T.StringType()) for c in COLUMNS)]
)
#: Columns of each relation, after provenance and seq.
RELATIONS = {
    "module": ("module_id", "module_name", "filepath", "line"),
    "function": ("func_id", "module_id", "name", "arity", "visibility", "line"),
    "function_line": ("func_id", "line"),
    "function_visibility": ("func_id", "visibility"),
    "function_param": ("func_id", "position", "name", "type"),
    "depends_on": ("module_id", "dep_name", "kind", "line"),
    "calls_external": ("caller_id", "called_module", "called_func", "called_arity", "line"),
    # what a module's declaration lists; of no text form, and not counted among facts
    "export": ("module_id", "func_id", "name", "arity", "line"),
}
#: Counts of a file, and the predicates whose facts they count; loc are its lines.
COUNTED = {"modules": "module", "functions": "function", "calls": "calls_external", "dependencies": "depends_on"}
COUNTS = (*COUNTED, "loc")
KNOWN = sorted({language for _, language, _, _ in EXTENSIONS})
#: Facts of a batch that leaves a parser, about.
FLUSH = 8_192
FILES = "repo_id string, commit_sha string, file_path string, language string, code string"


def extract_facts(files: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """files: repo_id, commit_sha, file_path, language, code. One row for each fact.

    Files without code or of an unknown language yield nothing. A parser never fails a task: what it
    can't read is a fact of predicate `error`. predicates: those wanted, all if left out.
    """
    wanted = frozenset(predicates) if predicates else None
    arrow = pa.schema([(f.name, pa.int64() if f.name in _LONGS else pa.string()) for f in FACTS])
    own = own_languages()
    with_calls = not wanted or "calls_external" in wanted

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of equal columns together: those that they lack are filled at once
        held: dict[tuple[str, ...], dict[str, list]] = {}
        size = 0

        def full() -> Iterator[pa.RecordBatch]:
            for columns in held.values():
                n = len(columns["predicate"])
                for a in range(0, n, FLUSH):
                    b = min(a + FLUSH, n)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][a:b], f.type) if f.name in columns else pa.nulls(b - a, f.type) for f in arrow], schema=arrow)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                file = {c: batch[c][i].as_py() for c in batch.schema.names}
                groups: dict[tuple[str, ...], list[dict]] = {}
                for r in file_facts(file["code"], file["language"], file["file_path"], own, with_calls):
                    if not wanted or r["predicate"] in wanted:
                        groups.setdefault(tuple(r), []).append(r)
                for names, rows in groups.items():
                    columns = held.setdefault(names, {c: [] for c in (*PROVENANCE, "language", *names)})
                    for c, values in zip(names, zip(*map(dict.values, rows), strict=True), strict=True):
                        columns[c].extend(values)
                    for c in (*PROVENANCE, "language"):
                        columns[c].extend([file[c]] * len(rows))
                    size += len(rows)
                if size >= FLUSH:
                    yield from full()
                    size = 0
        yield from full()

    return files.select("repo_id", "commit_sha", "file_path", "language", "code").where(F.col("code").isNotNull() & F.col("language").isin([*KNOWN, *own])).mapInArrow(parse, FACTS)


def file_counts(files: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """repo_id, commit_sha, file_path, language, the columns of `carried`, checksum and COUNTS of each file, in one map.

    A file without code has no checksum and counts of 0; one of an unknown language has its lines only.
    """
    carried, own = carried or [], own_languages()
    known = {*KNOWN, *own}
    given = files.select(*PROVENANCE, "language", *carried, checksum("code").alias("checksum"), F.coalesce(loc("code"), F.lit(0)).alias("loc"), "code")
    schema = T.StructType([*(f for f in given.schema if f.name not in ("code", "loc")), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in COUNTED}
            for code, language, path in zip(*(batch.column(c).to_pylist() for c in ("code", "language", "file_path")), strict=True):
                found = Counter(r["predicate"] for r in file_facts(code, language, path, own)) if code is not None and language in known else Counter()
                for c, predicate in COUNTED.items():
                    columns[c].append(found[predicate])
            kept = [batch.column(f.name) for f in schema if f.name not in COUNTS]
            yield pa.RecordBatch.from_arrays([*kept, *(batch.column("loc") if c == "loc" else pa.array(columns[c], pa.int64()) for c in COUNTS)], names=schema.names)

    return given.mapInArrow(counted, schema)


@dataclass
class Relations:
    """The typed relations of a table of facts."""

    facts: DataFrame

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            raise AttributeError(name)
        return self.facts.where(F.col("predicate") == name).select(*PROVENANCE, "language", "seq", *RELATIONS[name])

    def files(self) -> DataFrame:
        return self.module.where(F.col("seq") == 0).select(*PROVENANCE, "module_id", "module_name")


def _quoted(c: str) -> Column:
    return F.concat(F.lit("'"), escape_text(F.coalesce(F.col(c), F.lit(""))), F.lit("'"))


def render(facts: DataFrame) -> DataFrame:
    """facts with the column `fact`: the canonical text of each, e.g. function_line('f_0', 3)."""
    number = lambda c: F.col(c).cast("string")
    arguments = {
        "module": [_quoted("module_id"), _quoted("module_name"), _quoted("filepath"), number("line"), _quoted("commit_sha")],
        "function": [_quoted("func_id"), _quoted("module_id"), _quoted("name"), number("arity"), F.col("visibility"), number("line"), _quoted("commit_sha")],
        "function_line": [_quoted("func_id"), number("line")],
        "function_visibility": [_quoted("func_id"), F.col("visibility")],
        "function_param": [_quoted("func_id"), number("position"), _quoted("name"), F.when(F.col("type").isNull(), F.lit("unknown")).otherwise(_quoted("type"))],
        "depends_on": [_quoted("module_id"), _quoted("dep_name"), F.col("kind"), number("line")],
        "calls_external": [_quoted("caller_id"), _quoted("called_module"), _quoted("called_func"), number("called_arity"), number("line")],
    }
    texts = [(p, F.concat(F.lit(p + "("), F.concat_ws(", ", *a), F.lit(")."))) for p, a in arguments.items()]
    fact = reduce(lambda acc, x: acc.when(F.col("predicate") == x[0], x[1]), texts[1:], F.when(F.col("predicate") == texts[0][0], texts[0][1]))
    return facts.withColumn("fact", fact)


def file_summary(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Counts of each file, with its lines if the files (their code) are given; further clauses of a
    predicate aren't functions of their own."""
    if files is not None:
        return file_summary(facts).join(files.select(*PROVENANCE, loc("code").alias("loc")), list(PROVENANCE), "left")
    count = lambda p: F.count_if(F.col("predicate") == p)
    return facts.groupBy(*PROVENANCE, "language").agg(
        count("module").alias("modules"), count("function").alias("functions"), count("calls_external").alias("calls"), count("depends_on").alias("dependencies")
    )


def run_totals(facts: DataFrame) -> DataFrame:
    """One row: files, functions, facts and errors."""
    error = F.col("predicate") == "error"
    return facts.agg(
        F.count_if((F.col("predicate") == "module") & (F.col("seq") == 0)).alias("files"), F.count_if(F.col("predicate") == "function").alias("functions"),
        F.count_if(~error & (F.col("predicate") != "export")).alias("facts"), F.count_if(error).alias("errors"),
    )
