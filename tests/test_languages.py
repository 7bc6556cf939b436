"""Languages of one's own, and SQL functions against their column forms."""

import re

import pytest
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.functions import scalar
from factloom.lang import register_language, remove_language
from factloom.operators import udtf
from factloom.operators.extract import Relations, extract_facts, file_counts

DEFINES = re.compile(r"^routine (\w+)((?: \w+)*)$")
FILES = "repo_id string, commit_sha string, file_path string, language string, code string"
CODE = "routine start x y\ncall stop\nneeds lib.core\nroutine stop\n"


def toy(code, facts):
    """A language of lines: routine name params, call name, needs module."""
    inside = None
    for n, line in enumerate(code.split("\n"), 1):
        if found := DEFINES.match(line):
            params = found[2].split()
            inside = facts.function(facts.module_id, found[1], len(params), "public", n, [(p, None) for p in params])
        elif line.startswith("call ") and inside:
            facts.call(inside, line[5:], n)
        elif line.startswith("needs "):
            facts.depends(facts.module_id, line[6:], "needs", n)


@pytest.fixture
def language():
    register_language("toy", ("toy", "ty"), toy, "::")
    yield
    remove_language("toy")


def test_a_language_in_dataframes(spark, language):
    files = spark.createDataFrame([("r", "c", "src/a.toy", "toy", CODE), ("r", "c", "b.py", "python", "def f(): pass\n")], FILES).repartition(2)
    r = Relations(extract_facts(files))
    assert {(x["name"], x["arity"], x["func_id"], x["module_id"]) for x in r.function.where("language = 'toy'").collect()} == {("start", 2, "start_2", "src__a"), ("stop", 0, "stop_0", "src__a")}
    assert [(x["caller_id"], x["called_func"], x["line"]) for x in r.calls_external.collect()] == [("start_2", "stop", 2)]
    assert [(x["dep_name"], x["kind"]) for x in r.depends_on.collect()] == [("lib.core", "needs")]
    assert [(x["module_name"]) for x in r.module.where("language = 'toy'").collect()] == ["src::a"]
    counts = {x["file_path"]: (x["functions"], x["calls"], x["dependencies"]) for x in file_counts(files).collect()}
    assert counts == {"src/a.toy": (2, 1, 1), "b.py": (1, 0, 0)}


def test_a_language_in_sql(spark, language):
    udtf.register(spark)
    scalar.register_functions(spark)
    spark.createDataFrame([("src/a.ty", CODE)], "path string, code string").createOrReplaceTempView("toys")
    rows = spark.sql("SELECT fl_module_id(path, language) AS m, fl_module_name(path, 'toy') AS n, t.predicate, t.func_id FROM (SELECT *, fl_language(path) AS language FROM toys) toys, LATERAL fl_lens(code, language, path, 'c') t WHERE t.func_id IS NOT NULL").collect()
    assert {(r["m"], r["n"]) for r in rows} == {("src__a", "src::a")} and {r["func_id"] for r in rows} == {"start_2", "stop_0"}


def test_a_language_in_the_engine(spark, language, tmp_path):
    (tmp_path / "a.toy").write_text(CODE)
    (tmp_path / "b.ty").write_text("routine other\ncall start\n")
    facts = Engine(spark).lens([str(tmp_path)])
    assert sorted(r["name"] for r in Engine(spark).query("orphans", facts=facts).collect()) == ["other"]
    tree = spark.read.format("source_tree").option("path", str(tmp_path)).option("languages", '{"toy": "toy"}').load()
    assert [r["language"] for r in tree.collect()] == ["toy"]


def test_parsers_of_users_may_fail(spark):
    def broken(code, facts):
        facts.call("x", "y", 1)
        raise KeyError("nothing")

    register_language("broken", ("brk",), broken)
    try:
        rows = extract_facts(spark.createDataFrame([("r", "c", "a.brk", "broken", "x")], FILES)).collect()
        assert [r["predicate"] for r in rows] == ["module", "calls_external", "error"]
    finally:
        remove_language("broken")
    assert extract_facts(spark.createDataFrame([("r", "c", "a.brk", "broken", "x")], FILES)).count() == 0


@pytest.mark.parametrize("name,extensions", [("python", ("p9",)), ("another", ("py",))])
def test_names_and_extensions_that_are_taken(name, extensions):
    with pytest.raises(ValueError, match="taken"):
        register_language(name, extensions, toy)


IMPORTS = {
    "python": ["import os", "import os.path as p", "from a.b import c", "from x", "from", "import ", "x = 1", "import a, b"],
    "rust": ["use std::io;", "use a::b as c;", "use ", "mod x;", "use x;;"],
    "javascript": ["import x from 'a/b';", 'import {y} from "c"', "import 'side'", "from from 'z'", "import x from y", "from \"it's\""],
    "go": ['import "fmt"', 'import (\n\t"a"\n\tb "c/d"\n)', "import x", 'import ""'],
    "ruby": ["require 'set'", 'require_relative "x/y"', "require x", "require ''"],
}


def slow_imports(text, language):
    if language == "python":
        parts = text.split()
        if text.startswith("import "):
            return [(text[7:].split() or [""])[0]]
        return [parts[1]] if text.startswith("from ") and len(parts) >= 2 else []
    if language == "rust":
        return [text[4:].split()[0].rstrip(";").replace("::", ".")] if text.startswith("use ") and text[4:].split() else []
    if language == "go":
        return [m[1] for line in text.splitlines() if (m := re.search('"([^"]*)"', line))]
    if language == "javascript":
        at = text.find("from")
        found = re.search("[\"']([^\"']*)[\"']", text[at:]) if at >= 0 else None
        return [found[1]] if found else []
    found = re.search("[\"']([^\"']*)[\"']", text)
    return [found[1]] if found else []


def test_import_names(spark):
    scalar.register_functions(spark)
    for language, texts in IMPORTS.items():
        df = spark.createDataFrame([(t,) for t in texts], "s string")
        for r in df.select("s", scalar.import_names("s", language).alias("a"), F.expr(f"fl_import_names(s, '{language}')").alias("b")).collect():
            assert r["a"] == r["b"] == slow_imports(r["s"], language), (language, r)


TEXTS = ["", "a.b(c)", "x\ny(z)", " it's \\ a\ttab\r", "__init__", "_p", "__q", "Über", "ünder", "(a , b)", "x" * 100, "a::b", "src/a.b.py", ".py", "m.tsx", "a\\b.rs.rs", "x.unknown"]
SPECS = [None, "HEAD", "a..b", "a...b", "a...b..c", "..b", "git@h:o/r.git", "https://h/o/r.git/", "ssh://git@h/x.git", "file:///x", "https://h/"]


def test_sql_functions_equal_columns(spark):
    scalar.register_functions(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS + SPECS], "s string")
    pairs = {
        "fl_normalize_id(s)": scalar.normalize_id("s"), "fl_escape(s)": scalar.escape_text("s"), "fl_clean_param(s)": scalar.clean_param("s"),
        "fl_sanitize_callee(s)": scalar.sanitize_callee("s"), "fl_callee_base(s)": scalar.callee_base("s"), "fl_language(s)": scalar.language("s"),
        "fl_diff_mode(s)": scalar.diff_mode("s"), "fl_repo_id(s)": scalar.repo_id("s"), "fl_checksum(s)": scalar.checksum("s"), "fl_loc(s)": scalar.loc("s"),
        "fl_function_id(s, 2)": scalar.function_id("s", F.lit(2)), "fl_function_id(s, 0, 'pre')": scalar.function_id("s", F.lit(0), F.lit("pre")),
    }
    for language in ("python", "go", "rust", "typescript", "prolog"):
        pairs |= {f"fl_module_name(s, '{language}')": scalar.module_name("s", language), f"fl_module_id(s, '{language}')": scalar.module_id("s", language)}
        pairs[f"fl_visibility(s, '{language}')"] = scalar.visibility("s", language)
    given = df.where("s is not null or true")
    for sql, column in pairs.items():
        rows = given.select("s", F.expr(sql).alias("a"), column.alias("b")).collect()
        differing = [(r["s"], r["a"], r["b"]) for r in rows if r["a"] != r["b"] and not (r["s"] is None and "visibility" in sql)]
        assert not differing, (sql, differing)
