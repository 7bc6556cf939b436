"""Sources, stores, patches, the engine and plans."""

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.cli import main
from factloom.config import Config
from factloom.engine import Engine
from factloom.functions import scalar
from factloom.operators import queries as q
from factloom.operators.extract import Relations, extract_facts, render
from factloom.operators.store import upsert
from factloom.sources import git, patch
from factloom.streaming import windows

PATCH = """garbage before
diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1,2 +1,2 @@ def f
 same
-old
+new
@@ -9 +9 @@

-a
\\ No newline at end of file
+b
diff --git a/new file.rs b/new file.rs
new file mode 100644
--- /dev/null
+++ b/new file.rs
@@ -0,0 +1 @@
+fn x() {}
diff --git "a/q d.txt" "b/q d.txt"
deleted file mode 100644
--- "a/q d.txt"
+++ /dev/null
@@ -1 +0,0 @@
-gone
diff --git a/a.go b/b.go
similarity index 100%
rename from a.go
rename to b.go
diff --git a/i.png b/i.png
index 1..2
Binary files differ
"""
WANT = [
    ("x.py", "python", "modified", "same\nold\n\na", "same\nnew\n\nb"),
    ("new file.rs", "rust", "added", None, "fn x() {}"),
    ("q d.txt", None, "deleted", "gone", None),
    ("b.go", "go", "renamed", None, None),
    ("i.png", None, "modified", None, None),
]


def test_patches(spark):
    assert list(patch.file_diffs(PATCH)) == WANT
    df = spark.createDataFrame([(1, PATCH), (2, ""), (3, None)], "id long, text string")
    found = patch.parse_patches(df, "id").orderBy("id", "file").select("path", "language", "status", "before", "after").collect()
    assert [tuple(r) for r in found] == WANT
    with pytest.raises(patch.MalformedPatch):
        list(patch.file_diffs("diff --git broken"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(" +-"), st.text(alphabet="ab c", max_size=6)), min_size=1, max_size=12))
def test_patch_round_trip(lines):
    text = "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n" + "\n".join(m + t for m, t in lines) + "\n"
    ((_, _, _, before, after),) = patch.file_diffs(text)
    before_lines, after_lines = [t for m, t in lines if m != "+"], [t for m, t in lines if m != "-"]
    # a removed line that starts with "--" and the like is a line all the same
    assert before == ("\n".join(before_lines) if before_lines else None)
    assert after == ("\n".join(after_lines) if after_lines else None)


@pytest.fixture
def repo(tmp_path):
    def run(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tmp_path), *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/__init__.py").write_text("def used():\n    pass\n\ndef lonely(a):\n    used()\n")
    (tmp_path / ".gitignore").write_text("ignored.py\n")
    (tmp_path / "ignored.py").write_text("def no(): pass\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "note.txt").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "pkg/__init__.py").write_text("def used(x):\n    pass\n")
    (tmp_path / "b.rs").write_text("fn f() {}\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    (tmp_path / "c.go").write_text("package c\n")
    run("add", "c.go")
    return tmp_path


def test_source_tree(spark, repo):
    engine = Engine(spark)
    rows = {r["file_path"].removeprefix(f"{repo}/"): r for r in engine.files([str(repo)]).collect()}
    assert rows.keys() == {"pkg/__init__.py", "bad.py", "b.rs", "c.go"}
    assert rows["bad.py"]["code"] is None and rows["bad.py"]["error"]
    assert [r["file_path"] for r in engine.files([str(repo)], "Rust").collect()] == [f"{repo}/b.rs"]
    assert {r["file_path"] for r in engine.files([str(repo)], ignore=["*.go", "pkg"]).collect()} == {f"{repo}/b.rs", f"{repo}/bad.py"}
    explicit = engine.files([f"{repo}/note.txt"]).collect()
    assert len(explicit) == 1 and explicit[0]["language"] is None


def test_sources_are_cut_by_size(spark, repo):
    engine = Engine(spark)
    engine.files([str(repo)]).count()  # registers the source
    tree = spark.read.format("source_tree").option("path", str(repo)).option("partitions", "1")
    assert tree.load().rdd.getNumPartitions() == 1
    assert tree.option("partition_bytes", "1").load().rdd.getNumPartitions() == 4
    engine.diffs("HEAD", str(repo)).count()
    diff = spark.read.format("git_diff").option("path", str(repo)).option("spec", "HEAD").option("partitions", "1")
    assert diff.load().rdd.getNumPartitions() == 1
    cut = diff.option("partition_rows", "1").load()
    assert cut.rdd.getNumPartitions() == 2 and cut.count() == 2


def test_blobs_come_from_one_process(repo):
    oids = {p: after for p, _, _, after in git.changes(str(repo), "HEAD~1")}
    with git.BlobReader(str(repo)) as blobs:
        assert blobs.text(oids["bad.py"]) is None  # not UTF-8
        assert blobs.text("1" * 40) is None and blobs.text("0" * 40) is None
        for path in (".gitignore", "note.txt", ".gitignore"):
            assert blobs.text(oids[path]) == (repo / path).read_text()


def test_git_diffs(spark, repo):
    engine = Engine(spark)
    found = lambda spec: sorted((r["path"], r["status"], r["before"], r["after"]) for r in engine.diffs(spec, str(repo)).collect())
    assert found(None) == [("c.go", "added", None, "package c\n")]
    two = found("HEAD")
    assert [(p, s) for p, s, _, _ in two] == [("b.rs", "added"), ("pkg/__init__.py", "modified")]
    assert found("HEAD~1..HEAD") == found("HEAD~1...HEAD") == two
    assert {p for p, *_ in found("HEAD~1")} == {".gitignore", "bad.py", "note.txt", "pkg/__init__.py"}
    parts = engine.review(engine.diffs("HEAD", str(repo)), "use x")
    assert {(r["name"], r["change"]) for r in parts["changes"].collect()} == {("used", "modified"), ("lonely", "deleted"), ("f", "added")}
    with pytest.raises(ValueError):
        engine.review(engine.diffs("HEAD", str(repo)), queries=("nothing",))


def test_engine_stores_and_queries(spark, repo, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store") / "facts")
    engine = Engine(spark, store)
    first = engine.lens([str(repo)])
    assert [r["name"] for r in engine.query("orphans").orderBy("name").collect()] == ["f", "used"]
    n = first.count()
    (repo / "b.rs").write_text("fn g() { used(); }\n")
    engine.lens([f"{repo}/b.rs"])
    assert [r["name"] for r in engine.query("orphans").collect()] == ["g"]
    assert engine.facts().count() == n + 1
    with pytest.raises(ValueError, match="orphans"):
        engine.query("nothing")


def test_upsert_replaces_only_these_files(spark, tmp_path):
    make = lambda rows: extract_facts(spark.createDataFrame(rows, "repo_id string, commit_sha string, file_path string, language string, code string"))
    path = str(tmp_path / "facts")
    upsert(make([("r", "c", f"f{i}.py", "python", f"def a{i}(): pass\n") for i in range(9)]), path)
    upsert(make([("r", "c", "f3.py", "python", "def b(): pass\n"), ("r", "c", "new.py", "python", "")]), path)
    names = {r["name"] for r in Relations(spark.read.parquet(path)).function.collect()}
    assert names == {*(f"a{i}" for i in range(9) if i != 3), "b"}


def test_rendering(spark):
    files = spark.createDataFrame([("r", "abc123", "my'mod.py", "python", "def f(x: unknown, y): pass\n")], "repo_id string, commit_sha string, file_path string, language string, code string")
    found = [r["fact"] for r in render(extract_facts(files)).orderBy("seq").collect()]
    assert found == [
        "module('my_mod', 'my\\'mod', 'my\\'mod.py', 1, 'abc123').",
        "function('f_2', 'my_mod', 'f', 2, public, 1, 'abc123').",
        "function_line('f_2', 1).",
        "function_visibility('f_2', public).",
        "function_param('f_2', 0, 'x', 'unknown').",
        "function_param('f_2', 1, 'y', unknown).",
    ]


def test_scalar_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    text = lambda s: F.lit(s)
    for url, want in [
        ("git@h:o/r.git", "o/r"), ("https://h/o/r.git/", "o/r"), ("http://h/o/r", "o/r"), ("ssh://git@h/o/r.git", "o/r"), ("file:///x", None), ("https://h/", None), ("git@h", None),
    ]:
        assert value(scalar.repo_id(text(url))) == git.repo_id(url) == want
    for spec in (None, "HEAD", "a..b", "a...b", "a...b..c", "..b"):
        assert tuple(value(scalar.diff_mode(F.lit(spec).cast("string")))) == git.parse_spec(spec)
    assert value(scalar.lines_of_code(text("a\nb"))) == value(scalar.lines_of_code(text("a\nb\n"))) == 2
    assert value(scalar.lines_of_code(text(""))) == 0
    assert value(scalar.sanitize_callee(text("a.b\n.c(x)"))) == "c"
    assert value(scalar.escape_text(text("a'\\\n"))) == "a\\'\\\\\\n"
    assert value(scalar.visibility(text("__x"), "python")) == "private"


def test_config(tmp_path):
    path = str(tmp_path / "c.toml")
    made = Config("s", "o/r", ['a"b', "c"])
    made.save(path)
    assert Config.load(path) == made and Config.load(path + "x") == Config()
    (tmp_path / "bad.toml").write_text("= nonsense")
    with pytest.warns(UserWarning):
        assert Config.load(str(tmp_path / "bad.toml")) == Config()
    assert made.resolve_store("arg") == "arg"


def test_command_line(repo, spark, monkeypatch, capsys):
    monkeypatch.chdir(repo)
    monkeypatch.setattr("factloom.cli.session", lambda master: spark)
    assert main(["status"]) == 0
    assert main(["--output", "json", "query", "orphans"]) == 0
    assert main(["--output", "json", "diff", "HEAD"]) == 0
    assert '"lonely"' in capsys.readouterr().out


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "e", m % 2) for m in range(0, 60, 7)]
    events = spark.createDataFrame(rows, "ts string, event_type string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/in")
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "10 minutes")
    run = stream.writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("streamed")) == key(windows.tumbling(events, "10 minutes"))


def test_arriving_files_count_once(spark):
    files = spark.createDataFrame([("r", "c", "a.py", "python", "x"), ("r", "d", "a.py", "python", "x"), ("r", "d", "a.py", "python", "y")], "repo_id string, commit_sha string, file_path string, language string, code string")
    assert windows.arrivals(spark, files, "arrivals").count() == 2


def test_plans(spark, tmp_path):
    files = spark.createDataFrame([("r", "c", "a.py", "python", "def f(): g()\n")], "repo_id string, commit_sha string, file_path string, language string, code string")
    path = str(tmp_path / "facts")
    extract_facts(files).write.partitionBy("predicate").parquet(path)
    r = Relations(spark.read.parquet(path))
    plan = q.orphans(r)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "PartitionFilters" in plan
    assert "LeftAnti" in plan


def test_a_part_of_a_review_that_fails_is_reported(spark, repo, monkeypatch):
    from factloom.operators import diff

    engine = Engine(spark)
    diffs = engine.diffs("HEAD", str(repo))
    parts = diff.review_parts(diffs, "use x")
    parts["concerns"] = lambda: 1 / 0
    parts["test_gaps"] = lambda: spark.range(3).select(F.raise_error(F.lit("broken while it runs")))
    found = diff.settled_review(spark, parts)
    assert found.keys() == {"changes", "alignment", "orphans", "errors"} and found["changes"].count() == 3
    errors = {r["part"]: (r["kind"], r["message"]) for r in found["errors"].collect()}
    assert errors.keys() == {"concerns", "test_gaps"} and errors["concerns"][0] == "ZeroDivisionError" and "broken while it runs" in errors["test_gaps"][1]
    assert engine.review(diffs)["errors"].count() == 0


def test_clauses_nested_too_deep_are_reported(spark):
    from factloom.lang import file_facts

    code = "p(X) :- q(" + "f(" * 300 + "X" + ")" * 300 + ").\nr(X) :- s(X).\n"
    rows = file_facts(code, "prolog", "a.pl")
    assert [r["name"] for r in rows if r["predicate"] == "function"] == ["r"]
    assert [(r["line"], "nested" in r["name"]) for r in rows if r["predicate"] == "error"] == [(1, True)]
