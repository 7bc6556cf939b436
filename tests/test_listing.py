"""Listing in tasks, the change-aware lens, and sketches."""

import os
import random
import subprocess

import pytest

from factloom.engine import Engine
from factloom.operators import queries as q
from factloom.operators import sketches
from factloom.operators.extract import Relations, extract_facts
from factloom.sources import listing
from factloom.sources.tree import walk

FILES = "repo_id string, commit_sha string, file_path string, language string, code string"


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr("factloom.engine.BUCKETS", 2)


def git(folder, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(folder), *args], check=True, capture_output=True)


def grow(folder, rng, depth=0):
    for i in range(rng.randint(1, 4)):
        (folder / f"{rng.choice('ab')}{i}{rng.choice(['.py', '.rs', '.txt', '.log.py', ''])}").write_text(f"x = {rng.random()}\n")
    if depth < 3:
        for name in rng.sample(["build", "src", ".hidden", "deep dir", "ü", "keep"], rng.randint(1, 3)):
            (folder / name).mkdir(exist_ok=True)
            grow(folder / name, rng, depth + 1)


@pytest.mark.parametrize("seed,within", [(1, True), (2, True), (3, True), (4, False)])
def test_listing_equals_the_walk(spark, tmp_path, seed, within):
    rng = random.Random(seed)
    grow(tmp_path, rng)
    (tmp_path / "src").mkdir(exist_ok=True)
    (tmp_path / "src/build").mkdir(exist_ok=True)
    (tmp_path / "src/build/forced.py").write_text("tracked though ignored\n")
    (tmp_path / "src/build/left.py").write_text("ignored\n")
    os.symlink(tmp_path / "src", tmp_path / "link")
    os.symlink(tmp_path / "src/build/left.py", tmp_path / "link.py")
    if within:
        git(tmp_path, "init", "-q")
        (tmp_path / ".gitignore").write_text("build\n*.log.py\n!keep/*.log.py\n/a1*\n")
        (tmp_path / "src/.gitignore").write_text("b*.rs\n")
        git(tmp_path, "add", "-A")
        git(tmp_path, "add", "-f", "src/build/forced.py")
        (tmp_path / "nested").mkdir()
        git(tmp_path / "nested", "init", "-q")
        (tmp_path / "nested/own.py").write_text("another repository\n")
        (tmp_path / "src/new.py").write_text("not tracked\n")
    engine = Engine(spark)
    found = engine.listing([str(tmp_path)])
    want = {p for p in walk(str(tmp_path)) if p.endswith((".py", ".rs"))}
    assert sorted(r["file_path"] for r in found.collect()) == sorted(want)
    assert (str(tmp_path / "src/build/forced.py") in want) and (str(tmp_path / "src/build/left.py") in want) != within
    assert {r["file_path"]: r["bytes"] for r in found.collect()} == {p: os.path.getsize(p) for p in want}


def test_the_driver_holds_folders_only(tmp_path):
    for i in range(30):
        (tmp_path / f"d{i}").mkdir()
        for j in range(5):
            (tmp_path / f"d{i}/f{j}.py").write_text("")
    reader = listing.ListingReader({"path": str(tmp_path), "folders": "4"})
    parts = reader.partitions()
    held = [n for p in parts for _, names in p.tops for n in names]
    assert sorted(held) == sorted(["", *(f"d{i}" for i in range(30))]) and len(parts) == 8
    assert sum(len(list(reader.read(p))) for p in parts) == 150


def test_files_are_dealt_by_size(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"f{i}.py").write_text("#" * 1_000)
    dealt = listing.dealt_by_size(Engine(spark).listing([str(tmp_path)]), each=2_000, least=2)
    assert dealt.rdd.getNumPartitions() == 10
    rows = listing.read_code(dealt).collect()
    assert len(rows) == 20 and {len(r["code"]) for r in rows} == {1_000}


@pytest.fixture
def hundred(tmp_path):
    top = tmp_path / "src"
    top.mkdir()
    for i in range(100):
        (top / f"m{i}.py").write_text(f"def f{i}(x):\n    g{i % 7}()\n")
    return top


def names(df):
    return sorted(r["name"] for r in Relations(df).function.collect())


def test_only_changed_files_are_parsed(spark, tmp_path, hundred, monkeypatch):
    engine = Engine(spark, str(tmp_path / "store/facts"), "own/repo")
    facts = engine.lens([str(hundred)])
    assert engine.parsed == 100 and names(facts) == sorted(f"f{i}" for i in range(100))
    assert {r["repo_id"] for r in facts.select("repo_id").distinct().collect()} == {"own/repo"}
    (hundred / "m5.py").write_text("def changed():\n    pass\n")
    assert names(engine.lens([str(hundred)])) == sorted(["changed", *(f"f{i}" for i in range(100) if i != 5)])
    assert engine.parsed == 1
    engine.lens([str(hundred)])
    assert engine.parsed == 0
    os.utime(hundred / "m6.py", (1, 1))  # another time, the same content
    engine.lens([str(hundred / "m6.py")])
    assert engine.parsed == 0
    monkeypatch.setattr("factloom.engine.VERSION", "another")
    engine.lens([str(hundred)])
    assert engine.parsed == 100


def test_files_that_are_gone_lose_their_facts_on_request(spark, tmp_path, hundred):
    engine = Engine(spark, str(tmp_path / "store/facts"))
    other = tmp_path / "other.py"
    other.write_text("def other(): pass\n")
    engine.lens([str(hundred), str(other)])
    (hundred / "m1.py").unlink()
    assert "f1" in names(engine.lens([str(hundred)]))
    found = names(engine.lens([str(hundred)], prune=True))
    assert "f1" not in found and "other" in found and engine.parsed == 0
    (hundred / "m1.py").write_text("def f1(x):\n    g1()\n")
    assert "f1" in names(engine.lens([str(hundred)])) and engine.parsed == 1


def test_a_failed_run_is_done_again(spark, tmp_path, hundred, monkeypatch):
    engine = Engine(spark, str(tmp_path / "store/facts"))
    engine.lens([str(hundred)])
    (hundred / "m5.py").write_text("def changed():\n    pass\n")
    with monkeypatch.context() as broken:
        broken.setattr("factloom.engine.file_sketches", lambda r: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            engine.lens([str(hundred)])
    assert "changed" in names(engine.lens([str(hundred)])) and engine.parsed == 1


def test_a_store_of_nothing(spark, tmp_path):
    top = tmp_path / "src"
    top.mkdir()
    engine = Engine(spark, str(tmp_path / "store/facts"))
    assert engine.lens([str(top)]).count() == 0 and engine.parsed == 0
    (top / "a.py").write_text("def a(): pass\n")
    assert names(engine.lens([str(top)])) == ["a"]


def test_facts_of_a_commit_hold_unchanged_files(spark, tmp_path):
    top = tmp_path / "repo"
    top.mkdir()
    (top / "a.py").write_text("def a(): pass\n")
    (top / "b.py").write_text("def b(): pass\n")
    git(top, "init", "-q")
    git(top, "add", "-A")
    git(top, "commit", "-qm", "one")
    engine = Engine(spark, str(tmp_path / "store/facts"))
    engine.lens([str(top)])
    (top / "b.py").write_text("def b2(): pass\n")
    git(top, "commit", "-qam", "two")
    engine.lens([str(top)])
    assert engine.parsed == 1
    sha = subprocess.run(["git", "-C", str(top), "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    assert names(engine.facts(sha)) == ["a", "b2"] and {r["commit_sha"] for r in engine.facts(sha).collect()} == {sha}
    assert sorted(r["name"] for r in engine.query("orphans", sha).collect()) == ["a", "b2"]


def test_hotspots_by_the_changes_that_were_seen(spark, tmp_path):
    top = tmp_path / "src"
    top.mkdir()
    engine = Engine(spark, str(tmp_path / "store/facts"))
    small = "def small(x):\n    pass\n"
    for n in range(4):
        (top / "a.py").write_text(small + "def busy(" + ", ".join(f"p{i}" for i in range(n)) + "):\n" + "    g()\n" * 9 + "def calm():\n" + "    g()\n" * 9 + "def last():\n    pass\n")
        engine.lens([str(top)])
    (top / "a.py").write_text((top / "a.py").read_text())
    engine.lens([str(top)])  # nothing new
    assert {r["name"]: r["changes"] for r in engine.changes().collect()} == {"busy": 3}
    best = engine.query("hotspots").collect()
    assert (best[0]["name"], best[0]["changes"]) == ("busy", 3) and best[0]["score"] > 0 and {r["score"] for r in best[1:]} == {0.0}
    assert {r["name"] for r in best} == {"small", "busy", "calm", "last"}


# sketches


def many(spark, n=60):
    rng = random.Random(1)
    code = lambda k: "".join(f"def f{i}(x):\n" + "".join(f"    g{rng.randrange(3_000)}()\n" for _ in range(int(rng.expovariate(0.1)))) + "\n" for i in range(k))
    return spark.createDataFrame([("r", "c", f"d{i % 3}/m{i}.py", "python", code(rng.randint(0, 30))) for i in range(n)], FILES)


def test_sketches_hold_their_bounds(spark):
    r = Relations(extract_facts(many(spark)))
    found = sketches.estimates(sketches.merged(sketches.file_sketches(r), ["repo_id"]), (0.1, 0.5, 0.9, 0.99)).first()
    exact = q.calls(r).select("base").distinct().count()
    assert abs(found["callees"] - exact) <= sketches.COUNT_ERROR * exact
    values = sorted(x["complexity"] for x in q.complexity(r).collect())
    for rank, value in zip((0.1, 0.5, 0.9, 0.99), found["complexity"], strict=True):
        below, upto = sum(v < value for v in values) / len(values), sum(v <= value for v in values) / len(values)
        assert below - sketches.RANK_ERROR <= rank <= upto + sketches.RANK_ERROR
    assert (found["functions"], found["calls"]) == (len(values), r.calls_external.count())


def test_merging_in_steps_is_the_same(spark):
    per_file = sketches.file_sketches(Relations(extract_facts(many(spark))))
    at_once = sketches.estimates(sketches.merged(per_file, ["repo_id"])).first()
    folders = sketches.merged(per_file.selectExpr("repo_id", "split(file_path, '/')[0] AS d", "functions", "calls", "callees", "complexity"), ["repo_id", "d"])
    in_steps = sketches.estimates(sketches.merged(folders, ["repo_id"])).first()
    assert in_steps["functions"] == at_once["functions"] and in_steps["callees"] == pytest.approx(at_once["callees"], rel=0.02)


def test_files_without_functions_have_empty_sketches(spark):
    files = spark.createDataFrame([("r", "c", "a.py", "python", "x = 1\n"), ("r", "c", "b.py", "python", "def f():\n    g()\n    g()\n")], FILES)
    per_file = {r["file_path"]: r for r in sketches.estimates(sketches.file_sketches(Relations(extract_facts(files)))).collect()}
    assert (per_file["a.py"]["functions"], per_file["a.py"]["callees"], per_file["a.py"]["complexity"]) == (0, 0, None)
    assert (per_file["b.py"]["calls"], per_file["b.py"]["callees"], per_file["b.py"]["complexity"]) == (2, 1, [2, 2])


def test_the_store_keeps_sketches_of_its_files(spark, tmp_path, hundred):
    engine = Engine(spark, str(tmp_path / "store/facts"))
    engine.lens([str(hundred)])
    (one,) = engine.sketches(["language"]).collect()
    assert (one["functions"], one["calls"], one["callees"]) == (100, 100, 7)
    (hundred / "m0.py").write_text("def a():\n    b()\n\ndef b():\n    c()\n")
    engine.lens([str(hundred)])
    (one,) = engine.sketches(["language"]).collect()
    assert (one["functions"], one["calls"], one["callees"]) == (101, 101, 9)
    plan = engine.sketches(["language"])._jdf.queryExecution().executedPlan().toString()
    assert "callees:binary" in plan and "called_func" not in plan
