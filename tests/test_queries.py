"""Every registered query of the library against its SQL, on the smallest tables."""

import decimal
import os
import random

import duckdb
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from factloom.operators import diff, queries as q, store
from factloom.operators.extract import RELATIONS, Relations, extract_facts
from factloom.plans import corpus, registry
from factloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert found
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert found == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_reach_has_no_end_by_default(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(10)] + [("n10", "n0"), ("x", "y")]
    found = q.reach(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n0",)], "node string"))
    assert {r["node"]: r["depth"] for r in found.collect()} == {f"n{i}": i for i in range(11)}


def components(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    reached = {}
    for a in ahead:
        seen, stack = set(), [a]
        while stack:
            for b in ahead.get(stack.pop(), set()) - seen:
                seen.add(b)
                stack.append(b)
        reached[a] = seen
    of = {a: frozenset(b for b in reached[a] if a in reached.get(b, set())) | {a} for a in ahead}
    return {(min(c), v) for c in of.values() if len(c) > 1 for v in c}


def test_components_are_strongly_connected(spark, duck):
    edges = duck.sql(SQL["module_edges"]).fetchall()
    want = components(edges)
    assert want and {tuple(r) for r in QUERIES["dependency_components"](spark, SF).select("component", "module").collect()} == want


def python_files(spark, rows):
    return Relations(extract_facts(spark.createDataFrame([(*r[:3], "python", r[3]) for r in rows], "repo_id string, commit_sha string, file_path string, language string, code string")))


def test_components_and_suffixes_by_repository(spark):
    rows = [("r", "c", "src/a.py", "import b\n"), ("r", "c", "src/b.py", "import c.d\nimport src.a\n"), ("r", "c", "src/c/d.py", "import b\n"), ("r", "c", "src/e.py", "import a\n")]
    rows += [("s", "c", "a.py", "import b\n"), ("s", "c", "b.py", "import x\n"), ("s", "c", "p.py", "import q\n"), ("s", "c", "q.py", "import p\n")]
    r = python_files(spark, rows)
    edges = {(e["repo_id"], e["src"], e["dst"]) for e in q.module_edges(r).collect()}
    want = {("r", "src_a", "src_b"), ("r", "src_b", "src_c_d"), ("r", "src_b", "src_a"), ("r", "src_c_d", "src_b"), ("r", "src_e", "src_a"), ("s", "a", "b"), ("s", "p", "q"), ("s", "q", "p")}
    assert edges == want
    found = {(x["repo_id"], x["component"], x["module"]) for x in q.dependency_components(r).collect()}
    assert found == {("r", "src_a", m) for m in ("src_a", "src_b", "src_c_d")} | {("s", "p", "p"), ("s", "p", "q")}


def test_radius_stays_in_its_repository(spark):
    r = python_files(spark, [("a", "c", "m.py", "def top():\n    low()\n\ndef low():\n    pass\n"), ("b", "c", "m.py", "def other():\n    low()\n")])
    found = q.blast_radius(r, spark.createDataFrame([("a", "low")], "repo_id string, name string")).collect()
    assert {(x["repo_id"], x["name"], x["depth"]) for x in found} == {("a", "low", 0), ("a", "top", 1)}


def test_hotspots_follow_the_signature_of_their_own_file(spark):
    code = "def f({}):\n    a()\n    b()\n\ndef g():\n    pass\n"
    rows = [("r", f"c{i}", path, code.format(name)) for i, (x, y) in enumerate([("p", "p"), ("q", "p"), ("s", "p")]) for path, name in (("x.py", x), ("y.py", y))]
    r = python_files(spark, rows)
    now = Relations(r.facts.where("commit_sha = 'c2'"))
    found = {(h["file_path"], h["name"]): h["changes"] for h in q.hotspots(now, r, {f"c{i}": i for i in range(3)}).collect()}
    assert found == {("x.py", "f"): 2, ("y.py", "f"): 0, ("x.py", "g"): 0, ("y.py", "g"): 0}


def test_concerns_name_risky_calls_and_unexpected_changes(spark):
    before = python_files(spark, [("r", "c", "m.py", "def retry_send(x):\n    print(x)\n\ndef paint(x):\n    print(x)\n")])
    after = python_files(spark, [("r", "c", "m.py", "def retry_send(x):\n    eval(x)\n\ndef paint(x, y):\n    print(x)\n")])
    found = {(c["name"], c["severity"], c["type"]) for c in diff.concerns(before, after, "fix retries of sending retry").collect()}
    assert found == {("eval", "critical", "new_code_execution"), ("paint", "low", "unexpected_change")}


def test_long_clauses_are_read(spark):
    code = "p(X) :- " + ", ".join(f"g{i}(X)" for i in range(2_000)) + ".\nq(X) :- (a(X) ; b(X) -> c(X)), \\+ d(X).\n"
    files = spark.createDataFrame([("r", "c", "p.pl", "prolog", code)], "repo_id string, commit_sha string, file_path string, language string, code string")
    r = Relations(extract_facts(files))
    assert r.function.count() == 2
    assert [c["called_func"] for c in r.calls_external.orderBy("seq").collect()] == [f"g{i}" for i in range(2_000)] + ["a", "b", "c", "d"]


def test_upsert_drops_facts_of_files_without_any(spark, tmp_path):
    path = f"{tmp_path}/facts"
    first = [("r", "c", "a.py", "def f():\n    pass\n"), ("r", "c", "b.py", "def g():\n    pass\n")]
    store.upsert(python_files(spark, first).facts, path, 4)
    read = spark.createDataFrame([("r", "a.py")], "repo_id string, file_path string")
    store.upsert(python_files(spark, [("r", "d", "a.py", "")]).facts.limit(0), path, 4, read)
    assert {x["file_path"] for x in spark.read.parquet(path).select("file_path").collect()} == {"b.py"}


def test_ids_of_whole_texts(spark, duck):
    found = {r["doc_id"]: len(r["id"]) for r in QUERIES["normalize_ids"](spark, SF).collect()}
    assert found == dict(duck.sql("select doc_id, length(text) from documents").fetchall()) and max(found.values()) > 200


def test_methods_of_two_classes_collide(spark):
    code = "class A:\n    def run(self, x):\n        pass\n\nclass B:\n    def run(self, x):\n        pass\n\n    def other(self):\n        pass\n"
    rows = [("r", "c", "a.py", "python", code), ("r", "d", "b.py", "python", "def other(self):\n    pass\n")]
    files = spark.createDataFrame(rows, "repo_id string, commit_sha string, file_path string, language string, code string")
    found = q.id_collisions(Relations(extract_facts(files))).collect()
    assert [(r["commit_sha"], r["functions"]) for r in found] == [("c", 2)] and found[0]["func_id"].startswith("run")


def cycles_of(edges, most):
    """Simple cycles by depth-first search from their smallest node."""
    ahead, found = {}, set()
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)

    def walk(path):
        for b in ahead.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                found.add(" > ".join(path))
            elif b > path[0] and b not in path and len(path) < most:
                walk([*path, b])

    for a in ahead:
        walk([a])
    return found


def edge_table(spark, edges):
    return spark.createDataFrame([("r", "c", a, b) for a, b in edges], "repo_id string, commit_sha string, src string, dst string")


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_are_those_of_a_search(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"m{rng.randrange(14):02d}", f"m{rng.randrange(14):02d}") for _ in range(32)})
    edges = [e for e in edges if e[0] != e[1]]
    for most in (2, 4, 9):
        found = [" > ".join(r["path"]) for r in q.paths(edge_table(spark, edges), most).collect()]
        assert len(found) == len(set(found)) and set(found) == cycles_of(edges, most)


def test_paths_that_cannot_return_are_not_made(spark, monkeypatch):
    """A ring of twelve, and from each of its nodes a tree that leads nowhere and a far way round."""
    ring = [(f"a{i:02d}", f"a{(i + 1) % 12:02d}") for i in range(12)]
    trees = [(f"a{i:02d}", f"t{i:02d}_{j}") for i in range(12) for j in range(5)] + [(f"t{i:02d}_{j}", f"u{i:02d}_{j}_{k}") for i in range(12) for j in range(5) for k in range(5)]
    made = []
    monkeypatch.setattr(q, "cut", lambda df, name: (made.append(df.count()) if name == "paths" else None, store.cut(df, name))[1])
    found = q.paths(edge_table(spark, ring + trees), 12).collect()
    assert [len(r["path"]) for r in found] == [12]
    assert sum(made) == 11  # one path of each length, from the smallest node
    made.clear()
    assert q.paths(edge_table(spark, ring + trees), 11).collect() == [] and sum(made) == 0


def test_functions_of_one_name_are_kept_apart(spark):
    rows = [
        ("r", "c", "a.py", "def low(x):\n    pass\n\ndef top_a():\n    low(1)\n"),
        ("r", "c", "b.py", "def low(x):\n    pass\n\ndef top_b():\n    low(1)\n\ndef far():\n    top_b()\n"),
        ("r", "c", "d.py", "def other():\n    far()\n    lost()\n"),
    ]
    r = python_files(spark, rows)
    radius = lambda rows, schema: {(x["file_path"], x["name"], x["depth"]) for x in q.blast_radius(r, spark.createDataFrame(rows, schema)).collect()}
    named = "repo_id string, file_path string, name string"
    assert radius([("r", "a.py", "low")], named) == {("a.py", "low", 0), ("a.py", "top_a", 1)}
    assert radius([("r", "b.py", "low")], named) == {("b.py", "low", 0), ("b.py", "top_b", 1), ("b.py", "far", 2), ("d.py", "other", 3)}
    assert len(radius([("r", "low")], "repo_id string, name string")) == 6
    assert radius([("r", "gone.py", "lost")], named) == {(None, "lost", 0), ("d.py", "other", 1)}  # gone, but still called
    assert radius([("r", "gone.py", "low")], named) == set()  # moved away: calls mean the functions that are there


def test_loops_leave_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "work_dir", lambda spark: str(tmp_path))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    found = q.reach(edges, spark.createDataFrame([("n0",)], "node string"))
    assert found.count() == 7 and len(os.listdir(tmp_path)) == 1
    r = python_files(spark, [("r", "c", "a.py", "import b\n"), ("r", "c", "b.py", "import a\n")])
    assert q.dependency_cycles(r).count() == 1 and q.dependency_components(r).count() == 2
    assert len(os.listdir(tmp_path)) == 3
    with pytest.raises(ZeroDivisionError):
        store.tidy(lambda: 1 / 0)()
    assert store._cut == []


def test_tasks_of_a_corpus_grow_with_its_rows(spark, tmp_path, monkeypatch):
    """Tasks hold a number of line items, whatever bytes they are packed into, and facts are written without being sorted first."""
    from factloom.operators import store
    from factloom.plans import corpus as plans

    monkeypatch.setattr(plans, "TASK_ROWS", 500)
    items = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert plans.corpus(spark, SF).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-items // 500))
    sorts = []

    def write(df, path):
        sorts.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return kept(df, path)

    kept = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: write(self, path))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    written = store.write_facts(extract_facts(plans.corpus(spark, SF)), "facts", str(tmp_path / "facts"))
    assert written.where("predicate = 'calls_external'").count() == items
    assert int(sorts[0]) >= len(RELATIONS) + 1 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_calls_are_stored_only_where_wanted(spark, monkeypatch):
    monkeypatch.setattr(corpus, "_stored", {})
    fewer = corpus.stored_facts(spark, SF, with_calls=False)
    assert {r["predicate"] for r in fewer.select("predicate").distinct().collect()} == {"module", "function", "function_line", "function_visibility", "function_param", "depends_on"}
    everything = corpus.stored_facts(spark, SF)
    assert everything.where("predicate = 'calls_external'").count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert corpus.stored_facts(spark, SF, with_calls=False) is everything


def test_summaries_of_files_build_their_code_once(spark, monkeypatch):
    built, build = [], corpus.corpus
    monkeypatch.setattr(corpus, "_stored", {})
    for module in (corpus, registry):
        monkeypatch.setattr(module, "corpus", lambda *args: built.append(args) or build(*args))
    assert QUERIES["file_summaries"](spark, SF).count() and len(built) == 1


def test_history_is_made_in_tasks_of_a_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_ROWS", 50)
    functions = spark.read.parquet(f"{SF}/part.parquet").count()
    assert corpus.history(spark, SF).rdd.getNumPartitions() == -(-8 * functions // 50)


def test_calls_move_once_to_the_rules_of_intent(spark):
    code = "def fn_1():\n    fn_2()\n    fn_2()\n    fn_2()\n\ndef _fn_1():\n    other()\n    other()\n"
    files = spark.createDataFrame([("r", "c", "a.py", "python", code)], "repo_id string, commit_sha string, file_path string, language string, code string")
    rules = [("fn_1", "^fn_2", None, "calls its own kind"), ("_fn_1", None, "^fn", "calls nothing")]
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        found = q.intent_mismatches(Relations(extract_facts(files)), rules)
        assert str(found._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 2
        assert sorted((r["name"], r["message"]) for r in found.collect()) == [("_fn_1", "calls nothing"), ("fn_1", "calls its own kind")]
    finally:
        spark.conf.set(key, before)
