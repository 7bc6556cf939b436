"""Joins of intervals against all pairs; hunks of patches and the functions they touch."""

import random
from collections import Counter

import pytest

from factloom.operators import queries as q
from factloom.operators.extract import Relations, extract_facts
from factloom.operators.intervals import innermost, overlaps
from factloom.sources.patch import hunks

SCHEMA = "f string, start long, end long, id long"


def brute(a, b):
    return Counter((x[3], y[3]) for x in a for y in b if None not in (*x[:3], *y[:3]) and x[0] == y[0] and max(x[1], y[1]) <= min(x[2], y[2]) and x[1] <= x[2] and y[1] <= y[2])


def pairs(df):
    return Counter((r["left"]["id"], r["right"]["id"]) for r in df.collect())


def make(rng, n, longest, low=-500, high=3_000):
    rows = []
    for i in range(n):
        start = rng.randint(low, high)
        rows.append((rng.choice("abc"), start, start + int(longest ** rng.random()) - rng.randint(0, 2), i))
    return rows


@pytest.mark.parametrize("longest", [1, 40, 5_000, 10**9])
def test_overlaps_match_all_pairs(spark, longest):
    rng = random.Random(longest)
    a, b = make(rng, 250, longest), make(rng, 200, 30)
    a += [("a", None, 5, 900), ("a", 5, None, 901), (None, 1, 2, 902), ("a", 9, 3, 903), ("a", 7, 7, 904), ("a", 7, 7, 904), ("b", -(2**60), 2**60, 905)]
    b += [("a", 7, 7, 800), ("b", 1, 2**61, 801)]
    found = pairs(overlaps(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["f"]))
    assert found == brute(a, b) and sum(found.values()) > 50


def test_nested_intervals_and_the_innermost(spark):
    spans = [("m", 1, 100, 1), ("m", 10, 50, 2), ("m", 20, 30, 3), ("m", 20, 25, 4), ("m", 60, 60, 5)]
    lines = [("m", n, n, n) for n in (1, 10, 19, 22, 28, 60, 99, 101)]
    found = overlaps(spark.createDataFrame(lines, SCHEMA), spark.createDataFrame(spans, SCHEMA), ["f"])
    assert pairs(found) == brute(lines, spans)
    assert {r["id"]: r["right"]["id"] for r in innermost(found, ["id"]).collect()} == {1: 1, 10: 2, 19: 2, 22: 4, 28: 3, 60: 5, 99: 1}


def test_short_intervals_of_one_file_are_not_compared_in_pairs(spark):
    """A long interval brings large bins into use; short ones meet it there, and not each other."""
    n = 3_000
    a = spark.range(n).selectExpr("'f' AS f", "id * 10 AS start", "id * 10 + 1 AS end", "id")
    b = a.unionByName(spark.createDataFrame([("f", 0, 10 * n, -1)], SCHEMA))
    joined = overlaps(a, b, ["f"])
    assert joined.count() == 2 * n
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    from factloom.operators.intervals import _binned

    sizes = [1, 5]
    met = _binned(a, ["f"], "start", "end", sizes, "left").join(_binned(b, ["f"], "start", "end", sizes, "right").drop("_s", "_e", "_own"), ["_f", "_size", "_bin", "_meets"])
    assert met.count() < 6 * n  # all pairs would be nine million


def test_empty_sides(spark):
    some, none = spark.createDataFrame([("a", 1, 2, 3)], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert overlaps(some, none, ["f"]).count() == overlaps(none, some, ["f"]).count() == overlaps(none, none, ["f"]).count() == 0


PATCH = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,2 +1,3 @@ def f
 x
@@ -9 +10,0 @@
-y
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,4 +0,0 @@
diff --git a/new.py b/new.py
@@ broken
@@ -0,0 +1 @@
"""


def test_hunks_and_functions_they_touch(spark):
    found = hunks(spark.createDataFrame([(1, PATCH), (2, None), (3, "@@ -1 +1 @@")], "id long, text string"), "id")
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(1, "gone.py", 1, 1, 4, 0, -1), (1, "m.py", 1, 1, 2, 1, 3), (1, "m.py", 2, 9, 9, 10, 9), (1, "new.py", 1, 0, -1, 1, 1)]
    code = "def a():\n    pass\n\ndef b():\n    pass\n\n\n\ndef c():\n    pass\n"
    files = spark.createDataFrame([("r", "c", "m.py", "python", code)], "repo_id string, commit_sha string, file_path string, language string, code string")
    r = Relations(extract_facts(files))
    asked = spark.createDataFrame([("r", "c", "m.py", 3, 4, 1), ("r", "c", "m.py", 8, 500, 2), ("r", "c", "x.py", 1, 9, 3)], "repo_id string, commit_sha string, file_path string, start long, end long, hunk int")
    assert sorted((x["hunk"], x["name"]) for x in q.touched_functions(r, asked).collect()) == [(1, "a"), (1, "b"), (2, "b"), (2, "c")]
