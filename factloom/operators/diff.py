"""Comparisons of two sets of facts: what was added, removed and modified, and what that may break."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import callee_base
from .extract import PROVENANCE, Relations, extract_facts
from .queries import SECURITY_RULES, calls, hits, orphans, test_gaps
from .store import cut

FUNCTION = ["repo_id", "file_path", "module_id", "name"]


def described(r: Relations) -> DataFrame:
    """One row for each function name in a module: its shape and the calls it makes, as sorted text."""
    made = calls(r).groupBy(*PROVENANCE, F.col("caller_id").alias("func_id")).agg(F.array_join(F.sort_array(F.collect_list("base")), ",").alias("calls"))
    params = r.function_param.groupBy(*PROVENANCE, "func_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", F.concat_ws(":", "name", "type").alias("t")))), lambda z: z["t"]), ",").alias("params")
    )
    joined = r.function.join(made, [*PROVENANCE, "func_id"], "left").join(params, [*PROVENANCE, "func_id"], "left")
    shape = F.concat_ws("|", "arity", "visibility", F.coalesce("params", F.lit("")), F.coalesce("calls", F.lit("")))
    return joined.groupBy(*FUNCTION).agg(
        F.array_join(F.sort_array(F.collect_list(shape)), ";").alias("shape"), F.max("arity").alias("arity"), F.min("visibility").alias("visibility")
    )


def function_diff(before: Relations, after: Relations) -> DataFrame:
    """Functions that differ: change is added, deleted or modified."""
    a, b = described(before), described(after)
    both = a.select(*FUNCTION, *(F.col(c).alias(f"{c}_before") for c in ("shape", "arity", "visibility"))).join(
        b.select(*FUNCTION, *(F.col(c).alias(f"{c}_after") for c in ("shape", "arity", "visibility"))), FUNCTION, "full_outer"
    )
    change = F.when(F.col("shape_before").isNull(), "added").when(F.col("shape_after").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("shape_before").eqNullSafe(F.col("shape_after"))).withColumn("change", change).drop("shape_before", "shape_after")


def edge_diff(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one side only, as sets: change is added or deleted."""
    a, b = before.select(*columns).distinct(), after.select(*columns).distinct()
    return a.join(b, columns, "left_anti").withColumn("change", F.lit("deleted")).unionByName(b.join(a, columns, "left_anti").withColumn("change", F.lit("added")))


def tokens(text: Column) -> Column:
    """Lower-case words of two letters or more, cut at case changes, without plural and verb endings."""
    words = F.split(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    stems = F.transform(words, lambda w: F.regexp_replace(w, "(ing|ed|es|s)$", ""))
    return F.array_distinct(F.filter(stems, lambda w: F.char_length(w) >= 2))


def alignment(changes: DataFrame, goal: str) -> DataFrame:
    """For each file, the share of the goal's words that occur in names that changed (0 to 1)."""
    wanted = tokens(F.lit(goal))
    named = changes.groupBy("file_path").agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("name"))))).alias("words"))
    shared = F.size(F.array_intersect("words", wanted))
    return named.select("file_path", F.coalesce(F.try_divide(shared.cast("double"), F.size(wanted)), F.lit(0.0)).alias("alignment_score"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.8, "aligned").when(score >= 0.5, "partial").otherwise("poor")


def concerns(before: Relations, after: Relations, goal: str = "", rules=SECURITY_RULES) -> DataFrame:
    """severity and type by file and name: functions removed but still called, or less visible than
    before; callees that match a rule and that the file didn't call before; and, with a goal, changed
    functions whose name shares no word with it."""
    changed = function_diff(before, after)
    still = calls(after).select("repo_id", F.col("base").alias("name")).distinct()
    columns = lambda severity, kind: ["file_path", "name", F.lit(severity).alias("severity"), F.lit(kind).alias("type")]
    removed = changed.where("change = 'deleted' and visibility_before = 'public'").join(still, ["repo_id", "name"], "left_semi")
    narrowed = changed.where("change = 'modified' and visibility_before = 'public' and visibility_after <> 'public'")
    found = removed.select(*columns("high", "removed_but_called")).unionByName(narrowed.select(*columns("medium", "visibility_narrowed")))
    made = edge_diff(calls(before), calls(after), ["repo_id", "file_path", "base"]).where("change = 'added'")
    risky = made.select("file_path", F.col("base").alias("name"), hits(F.col("base"), rules))
    found = found.unionByName(risky.select("file_path", "name", "hit.severity", F.concat(F.lit("new_"), "hit.type").alias("type")))
    if goal:
        unlike = ~F.arrays_overlap(tokens(F.col("name")), tokens(F.lit(goal)))
        found = found.unionByName(changed.where(unlike).select(*columns("low", "unexpected_change")))
    return found


def diffable(diffs: DataFrame) -> DataFrame:
    """File diffs with something on either side."""
    return diffs.where((F.coalesce("before", F.lit("")) != "") | (F.coalesce("after", F.lit("")) != ""))


def diff_facts(diffs: DataFrame, language: str | None = None) -> tuple[Relations, Relations]:
    """Facts of both sides of file diffs (path, language, status, before, after)."""
    lang = F.coalesce(F.lit(language), F.col("language")) if language else F.col("language")
    side = lambda c: diffable(diffs).select(F.lit("diff").alias("repo_id"), F.lit(c).alias("commit_sha"), F.col("path").alias("file_path"), lang.alias("language"), F.col(c).alias("code"))
    return Relations(extract_facts(side("before"))), Relations(extract_facts(side("after")))


def review_parts(diffs: DataFrame, goal: str = "", queries: tuple[str, ...] = ("orphans", "test_gaps")) -> dict[str, Callable[[], DataFrame]]:
    """What makes each part of a review: changes, alignment, concerns, and named queries over the after side."""
    named = {"orphans": orphans, "test_gaps": test_gaps}
    if unknown := set(queries) - named.keys():
        raise ValueError(f"unknown queries {sorted(unknown)}; there are {sorted(named)}")
    before, after = diff_facts(diffs)
    parts = {
        "changes": lambda: function_diff(before, after),
        "alignment": lambda: alignment(function_diff(before, after), goal),
        "concerns": lambda: concerns(before, after, goal),
    }
    return parts | {name: partial(named[name], after) for name in queries}


def review(diffs: DataFrame, goal: str = "", queries: tuple[str, ...] = ("orphans", "test_gaps")) -> dict[str, DataFrame]:
    """The parts of a review, not run yet."""
    return {name: make() for name, make in review_parts(diffs, goal, queries).items()}


def settled_review(spark: SparkSession, parts: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The parts as tables, and `errors` (part, kind, message): a part that fails is reported there, and the others stand."""
    found, errors = {}, []
    for name, make in parts.items():
        try:
            found[name] = cut(make(), f"review-{name}")
        except Exception as e:  # noqa: BLE001  whatever fails is a row
            errors.append((name, type(e).__name__, str(e)[:1_000]))
    return found | {"errors": spark.createDataFrame(errors, "part string, kind string, message string")}


__all__ = ["alignment", "callee_base", "concerns", "described", "diff_facts", "edge_diff", "function_diff", "review", "review_parts", "score_band", "settled_review", "tokens"]
