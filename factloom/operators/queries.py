"""Named queries over relations. Each takes Relations and returns a DataFrame.

Intent, security and architecture checks are rules, not judgements of a language model.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import callee_base
from .extract import PROVENANCE, Relations
from .intervals import overlaps
from .store import cut, tidy

REPO = ["repo_id", "commit_sha"]
#: The end of a file's last function, as facts don't hold where files end.
LAST_LINE = (1 << 31) - 1
TEST_NAME = r"^test|_test\z"
TEST_PATH = r"(^|/)(tests?|spec)/|_test\.|\.test\.|\.spec\.|(^|/)test_"
#: Samples of rules, to be replaced by a team's own: each of these is an argument of its query.
#: prefix of a name, pattern of forbidden callees (null: it must call something that matches the next), pattern required, message
INTENT_RULES = (
    ("get_", r"^(save|delete|write|update|insert|remove)", None, "a getter changes state"),
    ("is_", r"^(save|delete|write|update|insert|remove)", None, "a predicate changes state"),
    ("has_", r"^(save|delete|write|update|insert|remove)", None, "a predicate changes state"),
    ("find_", r"^(save|delete|write|update|insert|remove)", None, "a search changes state"),
    ("delete_", None, r"(delete|remove|drop|unlink|destroy)", "nothing is removed"),
    ("validate_", None, r".", "nothing is checked"),
)
#: pattern of a callee, severity, type, message, suggestion
SECURITY_RULES = (
    (r"^(eval|exec)$", "critical", "code_execution", "runs text as code", "parse the input instead"),
    (r"^(system|popen)$", "high", "command_execution", "runs a shell command", "pass arguments as a list"),
    (r"^(loads|load)$", "medium", "deserialisation", "may build objects from untrusted data", "use a safe loader"),
    (r"^(innerHTML|dangerouslySetInnerHTML|html_safe)$", "high", "injection", "emits markup unescaped", "escape the value"),
    (r"^(md5|sha1)$", "low", "weak_hash", "a weak hash", "use a stronger one"),
    (r"^(unsafe|transmute|from_raw_parts|unsafe_string)$", "medium", "unsafe_memory", "goes round memory safety", "use a checked way"),
    (r"^(executescript|execute_raw|raw_query)$", "medium", "sql_text", "runs text as SQL", "bind parameters"),
    (r"^(_create_unverified_context|disable_warnings)$", "high", "tls", "turns off checks of certificates", "keep them on"),
)
#: pattern of a dependency, severity, type, message, suggestion
SECURITY_IMPORTS = (
    (r"^(pickle|cPickle|marshal|shelve|dill)$", "medium", "deserialisation", "builds objects from untrusted data", "use a plain format"),
    (r"^(subprocess|os/exec|child_process|open3)$", "medium", "command_execution", "starts processes", "pass arguments as a list"),
    (r"^(telnetlib|ftplib|net/telnet)$", "medium", "clear_text", "sends clear text", "use an encrypted protocol"),
    (r"^(unsafe|ctypes|ffi)$", "low", "unsafe_memory", "goes round memory safety", "keep it small and checked"),
)


def calls(r: Relations) -> DataFrame:
    return r.calls_external.withColumn("base", callee_base("called_func"))


def orphans(r: Relations, ignore_self: bool = False) -> DataFrame:
    """Functions that no call names; with ignore_self, a function's calls of itself don't count."""
    made = calls(r)
    if not ignore_self:
        return r.function.join(made.select(*REPO, F.col("base").alias("name")).distinct(), [*REPO, "name"], "left_anti")
    own = made.select(*REPO, F.col("base").alias("name"), F.col("file_path").alias("p"), "caller_id").distinct()
    counted = own.groupBy(*REPO, "name").agg(F.count("*").alias("callers"), F.min(F.struct("p", "caller_id")).alias("one"))
    joined = r.function.join(counted, [*REPO, "name"], "left")
    alone = F.col("callers").isNull() | ((F.col("callers") == 1) & (F.col("one.p") == F.col("file_path")) & (F.col("one.caller_id") == F.col("func_id")))
    return joined.where(alone).drop("callers", "one")


def exported_functions(r: Relations) -> DataFrame:
    """Functions that their module's declaration lists."""
    return r.function.join(r.export, [*PROVENANCE, "module_id", "func_id"], "left_semi")


def missing_exports(r: Relations) -> DataFrame:
    """Exports that their file doesn't define."""
    return r.export.join(r.function, [*PROVENANCE, "module_id", "func_id"], "left_anti")


def is_test(name="name", path="file_path"):
    return F.col(name).rlike(TEST_NAME) | F.col(path).rlike(TEST_PATH)


def test_gaps(r: Relations) -> DataFrame:
    """Public functions, not tests themselves, that no test calls."""
    tests = r.function.where(is_test()).select(*PROVENANCE, F.col("func_id").alias("caller_id")).distinct()
    tested = calls(r).join(tests, [*PROVENANCE, "caller_id"], "left_semi").select(*REPO, F.col("base").alias("name")).distinct()
    return r.function.where((F.col("visibility") == "public") & ~is_test()).join(tested, [*REPO, "name"], "left_anti")


def resolve_calls(r: Relations) -> DataFrame:
    """Each distinct (caller, callee name) with the function it most likely means.

    match_kind: same_file, global (one candidate), ambiguous (the first by path) or unresolved.
    """
    made = calls(r).groupBy(*PROVENANCE, "caller_id", "base").agg(F.count("*").alias("n_calls"))
    target = r.function.select(*REPO, F.col("name").alias("base"), F.col("file_path").alias("target_path"), F.col("func_id").alias("target_id"))
    summed = target.groupBy(*REPO, "base").agg(F.count("*").alias("candidates"), F.min(F.struct("target_path", "target_id")).alias("first"))
    near = target.groupBy(*REPO, "base", F.col("target_path").alias("file_path")).agg(F.min("target_id").alias("near_id"))
    joined = made.join(summed, [*REPO, "base"], "left").join(near, [*REPO, "base", "file_path"], "left")
    kind = F.when(F.col("near_id").isNotNull(), "same_file").when(F.col("candidates") == 1, "global").when(F.col("candidates") > 1, "ambiguous").otherwise("unresolved")
    return joined.select(
        *PROVENANCE, "caller_id", "base", "n_calls", kind.alias("match_kind"),
        F.when(F.col("near_id").isNotNull(), F.col("file_path")).otherwise(F.col("first.target_path")).alias("target_path"),
        F.coalesce("near_id", "first.target_id").alias("target_id"),
    )


def module_edges(r: Relations) -> DataFrame:
    """src, dst: files whose module a dependency names, by module id, or else by the end of one.

    A name without a module of that id means the first module (by id) that ends with it after an
    underscore: every id is cut at its underscores, so this is a join by equality too.
    """
    files = r.files()
    ids = files.select(*REPO, "module_id").distinct()
    own = files.select(*PROVENANCE, F.col("module_id").alias("src"))
    wanted = r.depends_on.select(*PROVENANCE, F.lower(F.regexp_replace("dep_name", r"[^\p{IsAlphabetic}\p{N}_]", "_")).alias("dep"))
    words = F.split("module_id", "_")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: F.array_join(F.slice(words, i, F.size(words)), "_"))
    by_end = ids.select(*REPO, "module_id", F.explode(F.array_distinct(ends)).alias("dep")).where("dep <> ''").groupBy(*REPO, "dep").agg(F.min("module_id").alias("by_end"))
    by_id = ids.select(*REPO, F.col("module_id").alias("dep"), F.col("module_id").alias("by_id"))
    found = wanted.join(by_id, [*REPO, "dep"], "left").join(by_end, [*REPO, "dep"], "left").withColumn("dst", F.coalesce("by_id", "by_end"))
    return found.where("dst is not null").join(own, list(PROVENANCE)).where("src <> dst").select(*REPO, "src", "dst").distinct()


def dependency_components(r: Relations) -> DataFrame:
    """repo_id, commit_sha, component, module by components_of() the module graph."""
    return components_of(module_edges(r))


@tidy
def components_of(module_edges: DataFrame) -> DataFrame:
    """component, module: modules that depend on each other, directly or through others (two at least).

    A component is named by its smallest module. Each round strips what lies on no cycle, gives every
    module the smallest one that leads to it, and takes as components those that lead back to theirs.
    """
    node = lambda c: F.struct(*REPO, F.col(c).alias("module"))
    edges = cut(module_edges.select(node("src").alias("src"), node("dst").alias("dst")), "edges")
    found = None
    while True:
        while True:  # only what has edges in and out can be on a cycle
            before = edges.count()
            edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
            edges = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "edges")
            if edges.count() == before:
                break
        if edges.isEmpty():
            break
        roots = cut(edges.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
        while True:
            ahead = edges.join(roots.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("r"))
            moved = cut(roots.join(ahead, "node").select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")), "roots")
            roots = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        own = lambda c, to: roots.select(F.col("node").alias(c), F.col("root").alias(to))
        inside = edges.join(own("src", "a"), "src").join(own("dst", "b"), "dst").where("a = b")
        back = inside.select(F.struct("a", F.col("dst").alias("n")).alias("src"), F.struct("a", F.col("src").alias("n")).alias("dst"))
        seeds = roots.where("node = root").select(F.struct(F.col("root").alias("a"), F.col("node").alias("n")).alias("node"))
        members = cut(reach(back, seeds).select(F.col("node.a").alias("component"), F.col("node.n").alias("node")), "members")
        found = members if found is None else found.unionByName(members)
        edges = edges.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        edges = cut(edges.select("src", "dst"), "edges")
    if found is None:
        found = roots_of_none(edges)
    several = found.groupBy("component").agg(F.count("*").alias("modules")).where("modules > 1")
    return found.join(several, "component").select(*(F.col(f"component.{c}").alias(c) for c in REPO), F.col("component.module").alias("component"), F.col("node.module").alias("module"))


def roots_of_none(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("component"), F.col("dst").alias("node")).limit(0)


def first_of_each(r: Relations) -> DataFrame:
    """Of functions of a file that share an id, the first by place."""
    columns = [c for c in r.function.columns if c not in (*PROVENANCE, "func_id")]
    first = r.function.groupBy(*PROVENANCE, "func_id").agg(F.min(F.struct("seq", *(c for c in columns if c != "seq"))).alias("first"))
    return first.select(*PROVENANCE, "func_id", "first.*")


def id_collisions(r: Relations) -> DataFrame:
    """func_ids that several functions of a repository's commit share, with the number of these."""
    return r.function.groupBy(*REPO, "func_id").agg(F.count("*").alias("functions")).where("functions > 1")


def ways_back(edges: DataFrame, most: int) -> DataFrame:
    """start, node, back: steps from a node back to a smaller start over nodes above it, if `most` or fewer."""
    into = edges.select(*REPO, F.col("src").alias("before"), F.col("dst").alias("node"))
    frontier = cut(edges.where("src > dst").select(*REPO, F.col("dst").alias("start"), F.col("src").alias("node"), F.lit(1).alias("back")), "back")
    seen = frontier
    for back in range(2, most + 1):
        further = frontier.join(into, [*REPO, "node"]).where("before > start").select(*REPO, "start", F.col("before").alias("node")).distinct()
        frontier = cut(further.join(seen, [*REPO, "start", "node"], "left_anti").withColumn("back", F.lit(back)), "back")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return cut(seen, "ways")


def paths(edges: DataFrame, most: int) -> DataFrame:
    """Simple cycles as paths from their smallest node on, by length; a loop of joins, one for each step.

    A path goes on to a node only if the shortest way back from there, over nodes above the start, still
    fits `most` nodes: so it stays inside the start's strongly connected component, and none is kept
    that is too far out to return (one may still meet itself on its way back).
    """
    step = cut(edges, "edges")
    back = ways_back(step, most - 1)
    step = step.select(*REPO, F.col("src").alias("last"), F.col("dst").alias("next"))
    grown = step.where("last < next").select(*REPO, F.col("last").alias("start"), F.col("next").alias("node"), F.array("last", "next").alias("path"))
    found = None
    for size in range(2, most + 1):
        near = back.where(F.col("back") <= most - size + 1)
        grown = cut(grown.join(near, [*REPO, "start", "node"]), "paths")
        closed = grown.where("back = 1").select(*REPO, "path")
        found = closed if found is None else found.unionByName(closed)
        if grown.isEmpty():
            break
        following = grown.join(step.withColumnRenamed("last", "node"), [*REPO, "node"]).where("next > start and not array_contains(path, next)")
        grown = following.select(*REPO, "start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
    return found


@tidy
def dependency_cycles(r: Relations, most: int = 6) -> DataFrame:
    """Simple cycles of 2 to `most` modules, each from its smallest module on."""
    found = paths(module_edges(r), most)
    return found.select(*REPO, F.size("path").cast("long").alias("length"), F.array_join("path", " > ").alias("cycle"))


@tidy
def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """node, depth: all that seeds lead to along edges (src, dst), or in at most `most` steps; semi-naive."""
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "reach")
    seen, step = frontier, cut(edges.select("src", "dst").distinct(), "edges")
    for depth in count(1) if most is None else range(1, most + 1):
        nodes = frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(nodes.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@tidy
def blast_radius(r: Relations, changed: DataFrame, most: int | None = None) -> DataFrame:
    """repo_id, commit_sha, file_path, func_id, name, depth: functions that call the changed ones directly or
    through others, in each commit of their repository.

    changed: repo_id, name and, if at hand, file_path. Calls count by the function they resolve to, so
    functions of one name in different files are told apart. A changed function that is gone has a name
    only, and is called by those whose calls of that name mean no function any more.
    """
    calls_ = resolve_calls(r)
    target = node_of(F.coalesce("target_path", F.lit("")), F.coalesce("target_id", "base"))
    edges = calls_.select(target.alias("src"), node_of(F.col("file_path"), F.col("caller_id")).alias("dst"))
    functions = r.function.select(*PROVENANCE, "func_id", "name").distinct()
    by = [c for c in ("repo_id", "file_path", "name") if c in changed.columns]
    changed = changed.select(*by).distinct()
    there = functions.join(changed, by)
    gone = changed.join(r.files().select(*REPO).distinct(), "repo_id").join(functions, [*REPO, *(c for c in by if c != "repo_id")], "left_anti")
    gone = gone.join(functions, [*REPO, "name"], "left_anti").select(*REPO, "name").distinct()
    seeds = there.select(node_of(F.col("file_path"), F.col("func_id")).alias("node")).unionByName(gone.select(node_of(F.lit(""), F.col("name")).alias("node")))
    found = reach(edges, seeds, most).select("node.*", "depth")
    named = found.join(functions.groupBy(*PROVENANCE, "func_id").agg(F.min("name").alias("name")), [*PROVENANCE, "func_id"], "left")
    gone_path = F.col("file_path") == ""
    return named.select(
        *REPO, F.when(~gone_path, F.col("file_path")).alias("file_path"), F.when(~gone_path, F.col("func_id")).alias("func_id"), F.coalesce("name", "func_id").alias("name"), "depth"
    )


def node_of(path: Column, name: Column) -> Column:
    return F.struct(*REPO, path.alias("file_path"), name.alias("func_id"))


def fan_out(r: Relations) -> DataFrame:
    return r.calls_external.groupBy(*PROVENANCE, "caller_id").agg(F.count("*").alias("fan_out"))


def fan_in(r: Relations) -> DataFrame:
    """Calls by name of the callee, with its rank."""
    counted = calls(r).groupBy(*REPO, F.col("base").alias("name")).agg(F.count("*").alias("fan_in"))
    # only the distinct counts of a repository are sorted, not its names
    ranks = counted.select(*REPO, "fan_in").distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy(*REPO).orderBy(F.desc("fan_in"))).cast("long"))
    return counted.join(ranks, [*REPO, "fan_in"]).select(*REPO, "name", "fan_in", "rank")


def line_spans(r: Relations) -> DataFrame:
    """Functions with the lines to the next one of their file; the last of a file has none."""
    following = F.lead("line").over(Window.partitionBy(*PROVENANCE).orderBy("line", "seq"))
    return r.function.withColumn("span", following - F.col("line"))


def function_spans(r: Relations) -> DataFrame:
    """Functions with start and end, their lines up to the next function of the file; the last one's end is LAST_LINE."""
    following = F.lead("line").over(Window.partitionBy(*PROVENANCE).orderBy("line", "seq"))
    end = F.greatest("line", F.coalesce(following - 1, F.lit(LAST_LINE)))
    return r.function.select(*PROVENANCE, "func_id", "name", F.col("line").alias("start"), end.alias("end"))


def touched_functions(r: Relations, hunks: DataFrame) -> DataFrame:
    """hunks (repo_id, commit_sha, file_path, start, end and others) with each function, func_id and name, whose lines they overlap."""
    pairs = overlaps(hunks, function_spans(r), list(PROVENANCE))
    return pairs.select("left.*", "right.func_id", "right.name")


def enclosing_functions(r: Relations, lines: DataFrame) -> DataFrame:
    """lines (repo_id, commit_sha, file_path, line) with the function that each stands in: the last that
    starts at or above it, by one sweep over each file."""
    starts = r.function.select(*PROVENANCE, "line", "func_id", F.lit(0).alias("kind"))
    asked = lines.select(*PROVENANCE, "line", F.lit(None).cast("string").alias("func_id"), F.lit(1).alias("kind"))
    sweep = Window.partitionBy(*PROVENANCE).orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("func_id", F.last("func_id", ignorenulls=True).over(sweep)).where("kind = 1").drop("kind")


def complexity(r: Relations) -> DataFrame:
    out = fan_out(r).withColumnRenamed("caller_id", "func_id")
    spans = line_spans(r).join(out, [*PROVENANCE, "func_id"], "left")
    value = F.coalesce("fan_out", F.lit(0)) + F.col("arity") + F.coalesce("span", F.lit(0))
    return spans.select(*PROVENANCE, "func_id", "name", value.cast("long").alias("complexity"))


def function_history(r: Relations, order: dict[str, int] | DataFrame) -> DataFrame:
    """Every function name in every commit it stands in, with its arity and signature there and before.

    order: the place of each commit, as a dict or a table (commit_sha, ordinal). The signature is the
    arity, the visibility and the parameters.
    """
    if isinstance(order, dict):
        order = r.facts.sparkSession.createDataFrame([*order.items()], "commit_sha string, ordinal long")
    named = F.struct("position", F.concat_ws(":", "name", "type").alias("t"))
    params = r.function_param.groupBy(*PROVENANCE, "func_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(named)), lambda z: z["t"]), ",").alias("params"))
    own = r.function.join(order.select("commit_sha", "ordinal"), "commit_sha").join(params, [*PROVENANCE, "func_id"], "left")
    own = own.withColumn("signature", F.concat_ws("|", "arity", "visibility", F.coalesce("params", F.lit(""))))
    own = own.select("repo_id", "file_path", "name", "commit_sha", "ordinal", "arity", "visibility", "signature")
    w = Window.partitionBy("repo_id", "file_path", "name").orderBy("ordinal")
    return own.withColumns({f"{c}_before": F.lag(c).over(w) for c in ("arity", "ordinal", "signature")})


def time_machine(r: Relations, order: dict[str, int] | DataFrame) -> DataFrame:
    """First and last commit, number of commits and of changes of the signature of each function; lifespan is
    the number of commits from the first to the last, those in between where it is missing included."""
    h = function_history(r, order)
    changed = F.count_if(F.col("signature_before") != F.col("signature"))
    return h.groupBy("repo_id", "file_path", "name").agg(
        F.min("ordinal").alias("first_seen"), F.max("ordinal").alias("last_seen"), F.count("*").alias("commits"), changed.alias("changes"),
        (F.max("ordinal") - F.min("ordinal") + 1).alias("lifespan"),
    )


def hotspots(now: Relations, past: Relations, order: dict[str, int] | DataFrame, top: int = 20) -> DataFrame:
    """Functions that are complex and often change: the product of both percent ranks, best first."""
    return hotspots_by(now, time_machine(past, order), top)


def hotspots_by(now: Relations, changes: DataFrame, top: int = 20) -> DataFrame:
    """The same by given numbers of changes: repo_id, file_path, name, changes."""
    return rated_functions(now, changes.select("repo_id", "file_path", "name", "changes"), top).orderBy(F.desc("score"), "name", "file_path")


@tidy
def rated_functions(now: Relations, changes: DataFrame, top: int) -> DataFrame:
    rated = complexity(now).join(changes, ["repo_id", "file_path", "name"], "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    rated = cut(rated.select("file_path", "name", "complexity", "changes"), "rated")  # read by its own ranks
    n = rated.count()
    score = F.lit(1.0)
    ranked = rated
    # ranks from counts of distinct values, so no task sorts all functions
    for c in ("complexity", "changes"):
        counts = rated.groupBy(c).agg(F.count("*").alias("k"))
        below = counts.withColumn("below", F.coalesce(F.sum("k").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(c, F.col("below").alias(f"{c}_below"))
        ranked = ranked.join(below, c)
        score = score * F.coalesce(F.try_divide(F.col(f"{c}_below"), F.lit(n - 1)), F.lit(0.0))
    scored = ranked.select("file_path", "name", "complexity", "changes", F.round(score, 9).alias("score"))
    return scored.orderBy(F.desc("score"), "name", "file_path").limit(top)


def intent_mismatches(r: Relations, rules=INTENT_RULES) -> DataFrame:
    spark = r.facts.sparkSession
    table = F.broadcast(spark.createDataFrame(list(rules), "prefix string, forbidden string, required string, message string"))
    rated = r.function.join(table, F.startswith("name", "prefix"))
    # calls that repeat change no maximum, so they move once, by function
    made = calls(r).select(*PROVENANCE, F.col("caller_id").alias("func_id"), "base")
    joined = rated.join(made, [*PROVENANCE, "func_id"], "left")
    hit = F.max(F.coalesce(F.expr("base rlike forbidden"), F.lit(False)))
    met = F.max(F.coalesce(F.expr("base rlike required"), F.lit(False)))
    found = joined.groupBy(*PROVENANCE, "func_id", "name", "message", "forbidden", "required").agg(hit.alias("hit"), met.alias("met"))
    return found.where("(forbidden is not null and hit) or (required is not null and not met)").select(*PROVENANCE, "func_id", "name", "message")


def security_concerns(r: Relations, rules=SECURITY_RULES) -> DataFrame:
    """Calls whose callee's last name matches a rule; a call may match several."""
    return calls(r).select("*", hits(F.col("base"), rules)).select(*PROVENANCE, "caller_id", "called_func", "line", "hit.*")


def security_imports(r: Relations, rules=SECURITY_IMPORTS) -> DataFrame:
    """Dependencies whose name matches a rule."""
    return r.depends_on.select("*", hits(F.col("dep_name"), rules)).select(*PROVENANCE, "module_id", "dep_name", "line", "hit.*")


def hits(name: Column, rules) -> Column:
    """A row `hit` for each rule that name matches; the rules are constants of the plan, their patterns compiled once."""
    named = ("severity", "type", "message", "suggestion")
    matched = [F.when(name.rlike(pattern), F.struct(*(F.lit(v).alias(c) for c, v in zip(named, values, strict=True)))) for pattern, *values in rules]
    return F.explode(F.array_compact(F.array(*matched))).alias("hit")


def layer_violations(r: Relations, rules: list[tuple[str, str]]) -> DataFrame:
    """Module edges from a layer to one it must not depend on; rules: (prefix of src, prefix of dst)."""
    table = F.broadcast(r.facts.sparkSession.createDataFrame(rules, "src_layer string, dst_layer string"))
    edges = module_edges(r)
    return edges.join(table, F.startswith("src", "src_layer") & F.startswith("dst", "dst_layer")).select(*REPO, "src", "dst", "src_layer", "dst_layer").distinct()


def signatures(r: Relations) -> DataFrame:
    """Each function with its parameters in order, as name or name: type."""
    text = F.concat_ws(": ", "name", "type")
    params = r.function_param.groupBy(*PROVENANCE, "func_id").agg(F.sort_array(F.collect_set(F.struct("position", text.alias("t")))).alias("p"))
    joined = r.function.join(params, [*PROVENANCE, "func_id"], "left")
    listed = F.coalesce(F.array_join(F.transform("p", lambda z: z["t"]), ", "), F.lit(""))
    return joined.select(*PROVENANCE, "func_id", "name", "line", F.concat("name", F.lit("("), listed, F.lit(")")).alias("signature"))


def summary(r: Relations, grouping: str = "rollup") -> DataFrame:
    """Counts of functions by language and visibility with subtotals."""
    groups = getattr(r.function, grouping)("language", "visibility")
    return groups.agg(F.count("*").alias("functions"), F.sum("arity").alias("parameters"), F.countDistinct("file_path").alias("files"))
