"""Secret scan with multipart credential linking, in DataFrame functions only.

Every text is searched for strong spans (assignments of secrets, access identifiers, long hex) and
weak candidates (other key identifiers, mixed-case blobs, endpoints). The strong ones are reported
as they are. A weak one is reported only where the parts that complete a credential stand within
`reach` code points of it in the same document:

    key_id    a secret (assign, hex or blob)
    blob      an identifier (access or key_id)
    endpoint  an identifier and a secret

Scopes are intervals around each part. They are joined by a sweep in order of position that keeps
the nearest identifier and secret on either side, so no pairs are made, and rows move by document,
never by source or value.

Defined cases: null text counts as empty; empty texts have zero counts and empty lists; repeated
rows are each answered; a null doc_id is kept; other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: name, pattern, group that must be long enough, its least length, strong or weak, role.
#: Fixed values; order is the order of kinds in results.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True, "identifier"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True, "secret"),
    ("key_id", r"(ASIA|AROA|AIDA|AGPA|ANPA)[A-Z0-9]{12,}", 0, 16, False, "identifier"),
    ("blob", r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32, False, "secret"),
    ("endpoint", r"""https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9._~/-]*)?""", 0, 10, False, "endpoint"),
)
BASE = tuple(k[0] for k in KINDS if k[4])
REACH = 200
PART = "array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>"


def _parts(text: Column, no: int) -> Column:
    """One entry for each match of kind `no`: what lies between it and the match before, and its size."""
    name, pattern, group, least, _, _ = KINDS[no]
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), tested.alias("tested"))

    def entry(x: Column, i: Column) -> Column:
        ok = F.char_length(x["tested"]) >= least
        if name == "blob":
            ok = ok & x["whole"].rlike("[A-Z]") & x["whole"].rlike("[a-z]") & x["whole"].rlike("[0-9]")
        return F.struct(
            F.lit(no).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("size"), ok.alias("ok")
        )

    return F.when(text.rlike(pattern), F.transform(zipped, entry).cast(PART)).otherwise(F.array().cast(PART))


def link_credentials(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document: doc_id and spans, an ordered array of (start, kind, end, strong).

    kind is the place in KINDS; start and end count code points, end exclusive.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # an entry without kind stands for the document itself, whatever its matches
    itself = F.array(F.lit(None)).cast(PART)
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(itself, *(_parts(text, k) for k in range(len(KINDS)))).alias("parts"))
    parts = found.select("doc_id", "row", F.explode_outer("parts").alias("p")).select("doc_id", "row", "p.*").repartition("row")

    by_kind = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(by_kind))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    # matches that fail their test go, and the last gap of a kind, which has no match after it
    placed = placed.where("kind is null or ok")

    names = F.array(*(F.lit(k[5]) for k in KINDS))
    placed = placed.withColumn("role", F.get(names, F.col("kind"))).withColumn("strong", F.col("kind") < len(BASE))
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def role(name: str, value: str) -> Column:
        return F.when(F.col("role") == name, F.col(value))

    swept = placed
    for name in ("identifier", "secret"):
        swept = swept.withColumn(f"{name}_before", F.max(role(name, "end")).over(before))
    swept = swept.withColumn("strong_before", F.max(F.when(F.col("strong"), F.col("end"))).over(before))
    for name in ("identifier", "secret"):
        swept = swept.withColumn(f"{name}_after", F.min(role(name, "start")).over(after))
    swept = swept.withColumn("strong_after", F.min(F.when(F.col("strong"), F.col("start"))).over(after))

    def near(name: str) -> Column:
        close = (F.col("start") - F.col(f"{name}_before") <= reach) | (F.col(f"{name}_after") - F.col("end") <= reach)
        return F.coalesce(close, F.col("start") - F.col(f"{name}_before") <= reach, F.col(f"{name}_after") - F.col("end") <= reach, F.lit(False))

    inside = F.coalesce(F.col("strong_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("strong_after") < F.col("end"), F.lit(False))
    wanted = {"key_id": near("secret"), "blob": near("identifier"), "endpoint": near("identifier") & near("secret")}
    linked = F.lit(False)
    for no, kind in enumerate(KINDS):
        if kind[0] in wanted:
            linked = linked | ((F.col("kind") == no) & wanted[kind[0]])
    kept = F.when(F.col("strong") | (linked & ~inside), F.struct("start", "kind", "end", "strong"))
    return swept.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(kept)).alias("spans")).drop("row")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans over all of `documents`."""
    spans = link_credentials(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k[0]) for k in KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    strong = F.filter("spans", lambda s: s["strong"])

    def count(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long")

    counts = [count(no).alias(f"n_{name}") for no, name in enumerate(BASE)]
    return spans.select("doc_id", *counts, F.sha2(listed(strong), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_sql() -> str:
    """The same rows in DuckDB SQL."""
    found = []
    for no, (name, pattern, group, least, strong, role) in enumerate(KINDS):
        pattern = pattern.replace("'", "''")
        mixed = " AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')" if name == "blob" else ""
        found.append(
            f"""SELECT rid, {no} AS kind, '{name}' AS name, '{role}' AS role, {str(strong).upper()} AS strong,
            sum(length(g) + length(w)) OVER (PARTITION BY rid ORDER BY i) AS stop, length(w) AS size, length(t) >= {least}{mixed} AS ok
            FROM (SELECT rid, unnest(range(len(ws))) AS i, unnest(gs[1:len(ws)]) AS g, unnest(ws) AS w, unnest(ts) AS t
                  FROM (SELECT rid, string_split_regex(txt, '{pattern}') AS gs, regexp_extract_all(txt, '{pattern}', 0) AS ws,
                        regexp_extract_all(txt, '{pattern}', {group}) AS ts FROM docs))"""
        )
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt FROM documents),
    raw AS ({" UNION ALL ".join(found)}),
    parts AS (SELECT *, CAST(stop AS BIGINT) AS e, CAST(stop - size AS BIGINT) AS s FROM raw WHERE ok),
    swept AS (
      SELECT *,
        max(e) FILTER (WHERE role = 'identifier') OVER b AS ib, max(e) FILTER (WHERE role = 'secret') OVER b AS sb,
        max(e) FILTER (WHERE strong) OVER b AS tb,
        min(s) FILTER (WHERE role = 'identifier') OVER a AS ia, min(s) FILTER (WHERE role = 'secret') OVER a AS sa,
        min(s) FILTER (WHERE strong) OVER a AS ta
      FROM parts
      WINDOW b AS (PARTITION BY rid ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             a AS (PARTITION BY rid ORDER BY s DESC, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    near AS (
      SELECT *, coalesce(s - ib <= {REACH}, FALSE) OR coalesce(ia - e <= {REACH}, FALSE) AS near_i,
        coalesce(s - sb <= {REACH}, FALSE) OR coalesce(sa - e <= {REACH}, FALSE) AS near_s,
        coalesce(tb > s, FALSE) OR coalesce(ta < e, FALSE) AS inside FROM swept),
    kept AS (
      SELECT *, name || ':' || s || ':' || e AS said FROM near
      WHERE strong OR (NOT inside AND ((name = 'key_id' AND near_s) OR (name = 'blob' AND near_i) OR (name = 'endpoint' AND near_i AND near_s))))
    SELECT doc_id, count(*) FILTER (WHERE name = 'assign') AS n_assign, count(*) FILTER (WHERE name = 'access') AS n_access,
      count(*) FILTER (WHERE name = 'hex') AS n_hex,
      sha256(coalesce(string_agg(said, ',' ORDER BY s, kind) FILTER (WHERE strong), '')) AS base_sha256,
      coalesce(string_agg(said, ',' ORDER BY s, kind), '') AS spans
    FROM docs LEFT JOIN kept USING (rid) GROUP BY rid, doc_id"""
