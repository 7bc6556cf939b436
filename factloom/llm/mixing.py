"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in order of id, form blocks of `BLOCK` documents. Time is cut into slots of
one block. A source with the weight w out of W releases its block j at slot floor(j W / w), due by
slot ceil((j + 1) W / w), and each slot goes to the released block that is due first (ties: the
source that comes first by name). On one lane this meets every deadline, so at any time each source
has had less than one block more or less than its exact share, for as long as it has blocks.

Weights are whole numbers, so the schedule repeats after W slots: it is made once on the driver (at
most `PERIOD` slots and one for each source) and broadcast, and every block finds its slot by
arithmetic. Documents are numbered by ranges of ids whose counts are added up, so no source is ever
sorted in one task.

Defined cases: null sources are a source of their own, named ''; null ids come first in their
source; repeated rows are each placed; sources without a positive weight get the weight 1; an empty
table gives an empty result; other columns, whatever their names, pass through `mix`.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK = 16
#: Slots of a schedule's period, but for at most one more for each source.
PERIOD = 2_048


def schedule(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period, earliest deadline first among released blocks."""
    total = sum(weights.values())
    waiting = [(0, s, 0) for s in weights]  # release time, source, block
    heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    slots = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heappop(waiting)
            heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        _, s, j = heappop(ready)
        slots.append(s)
        if j + 1 < weights[s]:
            heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return slots


def root_weights(docs: DataFrame, period: int = PERIOD) -> dict[str, int]:
    """Target weights in proportion to the square root of each source's documents, as whole numbers."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.floor(F.sqrt(F.count("*"))).alias("root"))
    roots = {r["s"]: int(r["root"]) for r in counts.collect()}  # one row for each source
    total = sum(roots.values())
    return {s: max(1, period * root // total) for s, root in roots.items()}


def numbered(docs: DataFrame, span: int = 4_096) -> DataFrame:
    """docs as columns `row` (a struct) and source, with n: its place among its source's documents by id.

    Ids are cut into ranges of `span` (rows without id by the hash that orders them); each range is
    numbered for itself, and what stands before it in its source is added: counts of ranges are added
    up in groups of `span`, those of groups in groups again, so sparse ids put no source in one task.
    """
    rows = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))
    nameless = F.shiftright(F.xxhash64("row"), 44) - (1 << 62)
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), nameless).otherwise(F.floor(F.col("id") / span)).cast("long"))
    counts = rows.groupBy("source", "range").agg(F.count("*").alias("c"))
    starts = sums_before(counts, span).withColumnRenamed("before", "start")
    # rows that share an id are told apart by a hash of the row; rows that are equal in all are the same in any order
    own = Window.partitionBy("source", "range").orderBy(F.asc_nulls_first("id"), F.xxhash64("row"))
    ranked = rows.withColumn("k", F.row_number().over(own) - 1)
    return ranked.join(starts, ["source", "range"]).select("source", "row", (F.col("k") + F.col("start")).alias("n"))


def sums_before(counts: DataFrame, span: int) -> DataFrame:
    """source, range, before: the sum of c over the smaller ranges of the source."""
    counts = written(counts, "ranges")
    most = counts.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    if most <= span:
        w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("source", "range", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    grouped = counts.withColumn("top", F.floor(F.col("range") / span))
    above = sums_before(grouped.groupBy("source", F.col("top").alias("range")).agg(F.sum("c").alias("c")), span)
    w = Window.partitionBy("source", "top").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.withColumn("inner", F.coalesce(F.sum("c").over(w), F.lit(0)))
    above = above.select("source", F.col("range").alias("top"), F.col("before").alias("above"))
    return inner.join(above, ["source", "top"]).select("source", "range", (F.col("inner") + F.col("above")).alias("before"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """docs as `row`, with source, block (its number in its source), slot and place (in the block).

    Sorted by (slot, place) the documents are mixed.
    """
    spark = docs.sparkSession
    if weights is None:
        weights = root_weights(docs)
    else:
        names = [r[0] for r in docs.select(F.coalesce("source", F.lit(""))).distinct().collect()]
        weights = {s: max(1, int(weights.get(s, 1))) for s in names}
    total = max(1, sum(weights.values()))
    seen: dict[str, int] = {}
    slots = []
    for slot, source in enumerate(schedule(weights)):
        slots.append((source, seen.setdefault(source, 0), slot, weights[source]))
        seen[source] += 1
    # at most PERIOD rows and one for each source
    plan = spark.createDataFrame(slots, "source string, turn long, offset long, weight long")
    sizes = spark.createDataFrame([*weights.items()], "source string, weight long")
    rows = numbered(docs).withColumn("block", F.floor(F.col("n") / block)).withColumn("place", F.col("n") % block)
    rows = rows.join(sizes, "source")  # small tables, which Spark broadcasts up to its own limit
    rows = rows.withColumn("turn", F.col("block") % F.col("weight"))
    rows = rows.join(plan.drop("weight"), ["source", "turn"])
    slot: Column = F.floor(F.col("block") / F.col("weight")) * total + F.col("offset")
    return rows.select("row", "source", F.col("block").cast("long").alias("block"), slot.cast("long").alias("slot"), F.col("place").cast("int").alias("place"))


def mixed(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """The rows of docs in mixed order: partitions and rows follow (slot, place)."""
    rows = mix(docs, weights).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return rows.select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("row.doc_id", "source", "block", "slot", "place")


def op5_sql() -> str:
    """The same rows in DuckDB SQL; the schedule is simulated slot by slot by recursion."""
    return f"""
    WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
    roots AS (SELECT source, CAST(floor(sqrt(count(*))) AS BIGINT) AS r FROM docs GROUP BY source),
    sizes AS (SELECT source, greatest(1, {PERIOD} * r // CAST((SELECT sum(r) FROM roots) AS BIGINT)) AS w FROM roots),
    fixed AS (SELECT list(source ORDER BY source) AS names, list(w ORDER BY source) AS ws, CAST(sum(w) AS BIGINT) AS total FROM sizes),
    plan(slot, given, chosen) AS (
      SELECT CAST(-1 AS BIGINT), list_transform((SELECT ws FROM fixed), lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT)
      UNION ALL
      SELECT slot, list_transform(given, lambda g, i: CASE WHEN i = chosen THEN g + 1 ELSE g END), chosen
      FROM (
        SELECT slot + 1 AS slot, given, list_min(list_filter(list_transform(ws, lambda w, i:
            CASE WHEN given[i] * total // w <= slot + 1 AND given[i] < w
                 THEN ((given[i] + 1) * total + w - 1) // w * 100000 + i END), lambda x: x IS NOT NULL)) % 100000 AS chosen
        FROM plan, fixed WHERE slot + 1 < total)),
    turns AS (
      SELECT names[chosen] AS source, slot, row_number() OVER (PARTITION BY chosen ORDER BY slot) - 1 AS turn
      FROM plan, fixed WHERE slot >= 0),
    numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM docs)
    SELECT doc_id, n.source, n // {BLOCK} AS block, CAST(n // {BLOCK} // w * (SELECT total FROM fixed) + slot AS BIGINT) AS slot,
      CAST(n % {BLOCK} AS INTEGER) AS place
    FROM numbered n JOIN sizes s ON n.source = s.source JOIN turns t ON t.source = n.source AND t.turn = n // {BLOCK} % w"""
