"""Mergeable sketches of files: kept with a store, and merged over any range without reading facts again.

A file has its counts, a HyperLogLog sketch of the names it calls and a KLL sketch of its functions'
complexity. Both are built and merged by Spark's own aggregates, so a merge combines on the map side
and moves a few hundred bytes for a group, whatever lies behind it.

Bounds: a distinct count is off by `COUNT_ERROR` of its value in about 997 of 1,000 cases (three
standard errors of 1.04 / sqrt(2^LG_K)); a quantile's rank by `RANK_ERROR` in about 99 of 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import PROVENANCE, Relations
from .queries import calls, complexity

LG_K, K = 12, 200
COUNT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0165
FILE = [*PROVENANCE, "language"]


def file_sketches(r: Relations) -> DataFrame:
    """One row a file: functions, calls, and the sketches `callees` and `complexity` (null without any)."""
    called = calls(r).groupBy(*FILE).agg(F.count("*").alias("calls"), F.hll_sketch_agg("base", F.lit(LG_K)).alias("callees"))
    rated = complexity(r).groupBy(*PROVENANCE).agg(F.count("*").alias("functions"), F.kll_sketch_agg_bigint("complexity", K).alias("complexity"))
    files = r.files().select(*PROVENANCE).distinct().join(r.module.select(*FILE).distinct(), list(PROVENANCE))
    joined = files.join(called, FILE, "left").join(rated, list(PROVENANCE), "left")
    return joined.select(*FILE, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("functions", "calls")), "callees", "complexity")


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The same columns for groups of files, or of groups merged before."""
    counts = [F.sum(c).alias(c) for c in ("functions", "calls")]
    return sketches.groupBy(*by).agg(*counts, F.hll_union_agg("callees", F.lit(False)).alias("callees"), F.kll_merge_agg_bigint("complexity").alias("complexity"))


def estimates(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """callees becomes the number of distinct names called, complexity its quantiles at the ranks (null without functions)."""
    some = F.coalesce(F.kll_sketch_get_n_bigint("complexity"), F.lit(0)) > 0
    quantiles = F.when(some, F.array(*(F.kll_sketch_get_quantile_bigint("complexity", F.lit(rank)) for rank in ranks)))
    return sketches.withColumns({"callees": F.coalesce(F.hll_sketch_estimate("callees"), F.lit(0)), "complexity": quantiles})
