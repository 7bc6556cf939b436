"""Joins of two sets of closed intervals that overlap, as a join by equality.

Bins come in sizes, each `STEP` times the one below. An interval belongs to the smallest size that is
no smaller than itself, so it lies in two bins of that size at most, however long it is; it also visits
the bins of all larger sizes in use. Two intervals that overlap meet in the size of the longer one, in
the bin where their overlap starts, and there only. So no pair comes twice, a row is copied twice for
each size at most (sizes in use are few: 15 for a range of 2^45), and a file of any share of the rows is
spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 8
#: Exponent of the largest bins; a longer interval lies in a few of them.
LARGEST = 20
WIDTH = f"shiftleft(1L, _size * {STEP.bit_length() - 1})"


def _size(length: Column) -> Column:
    """The exponent of the smallest bin that is no smaller than the length."""
    size = F.lit(0)
    for e in range(1, LARGEST + 1):
        size = F.when(length > STEP ** (e - 1), e).otherwise(size)
    return size.cast("int")


def _bin(c: str) -> Column:
    """The bin of width `_width` that the place c lies in; div cuts towards 0."""
    return F.expr(f"CASE WHEN {c} >= 0 THEN {c} div _width ELSE -((-{c} + _width - 1) div _width) END")


def _binned(df: DataFrame, by: list[str], start: str, end: str, sizes: list[int], side: str) -> DataFrame:
    """A row for each bin that an interval owns or visits; an interval without start or end, or that ends before it starts, has none."""
    row = [F.col(c).alias(f"_{side}_{c}") for c in df.columns]
    sized = df.where(F.col(start) <= F.col(end)).select(*(F.col(c).alias(f"_{c}") for c in by), F.col(start).alias("_s"), F.col(end).alias("_e"), *row)
    own = sized.withColumn("_own", _size(F.col("_e") - F.col("_s") + 1))
    larger = F.filter(F.array(*map(F.lit, sizes)), lambda e: e >= F.col("_own"))
    spread = own.withColumn("_size", F.explode(larger)).withColumn("_width", F.expr(WIDTH))
    # an owner of the left meets all of the right, a visitor meets owners: two visitors never do
    owner = F.col("_own") == F.col("_size")
    meets = F.when(owner, F.array(F.lit(1))).otherwise(F.array(F.lit(2))) if side == "left" else F.when(owner, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return spread.withColumn("_bin", F.explode(F.sequence(_bin("_s"), _bin("_e")))).withColumn("_meets", F.explode(meets)).drop("_width")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], left_ends: tuple[str, str] = ("start", "end"), right_ends: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of rows as structs `left` and `right` that agree in `by` and whose intervals share a point.

    Ends are whole numbers and belong to the intervals. Null keys match nothing; repeated rows are rows.
    """
    ends = [(left, *left_ends), (right, *right_ends)]
    used = [df.where(F.col(s) <= F.col(e)).select(_size(F.col(e) - F.col(s) + 1).alias("size")).distinct() for df, s, e in ends]
    sizes = sorted(r["size"] for r in used[0].union(used[1]).distinct().collect())  # LARGEST + 1 at most
    if not sizes:
        sizes = [0]
    a, b = _binned(left, by, *left_ends, sizes, "left"), _binned(right, by, *right_ends, sizes, "right")
    b = b.withColumnsRenamed({"_s": "_s2", "_e": "_e2", "_own": "_own2"})
    met = a.join(b, [*(f"_{c}" for c in by), "_size", "_bin", "_meets"])
    met = met.withColumn("_width", F.expr(WIDTH)).withColumn("_from", F.greatest("_s", "_s2"))
    met = met.where((F.col("_from") <= F.least("_e", "_e2")) & (_bin("_from") == F.col("_bin")))
    whole = lambda df, side: F.struct(*(F.col(f"_{side}_{c}").alias(c) for c in df.columns)).alias(side)
    return met.select(whole(left, "left"), whole(right, "right"))


def innermost(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Of the pairs of overlaps(), for each left row (by the columns of `key`) the right one that starts last, then ends first."""
    order = F.struct(F.col("right.start"), (-F.col("right.end")).alias("e"), "right")
    return pairs.groupBy(*(F.col(f"left.{c}").alias(c) for c in key)).agg(F.max(order)["right"].alias("right"))
