"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

The entropy of every window of `WINDOW` bytes is quantised to a level. Levels that few windows of
the corpus have are improbable; a window's rank is how common its level is over all documents
(`fit_rarity`, one table of fixed size). In each run of `SPAN` neighbouring windows the one of least
rank gets a vote; windows with `VOTES` votes are the document's features. Each feature sets `PROBES`
bits of a Bloom filter of `FILTER` bytes; after `FULL` features a new filter is chained. Digests are
compared filter by filter: bits in common, less those expected by chance, over the most possible.

Sliding entropies cost one comparison per byte and lag; everything is vectorised over documents.

Defined cases: null texts count as empty; an empty text has the empty digest, and two empty digests
are alike (1.0); a text shorter than a window is one feature as a whole; equal texts have equal
digests under one rarity table. Repeated ids are ordered by the hash of their text, null ids come
last; an empty `documents` gives an empty result; a table of one row is its own next document.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import ARRAYS, frugal, pack_arrays, table, tree_sum

WINDOW = 32
SPAN = 32
VOTES = 8
FILTER = 256
FULL = 128
PROBES = 5
LEVELS = 1024
#: Windows under this many bits are too plain to tell documents apart.
LEAST_BITS = 1.5
#: The rank of windows too plain to be features.
PLAIN = 1 << 20
_C = np.arange(WINDOW + 2)
#: c * log2(c) for counts c in a window, in 1/65536 bits so that sums are exact.
_CLOG = np.round(65536 * _C * np.log2(np.maximum(_C, 1))).astype(np.int32)
_STEP = np.diff(_CLOG)
_BLOCK = 1 << 17
#: Bytes of text that a task sorts and compares, about.
SLICE = 16 << 20


def levels(buf: np.ndarray) -> np.ndarray:
    """The entropy level of each window of buf (at least one window long)."""
    n = len(buf) - WINDOW + 1
    if n > _BLOCK:  # in pieces that fit the processor's cache
        return np.concatenate([levels(buf[i : i + _BLOCK + WINDOW - 1]) for i in range(0, n, _BLOCK)])
    before, after = np.zeros(len(buf), dtype=np.uint8), np.zeros(len(buf), dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = _CLOG[np.bincount(buf[:WINDOW], minlength=256)].sum()
    # a window loses its first byte, that stood there 1 + after times, and gains one that stood before times
    change = _STEP[before[WINDOW:]] - _STEP[after[: n - 1]]
    repeated = np.cumsum(np.concatenate([[first], change]), dtype=np.int64)
    bits = np.log2(WINDOW) - repeated / (65536 * WINDOW)
    return np.clip(np.round(bits * ((LEVELS - 1) / np.log2(WINDOW))), 0, LEVELS - 1).astype(np.int64)


def features(raw: bytes, rank: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows in order of place; rank: of each level."""
    if not raw:
        return np.empty(0, dtype=np.uint64)
    buf = np.frombuffer(raw, dtype=np.uint8)
    sums = textops.prefix_hash(buf)
    n = len(buf) - WINDOW + 1
    if n < 1:
        return textops.range_hash(sums, np.array([0]), np.array([len(buf)]))
    ranks = rank[levels(buf)]
    key = (ranks << 40) | np.arange(n)
    if n <= SPAN:
        at = np.array([key.min() & (1 << 40) - 1])
    else:
        padded = np.concatenate([key, np.full(-n % SPAN, 1 << 62)]).reshape(-1, SPAN)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - SPAN + 1], ahead[SPAN - 1 : n])
        votes = np.bincount(least & (1 << 40) - 1, minlength=n)
        at = np.flatnonzero(votes >= VOTES)
        at = at[ranks[at] < PLAIN]
        if not len(at):
            at = np.array([least.min() & (1 << 40) - 1])
    return textops.range_hash(sums, at, at + WINDOW)


def digest(raw: bytes, rank: np.ndarray) -> np.ndarray:
    """Bloom filters, one a row; equal features count once."""
    hashes = features(raw, rank)
    if not len(hashes):
        return np.empty((0, FILTER), dtype=np.uint8)
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    filters = np.zeros((-(-len(hashes) // FULL), FILTER * 8), dtype=np.uint8)
    row = np.arange(len(hashes)) // FULL
    for k in range(PROBES):
        filters[row, (hashes >> np.uint64(12 * k)).astype(np.int64) & FILTER * 8 - 1] = 1
    return np.packbits(filters, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised overlap from 0 to 1: of each filter of the shorter digest, its best match's; the mean."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(b) < len(a):
        a, b = b, a
    a, b = a.view(np.uint64), b.view(np.uint64)
    na, nb = np.bitwise_count(a).sum(axis=1).astype(int), np.bitwise_count(b).sum(axis=1).astype(int)
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(axis=1)
        most = np.minimum(na[i], nb)
        chance = na[i] * nb / (FILTER * 8)
        chance = chance + 2 * np.sqrt(chance)
        room = most - chance
        best[i] = np.max(np.where(room >= 1, np.clip((both - chance) / np.maximum(room, 1), 0, 1), both == np.maximum(na[i], nb)))
    return float(np.average(best, weights=na))


def text_of(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def of_text(said: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(said), dtype=np.uint8).reshape(-1, FILTER)


def fit_rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy level: its share of all windows of all documents, in millionths.

    Levels of plain windows rank last.
    """

    @frugal
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS, dtype=np.int64)
        for pdf in batches:
            for x in pdf[text]:
                raw = np.frombuffer((x or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
                if len(raw) >= WINDOW:
                    total += np.bincount(levels(raw), minlength=LEVELS)
        yield pack_arrays(TaskContext.get().partitionId(), total, 1)

    seen = tree_sum(docs.select(text).mapInPandas(count, ARRAYS), (LEVELS,), "int64", 1)
    rank = (seen / max(1, seen.sum()) * (PLAIN - 2)).astype(np.int64) + 1
    rank[: int(LEAST_BITS * (LEVELS - 1) / np.log2(WINDOW))] = PLAIN
    return rank


def edited_pairs(docs: DataFrame, rank: np.ndarray, slices: int | None = None) -> DataFrame:
    """Each document's digest, that of its edited text, and how alike they and the next document are.

    The order is by descending doc_id, then the text's hash. It is cut at approximate quantiles into
    slices of about `SLICE` bytes, and where many rows share an id (or have none) by hash. A slice is
    one task's, is sorted there and gets the first document of the next slice too, so texts move once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumns({"o": F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)), "nameless": F.col("doc_id").isNull(), "h": F.xxhash64("text")})
    if not slices:
        size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE))
    found = keyed.agg(F.percentile_approx("o", [i / slices for i in range(1, slices)], max(10_000, 20 * slices))).first()[0]
    # a quantile that comes again and again is an id of many rows, which get as many slices more
    again = Counter(found or [])
    cuts = sorted(again)
    more = [again[c] - 1 for c in cuts]
    starts = np.cumsum([0, *(m + 1 for m in more)]).tolist()
    known, o = F.lit(cuts).cast("array<long>"), F.col("o")
    # how many cuts are below, by steps of halved length
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))]).cast("array<int>")
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(known, at + step - 1) < o, step).otherwise(0))
    spread = F.get(F.lit(more).cast("array<int>"), F.col("below"))
    part = F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * (spread + 1)), spread)
    shares = (F.get(known, F.col("below")) == o) & (F.col("nameless") | (o < (1 << 63) - 1))
    place = F.get(F.lit(starts).cast("array<int>"), F.col("below")) + F.when(shares, part).otherwise(0)
    sliced = keyed.withColumn("below", below).withColumn("slice", place.cast("int")).drop("below")
    # the first document of each slice: as many as slices
    heads = dict(sliced.groupBy("slice").agg(F.min(F.struct("o", "nameless", "h")).alias("key")).collect())
    order = sorted(heads)
    before = {s: order[k - 1] for k, s in enumerate(order)}  # the first slice's head follows the last slice

    def of_slice(values: dict) -> Column:
        return F.get(F.lit([values.get(s) for s in range(starts[-1] + 1)]).cast("array<long>"), F.col("slice"))

    head = F.lit(True)
    for c in ("o", "nameless", "h"):
        head = head & (F.col(c).cast("long") == of_slice({s: int(k[c]) for s, k in heads.items()}))
    own, extra = F.struct(F.col("slice").alias("s"), F.lit(False).alias("extra")), F.struct(of_slice(before).cast("int").alias("s"), F.lit(True).alias("extra"))
    moved = sliced.withColumn("at", F.explode(F.when(head, F.array(own, extra)).otherwise(F.array(own))))
    moved = moved.select("at.s", "at.extra", "o", "nameless", "h", "text")
    moved = moved.repartitionById(starts[-1] + 1, F.col("s")).sortWithinPartitions("s", "extra", "o", "nameless", "h")
    moved = moved.select("s", "extra", F.when(~F.col("nameless"), F.bitwise_not("o")).alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(rank)

    @frugal
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shared.value
        held = None  # the document before: slice, id, text, digest
        extra_seen = None

        def row(held, text, filters):
            _, doc_id, own, own_filters = held
            cut = len(own) // 3
            edited = own[: len(own) - cut] + text[:cut]
            raw = edited.encode("utf-8", "surrogatepass")
            changed = own_filters if edited == own else digest(raw, rank)
            return (doc_id, len(own), hashlib.sha256(raw).hexdigest(), text_of(own_filters), text_of(changed), likeness(own_filters, changed), likeness(own_filters, filters))

        for pdf in batches:
            rows = []
            for s, extra, doc_id, text in zip(pdf["s"], pdf["extra"], pdf["doc_id"], pdf["text"], strict=True):
                if extra and extra_seen == s:  # equal rows may share the place of first document
                    continue
                filters = digest(text.encode("utf-8", "surrogatepass"), rank)
                if held is not None and held[0] == s:
                    rows.append(row(held, text, filters))
                if extra:
                    extra_seen, held = s, None
                else:
                    held = (s, None if pd.isna(doc_id) else int(doc_id), text, filters)
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    return moved.mapInPandas(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_pairs(docs, fit_rarity(docs))
