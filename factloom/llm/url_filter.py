"""URL filter: rules by host and path, then a Bloom filter cascade over a list of keys.

A URL has as keys its host, every domain above the host, and its address (host and path, without
slashes at the end). It is listed if one of its keys is on the list. The cascade answers that without
a join and without error for all keys of the corpus:

    level 1  encodes the listed keys; other keys of the corpus may pass it by mistake
    level 2  encodes those mistakes; listed keys may pass it by mistake
    level 3  encodes those, and so on until a level makes no mistake

A key's first level that says no decides: an odd one means not listed, an even one listed. Keys are
dealt by hash to shards of about `SHARD_KEYS` keys, and a task builds all levels of a shard. Filters
are broadcast up to `LIMIT` bytes at a time; larger ones take several passes over the URLs, each with
some of the shards. Rows move by hash of a distinct key only, so a frequent host is one key.

Defined cases: a null URL or one without `://` has an empty host and path and no keys, so it is
allowed; empty tables give empty ones; repeated rows are each answered; a list without keys lists
nothing; null and repeated keys of a list are ignored; a listed key that the corpus doesn't hold
changes nothing. Parents of a host are those of its last `NAME` code points (no name is longer);
the host itself is a key whatever its length. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table, written

#: verdict, host, start of the path. The longest rule (host and path) that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The query's list: hosts of the corpus with a label that has one of these among its hyphenated words.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
SHARD_KEYS = 200_000
LIMIT = 32 << 20
NAME = 253
LEVEL = "shard int, level int, size long, probes int, bits binary, clash boolean"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: str = "url") -> tuple[Column, Column]:
    """host and path of a URL."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def keys(host: Column, path: Column) -> Column:
    """The distinct keys of a URL; none without a host."""
    tail = F.split(F.right(host, F.lit(NAME + 1)), r"\.")
    first = F.when(F.char_length(host) > NAME + 1, 2).otherwise(1)
    parents = F.transform(F.sequence(first, F.greatest(F.size(tail), first)), lambda i: F.array_join(F.slice(tail, i, F.size(tail)), "."))
    whole = F.concat(host, F.rtrim(path, F.lit("/")))
    found = F.filter(F.concat(F.array(host, whole), parents), lambda k: k != "")
    return F.when(host != "", F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _hashes(key: Column, seed: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(f"{seed}/{i}")) for i in range(3)]


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _places(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of a key's probes at a level; h: two hashes a key."""
    return _mix(h[:, 0], level) >> np.uint64(2), (_mix(h[:, 1], level) >> np.uint64(34)) | np.uint64(1)


def bloom(h: np.ndarray, level: int, rate: float) -> tuple[int, int, np.ndarray]:
    """Size in bits, number of probes, and bytes of a filter of the keys h with that rate of mistakes."""
    probes = max(1, ceil(log(1 / rate, 2)))
    size = max(8, ceil(probes * len(h) / log(2)))
    at, step = _places(h, level)
    bits = np.zeros(size, dtype=np.uint8)
    for j in range(probes):
        bits[(at + np.uint64(j) * step) % np.uint64(size)] = 1
    return size, probes, np.packbits(bits, bitorder="little")


def passes(h: np.ndarray, level: int, size: np.ndarray | int, probes: np.ndarray | int, bits: np.ndarray, offset: np.ndarray | int = 0) -> np.ndarray:
    """Which keys a level lets through; size, probes and offset (in bytes) may differ by key."""
    at, step = _places(h, level)
    size, probes, offset = (np.broadcast_to(np.asarray(x, dtype=np.int64), len(h)) for x in (size, probes, offset))
    yes = np.ones(len(h), dtype=bool)
    for j in range(int(probes.max(initial=0))):
        i = np.flatnonzero(yes & (probes > j))
        place = ((at[i] + np.uint64(j) * step[i]) % size[i].astype(np.uint64)).astype(np.int64)
        yes[i] = bits[offset[i] + (place >> 3)] >> (place & 7).astype(np.uint8) & 1
    return yes


def cascade(listed: np.ndarray, others: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Levels that tell the listed keys from the others; both are pairs of hashes, no pair in both."""
    levels = []
    inside, outside = listed, others
    while len(inside):
        rate = min(0.5, sqrt(0.5) * len(inside) / max(1, len(outside))) if not levels else 0.5
        level = len(levels)
        levels.append(bloom(inside, level, rate))
        inside, outside = outside[passes(outside, level, *levels[-1])], inside
    return levels


def build(known: DataFrame, shards: int) -> DataFrame:
    """Levels of every shard; known: h0, h1, listed, clash, one row for each key."""

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf[["h0", "h1"]].to_numpy(dtype=np.int64).view(np.uint64)
        on = pdf["listed"].to_numpy(dtype=bool)
        shard, clash = int(pdf["shard"].iloc[0]), bool(pdf["clash"].any())
        made = [] if clash else cascade(h[on], h[~on])
        rows = [(shard, i, size, probes, bits.tobytes(), False) for i, (size, probes, bits) in enumerate(made)]
        return pd.DataFrame(rows or [(shard, 0, 0, 0, b"", clash)], columns=["shard", "level", "size", "probes", "bits", "clash"])

    dealt = known.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(levels, LEVEL)


def fit(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """Levels as a written table, number of shards, and seed; both inputs have a column `key`.

    A pair of hashes that stands for two keys is found by a third hash; other seeds are taken then.
    """
    for seed in range(100):
        h = lambda df, on: df.select(*(c.alias(f"h{i}") for i, c in enumerate(_hashes(F.col("key"), seed))), F.lit(on).alias("listed"))
        both = h(universe, False).unionByName(h(listed.where("key is not null"), True))
        known = both.groupBy("h0", "h1").agg(F.max("listed").alias("listed"), (F.min("h2") != F.max("h2")).alias("clash"))
        known = written(known, "url-keys")
        shards = max(1, -(-known.count() // shard_keys))
        levels = written(build(known, shards), "url-levels")
        if levels.where("clash").isEmpty():
            return levels.where("size > 0"), shards, seed
    raise ValueError("the hashes of keys clash for every seed")


class Filter:
    """Some shards' levels, in arrays that answer for many keys at once."""

    def __init__(self, shards: int, rows: list[tuple[int, int, int, int, bytes]]):
        depth = max((r[1] + 1 for r in rows), default=0)
        self.size, self.probes, self.offset = (np.zeros((depth, shards), dtype=np.int64) for _ in range(3))
        self.depth = np.zeros(shards, dtype=np.int64)
        at = 0
        for shard, level, size, probes, bits in rows:
            self.size[level, shard], self.probes[level, shard], self.offset[level, shard] = size, probes, at
            self.depth[shard] = max(self.depth[shard], level + 1)
            at += len(bits)
        self.bits = np.frombuffer(b"".join(r[4] for r in rows) or b"\0", dtype=np.uint8)

    def lists(self, h: np.ndarray) -> np.ndarray:
        """Which keys are listed, of those in the shards that are here; others count as not listed."""
        shard = h[:, 1].view(np.int64) % len(self.depth)
        # a key that all levels let through belongs to the set that the last one encodes
        found = self.depth[shard] % 2 == 1
        alive = np.arange(len(h))
        for level in range(len(self.size)):
            alive = alive[self.depth[shard[alive]] > level]
            s = shard[alive]
            yes = passes(h[alive], level, self.size[level, s], self.probes[level, s], self.bits, self.offset[level, s])
            found[alive[~yes]] = level % 2 == 1
            alive = alive[yes]
        return found


def _groups(levels: DataFrame, limit: int) -> list[list[int]]:
    """Shards in groups whose filters stay under limit bytes (a larger shard is a group of its own)."""
    out, total = [[]], 0
    for row in levels.groupBy("shard").agg(F.sum(F.octet_length("bits")).alias("n")).orderBy("shard").toLocalIterator():
        if out[-1] and total + row["n"] > limit:
            out.append([])
            total = 0
        out[-1].append(row["shard"])
        total += row["n"]
    return out


def on_list(urls: DataFrame, levels: DataFrame, shards: int, seed: int, limit: int = LIMIT) -> DataFrame:
    """urls (with a column `keys`) with `listed` in its place."""
    spark = urls.sparkSession
    hashed = [F.transform("keys", lambda k: _hashes(k, seed)[0]).alias("_h0"), F.transform("keys", lambda k: _hashes(k, seed)[1]).alias("_h1")]
    out = urls.select(*(c for c in urls.columns if c != "keys"), *hashed, F.lit(False).alias("listed"))
    schema = out.schema
    groups = _groups(levels, limit)
    for n, group in enumerate(groups):
        rows = [tuple(r) for r in levels.where(F.col("shard").between(group[0], group[-1])).select("shard", "level", "size", "probes", "bits").collect()] if group else []
        known = spark.sparkContext.broadcast(Filter(shards, rows))

        def ask(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(batch.schema.get_field_index(f"_h{i}")) for i in range(2))
                ends = a.offsets.to_numpy().astype(np.int64) - a.offsets[0].as_py()
                h = np.stack([x.flatten().to_numpy(zero_copy_only=False) for x in (a, b)], axis=1).astype(np.int64).view(np.uint64)
                hits = np.concatenate([[0], np.cumsum(known.value.lists(h))])
                at = batch.schema.get_field_index("listed")
                listed = batch.column(at).to_numpy(zero_copy_only=False).astype(bool) | (hits[ends[1:]] > hits[ends[:-1]])
                yield batch.set_column(at, batch.schema.field(at), pa.array(listed))

        out = out.mapInArrow(frugal(ask), schema)
        if n + 1 < len(groups):
            out = written(out, "url-pass")
    return out.drop("_h0", "_h1")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, shard_keys: int = SHARD_KEYS, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    listed: the list, as a column `key` of hosts, domains or addresses.
    """
    host, path = address()
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", keys(F.col("host"), F.col("path")))
    levels, shards, seed = fit(urls.select(F.explode("keys").alias("key")), listed.select("key"), shard_keys)
    ruled = decided(F.col("host"), F.col("path"), rules)
    told = on_list(urls, levels, shards, seed, limit).withColumn("_rule", ruled)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return told.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict over all of `pages`; the list holds its hosts with a listed word."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(address()[0].alias("key")).distinct()
    return judge(pages, hosts.where(F.arrays_overlap(F.split("key", "[.-]"), F.array(*map(F.lit, LISTED_WORDS)))))


def op13_sql() -> str:
    """The same rows in DuckDB SQL."""
    rules = ", ".join(f"('{v}', '{d}', '{s}')" for v, d, s in RULES)
    words = ", ".join(f"'{w}'" for w in LISTED_WORDS)
    return f"""
    WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest,
        row_number() OVER () AS rid FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
    u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    r AS (SELECT * FROM (VALUES {rules}) t(v, d, s)),
    f AS (SELECT rid, arg_max(d || s, (length(d) + length(s), length(d))) AS rule, arg_max(v, (length(d) + length(s), length(d))) AS v
        FROM u JOIN r ON (host = d OR ends_with(host, '.' || d)) AND starts_with(path, s) GROUP BY rid)
    SELECT page_id, host, path, rule,
        coalesce(v, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), [{words}]) THEN 'block' ELSE 'allow' END) AS verdict
    FROM u LEFT JOIN f USING (rid)"""
