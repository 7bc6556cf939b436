"""Spelling variants: rare words lead to a frequent word one edit away.

The whole neighbourhood of every word is generated: all distinct deletions of one code point, and all
distinct replacements and insertions over the alphabet that the words use. A candidate that is a word
is near; no distance is computed. Candidates exist as hashes at first: with the hashes of a word's
beginnings and ends, those of its neighbours are one array expression, for all words of a length at
once. A Bloom filter of the vocabulary (32 bits a word, `MOST_BITS` at most, so its size is bounded
and a larger vocabulary only lets more through) drops nearly all that are no words; the rest become
strings and meet the vocabulary in a hash join by the whole string, which alone decides.

Counting is a map and a sum that combines before its shuffle, and no step groups by a document or by
anything else than a word. Words of any length are taken: neighbourhoods are made `CELLS` hashes at a
time. Forms are followed to their last by pointer jumping; each step is at least ten times as
frequent, so there are few.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty text before the
colon; repeated rows count again; an empty table gives no words; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table, written

RUN = "A-Za-zÀ-ÿ"
LEAST = 7
TWICE = 2
FACTOR = 10
ONE_IN = 31
CELLS = 2_000_000
#: Words whose neighbourhoods a task makes, about.
WORDS_A_TASK = 50_000
BITS_A_WORD, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 29
PROBES = 4
#: The bit array reaches the driver in pieces of so many bits.
PIECE = 1 << 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Multipliers of the rolling hash and of its mix; any odd numbers do.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts with one code point dropped where the hash of document and run says so."""
    run = F.translate("run", _UPPER, _LOWER)
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{RUN}]{{{LEAST},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", run.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % ONE_IN == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    words = found.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= LEAST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def _starts(points: np.ndarray) -> np.ndarray:
    """Hashes of the first i code points, for i from 0 to all: h(s + c) = h(s) * base + c + 1."""
    out = np.zeros((len(points), points.shape[1] + 1), dtype=np.uint64)
    for i in range(points.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + points[:, i] + np.uint64(1)
    return out


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), out=out)
    return out


def _probes(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    x = h + np.uint64((j + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * _MIX[j & 1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[~j & 1]
    return ((x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def by_length(words: list[str], least: int = 1) -> Iterator[list[str]]:
    """Words of one length each, in lists of at most CELLS cells: a word has one for each code point, and `least` at least."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for size, group in groups.items():
        step = max(1, CELLS // max(size, least))
        yield from (group[i : i + step] for i in range(0, len(group), step))


def word_hashes(words: list[str]) -> np.ndarray:
    """The rolling hash of every word, in any order."""
    return np.concatenate([_starts(_points(group))[:, -1] for group in by_length(words)]) if words else np.zeros(0, np.uint64)


def neighbourhood(points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(kind, first place, hashes, distinct): all neighbours of words of one length, by place.

    hashes are (words, places, letters), letters one for deletions; distinct marks each neighbour of
    a word once, however many edits make it, and never the word itself.
    """
    n, size = points.shape
    starts, powers = _starts(points), _powers(size + 1)
    letters = alphabet.astype(np.uint64)
    step = max(1, CELLS // max(1, n * len(letters)))

    def end(i: np.ndarray) -> np.ndarray:
        """Hash of what follows the first i code points."""
        return starts[:, -1:] - starts[:, i] * powers[size - i]

    for at in range(0, size + 1, step):
        i = np.arange(at, min(at + step, size + 1))
        before = np.where(i > 0, points[:, np.maximum(i - 1, 0)], 0)  # no letter is 0
        into = starts[:, i, None] * _BASE + letters + np.uint64(1)
        # a letter put before one of its own kind is the same as one put behind it
        yield "insert", at, into * powers[size - i][:, None] + end(i)[:, :, None], before[:, :, None] != letters
        i = i[i < size]
        if not len(i):
            continue
        into = starts[:, i, None] * _BASE + letters + np.uint64(1)
        yield "replace", at, into * powers[size - i - 1][:, None] + end(i + 1)[:, :, None], points[:, i, None] != letters
        # of equal code points in a row, only the first is dropped
        yield "delete", at, (starts[:, i] * powers[size - i - 1] + end(i + 1))[:, :, None], (before[:, : len(i)] != points[:, i])[:, :, None]


def neighbours(words: list[str], alphabet: str, known: np.ndarray | None = None) -> Iterator[tuple[str, str]]:
    """(word, neighbour) over the whole neighbourhoods, or of those that the filter lets through.

    known: the filter's bits, a power of two of them, packed.
    """
    letters = np.array([ord(c) for c in alphabet], dtype=np.uint64)
    for group in by_length(words, len(letters)):
        for kind, first, hashes, distinct in neighbourhood(_points(group), letters):
            at = np.flatnonzero(distinct.ravel())
            h = hashes.ravel()[at]
            if known is not None:
                for j in range(PROBES):
                    place = _probes(h, j, len(known) * 8)
                    yes = (known[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                    at, h = at[yes], h[yes]
            w, i, c = np.unravel_index(at, hashes.shape)
            for w_, i_, c_ in zip(w.tolist(), (i + first).tolist(), c.tolist(), strict=True):
                word = group[w_]
                yield word, word[:i_] + ("" if kind == "delete" else alphabet[c_]) + word[i_ + (kind != "insert") :]


def vocabulary_filter(words: DataFrame, count: int) -> np.ndarray:
    """Packed bits of all words, of a bounded size; built in tasks, collected in pieces of PIECE bits."""
    bits = LEAST_BITS
    while bits < min(count * BITS_A_WORD, MOST_BITS):
        bits *= 2

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = word_hashes(pdf["word"].tolist())
            yield pd.DataFrame({"place": np.unique(np.concatenate([_probes(h, j, bits) for j in range(PROBES)]))})

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(PIECE, dtype=np.uint8)
        on[pdf["place"].to_numpy() % PIECE] = 1
        return pd.DataFrame({"piece": [int(pdf["place"].iloc[0]) // PIECE], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    placed = words.select("word").mapInPandas(frugal(places), "place long")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in placed.groupBy(F.floor(F.col("place") / PIECE)).applyInPandas(piece, "piece long, bits binary").collect():
        out[row["piece"] * PIECE // 8 :][: PIECE // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """word, near, n: every pair of words of the vocabulary (word, n) at one edit, both ways, n that of `near`."""
    spark = words.sparkSession
    count = words.count()
    known = spark.sparkContext.broadcast(vocabulary_filter(words, count))
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect()))  # of the class of RUN, so it is bounded

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for row in neighbours(pdf["word"].tolist(), alphabet, known.value):
                rows.append(row)
                size += len(row[0]) + 16
                if size > 1 << 20:
                    yield pd.DataFrame(rows, columns=["word", "near"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["word", "near"])

    dealt = words.select("word").repartition(max(1, -(-count // WORDS_A_TASK)), "word")
    made = dealt.mapInPandas(frugal(candidates), "word string, near string")
    return made.join(words.select(F.col("word").alias("near"), "n"), "near").select("word", "near", "n")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n)."""
    words = written(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").withColumn("frequent", F.coalesce(-F.col("best.m") >= factor * F.col("n"), F.lit(False)))
    keep = lambda c: F.when(F.col("frequent"), c)
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), keep(F.col("best.near")).alias("form"), keep(-F.col("best.m")).alias("form_n"))
    formed = written(formed, "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form, by pointer jumping."""
    up = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = written(up.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all of `documents`."""
    return variants(counted_words(table(spark, sf_dir, "documents")))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 in DuckDB SQL: each byte joins the register, which then moves on eight bits."""
    bytes_ = f"list_transform(range(0, CAST(len(hex(encode({text}))) AS BIGINT), 2), lambda p: CAST('0x' || substr(hex(encode({text})), p + 1, 2) AS BIGINT))"
    steps = f"flatten(list_transform({bytes_}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(r, e) >> 1, CASE WHEN xor(r, e) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda r, e: {step}), 4294967295)"


def op12_sql() -> str:
    """The same rows in DuckDB SQL."""
    return f"""
    WITH RECURSIVE
    raw AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{RUN}]{{{LEAST},}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
    c AS (SELECT id, run, count(*) AS k, {crc32_sql("id || ':' || run")} AS h FROM raw GROUP BY id, run),
    words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
        SELECT k, CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM c)
      WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {TWICE}),
    cuts AS (SELECT DISTINCT word, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, CAST(unnest(range(length(word))) AS INT) AS i FROM words)),
    pairs AS (SELECT x.word, y.word AS near FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b WHERE x.word <> y.word AND length(x.word) = length(y.word)
      UNION SELECT cuts.word, w.word FROM cuts JOIN words w ON w.word = a || b
      UNION SELECT w.word, cuts.word FROM cuts JOIN words w ON w.word = a || b),
    best AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, encode(p.near))) AS near, max(w.n) AS m FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
    formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {FACTOR} * n THEN near END AS form, CASE WHEN m >= {FACTOR} * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
    up AS (SELECT word, word AS at FROM formed UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON f.word = up.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN up ON up.word = f.word JOIN formed g ON g.word = up.at AND g.form IS NULL"""
