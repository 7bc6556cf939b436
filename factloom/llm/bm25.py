"""Exact top-k search: BM25 by block-max WAND over shards, merged with global statistics.

Documents are indexed where they are read, with no shuffle: each task cuts its documents into shards of
at most `POSTINGS` postings and writes a shard as one row of flat arrays. Within a shard documents
stand in order of the common term they use most, in blocks of `DOCS`, and every term, common or rare,
has the largest impact of each block that it occurs in.

Queries are evaluated in batches of those that share their commonest term. Rare terms are scored first,
by their postings. What a block's documents reach by these, and the query's block maxima of common terms,
bound what any document of the block can score. Blocks whose bound is under the query's threshold (a score
that k documents reach which the task has seen, in any of its shards) are never asked. Common terms are
dense rows: those that a batch uses are multiplied for the blocks that any of its queries asks, in single
precision with a bound of its error, and only documents that may be among the best are scored again in
double precision. Results are those of scoring every document.

Document frequencies, the number of documents and their mean length are counted over all documents
before any score, so scores don't depend on shards and the tasks' top k merge exactly. Queries are
never shuffled to shards: blocks of at most about `ASKED` terms are broadcast one after another and
each reads the written index.

Defined cases: null or blank texts match nothing and, as queries, give no rows; equal scores (to nine
digits) are ordered by doc_id; repeated rows are results each, and texts of one id are one query; null
ids can be results (they come last among equals) but not queries; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import bound_batches, drop_written, frugal, table, written

K1, B = 1.2, 0.75
K = 10
#: Postings and documents of a shard, at most (a longer document is a shard of its own).
POSTINGS = 1 << 21
MOST_DOCS = 1 << 13
DOCS = 64
#: A term in more than this share of a shard's documents is common.
COMMON = 0.06
#: Queries that are evaluated together, and terms of queries that are broadcast together.
TOGETHER = 256
ASKED = 2_000_000
#: Scores that differ by less may be equal.
CLOSE = 1e-9
#: The idf of a term in about a third of all documents.
SOME = 1.0
#: Documents that are scored again together.
AGAIN = 2_048
EVERY = 50

ARRAYS = {"ids": np.int64, "named": np.bool_, "lengths": np.int64, "terms": np.uint64, "df": np.int32, "docs": np.int32, "tf": np.int32}
SHARDS = "n long, length long, " + ", ".join(f"{name} binary" for name in ARRAYS)


def flat(ids: list[int | None], counts: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays of a shard; postings are sorted by term, then by place."""
    sizes = np.array([len(t) for t, _ in counts])
    term, tf = np.concatenate([t for t, _ in counts]), np.concatenate([n for _, n in counts])
    doc = np.repeat(np.arange(len(counts)), sizes)
    terms, which, df = np.unique(term, return_inverse=True, return_counts=True)
    common = np.flatnonzero(df > max(8, COMMON * len(counts)))
    # documents in order of their most used common term, the most common one first
    rank = np.full(len(terms), len(terms), dtype=np.int64)
    rank[common[np.argsort(-df[common], kind="stable")]] = np.arange(len(common))
    usual = np.where(rank[which] < len(terms), tf * len(terms) - rank[which], -1)
    best = np.lexsort((usual, doc))
    key = np.full(len(counts), len(terms))
    key[sizes > 0] = rank[which[best[np.cumsum(sizes)[sizes > 0] - 1]]]
    new = np.argsort(key, kind="stable")
    place = np.empty(len(counts), dtype=np.int64)
    place[new] = np.arange(len(counts))
    order = np.lexsort((place[doc], which))
    lengths = np.array([n.sum() for _, n in counts])
    named = np.array([x is not None for x in ids])
    found = {"ids": np.array([x or 0 for x in ids])[new], "named": named[new], "lengths": lengths[new], "terms": terms, "df": df, "docs": place[doc][order], "tf": tf[order]}
    return {name: np.ascontiguousarray(found[name], dtype=kind) for name, kind in ARRAYS.items()}


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Shard:
    """A shard as it is searched. Impacts are BM25 without the idf."""

    def __init__(self, arrays: dict[str, np.ndarray], mean: float):
        self.ids, self.named, self.terms, self.docs = (arrays[x] for x in ("ids", "named", "terms", "docs"))
        tf, df = arrays["tf"].astype(float), arrays["df"]
        self.impacts = tf * (K1 + 1) / (tf + K1 * (1 - B + B * arrays["lengths"][self.docs] / mean))
        self.df, self.first = df, np.cumsum(df) - df
        self.blocks = -(-len(self.ids) // DOCS)
        self.row = np.full(len(df), -1)
        common = np.flatnonzero(df > max(8, COMMON * len(self.ids)))
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * DOCS))
        for r, t in enumerate(common):
            span = slice(self.first[t], self.first[t] + df[t])
            self.dense[r, self.docs[span]] = self.impacts[span]
        self.single = self.dense.astype(np.float32)
        self.most = self.dense.reshape(len(common), self.blocks, DOCS).max(axis=2)
        self.scored = self.possible = 0  # blocks

    def scores(self, start: np.ndarray, terms: np.ndarray, idf: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some queries, those documents that may be among the best: query, document and score, by query.

        start: where the terms of each query begin, and the end of the last. best: of each query the k
        best scores so far, in any order.
        """
        n, k = best.shape
        width = self.blocks * DOCS
        owner = np.repeat(np.arange(n), np.diff(start))
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        at, owner, idf = at[here], owner[here], idf[here]
        row = self.row[at]
        common = row >= 0
        used, column = np.unique(row[common], return_inverse=True)
        weights = np.zeros((n, len(used)))
        weights[owner[common], column] = idf[common]

        # the share of rare terms in all scores, a query at a time: its documents fit the processor's cache
        score = np.zeros((n, width))
        rare, worth = at[~common], idf[~common]
        first, size = self.first[rare], self.df[rare].astype(np.int64)
        edges = np.searchsorted(owner[~common], np.arange(n + 1))
        for q in range(n):
            own = slice(edges[q], edges[q + 1])
            posting = spread(first[own], size[own])
            score[q] = np.bincount(self.docs[posting], weights=np.repeat(worth[own], size[own]) * self.impacts[posting], minlength=width)

        def least(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of each block the most of score, and a score that the k best reach; score holds no more than documents have."""
            top = score.reshape(n, self.blocks, DOCS).max(axis=2)
            return top, np.partition(np.concatenate([best, top], axis=1), self.blocks, axis=1)[:, self.blocks]

        top, reached = least(score)
        bound = (top + weights @ self.most[used]) * (1 + 1e-12)
        live = (bound >= reached[:, None] - CLOSE) & (bound > 0)
        self.scored, self.possible = self.scored + int(live.sum()), self.possible + live.size
        # common terms in single precision, all of no sign, so that a sum's error is a share of it; what may be among the best is scored again
        near, rows, single = score.copy(), self.single[used], weights.astype(np.float32)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], live.any(axis=0), [False]]).view(np.int8))) * DOCS
        off = np.zeros(n)
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            part = single @ rows[:, a:b]
            near[:, a:b] += part
            off = np.maximum(off, part.max(axis=1))
        off *= (len(used) + 8) * 2.0**-23
        near -= off[:, None]
        _, reached = least(near)
        query, doc = np.nonzero((near >= (reached - 2 * off - CLOSE)[:, None]) & np.repeat(live, DOCS, axis=1))
        found, held = score[query, doc], np.searchsorted(owner[common], np.arange(n + 1))
        for a in range(0, len(query), AGAIN):
            own = slice(a, a + AGAIN)
            many = held[query[own] + 1] - held[query[own]]
            term = spread(held[query[own]], many)
            pair = np.repeat(np.arange(len(many)), many)
            found[own] += np.bincount(pair, weights=idf[common][term] * self.dense[row[common][term], doc[own][pair]], minlength=len(many))
        keep = (found > 0) & (found >= best.min(axis=1)[query] - CLOSE)
        return query[keep], doc[keep], found[keep]


class Asked:
    """A block of queries, and the best documents of each so far."""

    def __init__(self, queries: list[int], terms: list[np.ndarray], idf: list[np.ndarray], k: int):
        self.queries, self.k = np.array(queries, dtype=np.int64), k
        self.start = np.cumsum([0, *(len(t) for t in terms)])
        self.terms = np.concatenate([np.empty(0, dtype=np.int64), *terms]).view(np.uint64)
        self.idf = np.concatenate([np.empty(0), *idf])
        self.score = np.zeros((len(queries), k))
        self.ids, self.named = np.zeros((len(queries), k), dtype=np.int64), np.zeros((len(queries), k), dtype=bool)

    def ask(self, shard: Shard) -> None:
        for a in range(0, len(self.queries), TOGETHER):
            b = min(a + TOGETHER, len(self.queries))
            span = slice(self.start[a], self.start[b])
            row, doc, score = shard.scores(self.start[a : b + 1] - self.start[a], self.terms[span], self.idf[span], self.score[a:b])
            edges = np.searchsorted(row, np.arange(b - a + 1))
            for q in np.flatnonzero(np.diff(edges)):
                these = slice(edges[q], edges[q + 1])
                found = doc[these]
                old = self.score[a + q] > 0
                s = np.concatenate([self.score[a + q, old], np.round(score[these], 9)])
                ids = np.concatenate([self.ids[a + q, old], shard.ids[found]])
                named = np.concatenate([self.named[a + q, old], shard.named[found]])
                keep = np.lexsort((ids, ~named, -s))[: self.k]  # equal scores: the smallest ids
                for held, now in ((self.score, s), (self.ids, ids), (self.named, named)):
                    held[a + q, : len(keep)] = now[keep]

    def found(self) -> pa.RecordBatch:
        """A row for each query with any: query_id and best, a list of (-score, without id, doc_id)."""
        row, place = np.nonzero(self.score > 0)
        named = self.named[row, place]
        fields = [pa.array(-self.score[row, place]), pa.array(~named), pa.array(self.ids[row, place], mask=~named)]
        some, first = np.unique(row, return_index=True)
        best = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["less", "nameless", "doc_id"]))
        return pa.RecordBatch.from_arrays([pa.array(self.queries[some]), best], names=["query_id", "best"])


def indexed(docs: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """The written index of docs (doc_id, text): a row for each shard."""

    @frugal
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, size = [], [], 0

        def shard() -> pa.RecordBatch:
            arrays = flat(ids, counts)
            columns = [pa.array([len(ids)]), pa.array([int(arrays["lengths"].sum())]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays.values())]
            return pa.RecordBatch.from_arrays(columns, names=["n", "length", *ARRAYS])

        for batch in batches:
            for doc_id, (term, tf) in zip(batch["doc_id"].to_pylist(), textops.term_counts(batch["text"].to_pylist()), strict=True):
                if ids and (size + len(term) > postings or len(ids) >= MOST_DOCS):
                    yield shard()
                    ids, counts, size = [], [], 0
                ids.append(doc_id)
                counts.append((term, tf.astype(np.int32)))
                size += len(term)
        if ids:
            yield shard()

    # a few shards to a row group, whatever their number: readers hold one at a time
    small = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
    return written(docs.mapInArrow(build, SHARDS), "index", **small)


def document_frequencies(index: DataFrame) -> DataFrame:
    """term, df over all documents."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df in zip(batch["terms"], batch["df"], strict=True):
                terms, df = np.frombuffer(terms.as_buffer(), dtype=np.int64), np.frombuffer(df.as_buffer(), dtype=np.int32)
                for a in range(0, len(terms), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + (1 << 16)]), pa.array(df[a : a + (1 << 16)].astype(np.int64))], names=["term", "df"])

    return index.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def search(docs: DataFrame, queries: DataFrame, k: int = K, postings: int = POSTINGS, asked_terms: int = ASKED) -> DataFrame:
    """query_id, rank, doc_id, score: the k best of docs (doc_id, text) for each of queries (query_id, text)."""
    bound_batches(docs.sparkSession)
    index = indexed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), postings)
    total = index.agg(F.sum("n").alias("n"), F.sum("length").alias("l")).first()
    n, mean = total["n"] or 0, max((total["l"] or 0) / max(1, total["n"] or 0), 1e-9)

    @frugal
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, (term, _) in zip(batch["query_id"].to_pylist(), textops.term_counts(batch["text"].to_pylist()), strict=True):
                if len(term):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), query)), pa.array(term.view(np.int64))], names=["query_id", "term"])

    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = asked.mapInArrow(words, "query_id long, term long").distinct()
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(document_frequencies(index), "term").select("query_id", "term", idf.alias("idf"))
    weighed = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"))
    weighed = written(weighed, "queries")
    terms = weighed.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = [found_by(index, weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, mean) for blocks in [max(1, -(-terms // asked_terms))] for i in range(blocks)]
    drop_written(index, weighed)
    best = reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "b.doc_id", (-F.col("b.less")).alias("score"))


def found_by(index: DataFrame, asked: DataFrame, k: int, mean: float) -> DataFrame:
    """query_id, best, written: for one block of queries (query_id, terms, idf) the k best of each task's shards, in a row."""
    block = asked.toArrow()  # about ASKED terms
    held = [block["query_id"].to_pylist(), *([np.asarray(x.values) for x in block[c]] for c in ("terms", "idf"))]
    # queries with the same commonest term, of those that most documents lack, stand together: they tend to ask the same blocks
    usual = [int(t[np.argmin(np.where(i < SOME, np.inf, i))]) for t, i in zip(*held[1:], strict=True)]
    order = sorted(range(len(usual)), key=usual.__getitem__)
    shared = index.sparkSession.sparkContext.broadcast([[x[i] for i in order] for x in held])

    @frugal
    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(*shared.value, k)
        for batch in batches:
            for i in range(batch.num_rows):
                if not batch["terms"][i].as_buffer().size:
                    continue
                asked.ask(Shard({name: np.frombuffer(batch[name][i].as_buffer(), dtype=kind) for name, kind in ARRAYS.items()}, mean))
        yield asked.found()

    found = written(index.select(*ARRAYS).mapInArrow(evaluate, "query_id long, best array<struct<less: double, nameless: boolean, doc_id: long>>"), "found")
    shared.destroy()
    return found


def op4_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 is a query, with its whole text, against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "text"))
