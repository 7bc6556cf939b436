"""The n-gram join and BM25 against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import bm25, ngram_join
from factloom.llm.bm25 import op4_bm25, search
from factloom.llm.graph import components
from factloom.llm.ngram_join import jaccard_components, one_of_each, op9_ngram_join


def shingles(text, width):
    words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, num, den):
    """Smallest id reachable; rows of one id are one vertex."""
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    some = [(i, s) for i, s in sets if i is not None and s]
    root = {i: i for i, _ in some}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in some:
        for b, y in some:
            if a < b and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((i, len(s), find(i) if i is not None and s else i) for i, s in sets), key=str)


@pytest.mark.parametrize(("width", "num", "den", "few", "block"), [(3, 9, 10, 64, 10**6), (3, 9, 10, 64, 1), (3, 9, 10, 2, 10**6), (5, 8, 10, 1, 700), (1, 5, 10, 2, 500)])
def test_components_match_brute_force(spark, docs, rows, width, num, den, few, block, monkeypatch):
    monkeypatch.setattr(ngram_join.links, "__defaults__", (few, block))
    found = jaccard_components(docs, width, num, den).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, width, num, den)


def test_a_large_group_of_near_copies_is_not_compared_unit_by_unit(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words, f"own{i}"])) for i in range(150)]
    rows += [(1000 + i, " ".join([*words[:30], *(f"x{i}y{k}" for k in range(11))])) for i in range(5)]
    met = []

    def counted(df, name, *args, **kwargs):
        out = written(df, name, *args, **kwargs)
        if name == "meet":
            met.append(out.count())
        return out

    written = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", counted)
    monkeypatch.setattr(ngram_join.links, "__defaults__", (4, 400))
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 9, 10).collect()
    assert sorted(tuple(r) for r in found) == sorted(brute(rows, 1, 9, 10))
    # about 15 units: every two of them would be over 100 meetings
    assert len(met) == 1 and met[0] <= 40


def test_common_shingles_rank_last_in_a_corpus_of_many_more_than_the_least_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELLS", 1 << 10)
    monkeypatch.setattr(ngram_join, "CHUNK", 1 << 10, raising=False)
    rows = [(i, " ".join([*(f"w{i}x{k}" for k in range(300)), *(f"common{k}" for k in range(20))])) for i in range(400)]
    classes = ngram_join.rarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 1)
    common = next(ngram_join.textops.shingle_sets([" ".join(f"common{k}" for k in range(20))], 1))
    for tokens in ngram_join.textops.shingle_sets([text for _, text in rows[:20]], 1):
        assert not np.isin(ngram_join.prefix(tokens, classes, 0, 9, 10), common).any()
    assert len(classes) >= 400 * 300 * 6 // 128


def test_query_is_the_contract(spark, sf, rows):
    found = op9_ngram_join(spark, sf)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 3, 9, 10)


def test_one_document_of_each_group_stays(docs, rows):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, n, c in brute(rows, 5, 8, 10) if i is not None and (n == 0 or c == i)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids) == Counter({**dict.fromkeys(want, 1), None: 2})


def test_empty_join(empty):
    assert jaccard_components(empty).collect() == []
    assert one_of_each(empty).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}, 500: 500, 501: 500}


def ranking(rows, every, k):
    def terms(text):
        return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    bags = [(r[0], Counter(terms(r[1]))) for r in rows]
    df = Counter(t for _, bag in bags for t in bag)
    mean = sum(sum(bag.values()) for _, bag in bags) / len(bags)
    queries = {}
    for i, bag in bags:
        if i is not None and i % every == 0 and bag:
            queries.setdefault(i, set()).update(bag)
    out = {}
    for q, asked in queries.items():
        scored = []
        for i, bag in bags:
            size = sum(bag.values())
            s = sum(
                math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * (bm25.K1 + 1) / (bag[t] + bm25.K1 * (1 - bm25.B + bm25.B * size / mean))
                for t in asked
                if t in bag
            )
            if s > 0:
                scored.append((-round(s, 6), math.inf if i is None else i))
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize(("postings", "asked_terms"), [(1, 10**6), (900, 300), (10**6, 10**6)])
def test_search_matches_scoring_everything(spark, docs, rows, postings, asked_terms):
    queries = docs.where("doc_id % 10 = 0").selectExpr("doc_id as query_id", "text")
    found = {}
    for r in search(docs, queries, 5, postings, asked_terms).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((-round(r["score"], 6), math.inf if r["doc_id"] is None else r["doc_id"]))
    want = ranking(rows, 10, 5)
    assert found.keys() == want.keys()
    for q in want:
        assert np.allclose([s for s, _ in found[q]], [s for s, _ in want[q]])
        # equal but for rounding in the sixth place
        assert found[q] == want[q] or sorted(x[1] for x in found[q]) == sorted(x[1] for x in want[q])


def test_blocks_under_the_threshold_are_skipped(monkeypatch):
    monkeypatch.setattr(bm25, "DOCS", 4)
    rng = np.random.default_rng(3)
    # 40 topics of 30 words, a word in every document, and words of one document only
    counts = []
    for i in range(2_000):
        words = np.unique(np.concatenate([rng.integers(0, 30, 12) + 30 * (i % 40) + 10, [1], [100_000 + i]]))
        counts.append((words.astype(np.uint64), rng.integers(1, 4, len(words))))
    shard = bm25.Shard(bm25.flat(list(range(2_000)), counts), 20.0)
    whole = np.zeros((2_000, 101_999 + 1))
    for i, (words, tf) in enumerate(counts):
        whole[i, words.astype(int)] = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * tf.sum() / 20.0))
    queries = [counts[i][0] for i in (5, 800, 1999)]
    idf = [np.where(q < 2, 0.01, np.where(q < 100_000, 3.0, 7.0)) for q in queries]
    asked = bm25.Asked([5, 800, 1999], [q.view(np.int64) for q in queries], idf, 5)
    asked.ask(shard)
    assert 0 < shard.scored < shard.possible / 3
    for k, q in enumerate(queries):
        scores = np.round(whole[:, q.astype(int)] @ idf[k], 9)
        want = np.lexsort((np.arange(2_000), -scores))[:5]
        assert asked.ids[k].tolist() == want.tolist()
        assert np.allclose(asked.score[k], scores[want])


def test_few_documents_are_scored_in_double_precision():
    rng = np.random.default_rng(4)
    # words of one language: no block can be skipped, and scores differ by less than single precision tells
    counts = [((np.flatnonzero(rng.random(300) < 0.3) + 1).astype(np.uint64), None) for _ in range(1_500)]
    counts = [(words, rng.integers(1, 4, len(words))) for words, _ in counts]
    counts += [(words, tf) for words, tf in counts[:20]]
    shard = bm25.Shard(bm25.flat(list(range(len(counts))), counts), 180.0)
    whole = np.zeros((len(counts), 301))
    for i, (words, tf) in enumerate(counts):
        whole[i, words.astype(int)] = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * tf.sum() / 180.0))
    terms = [counts[i][0] for i in range(0, 100, 5)]
    idf = [1 + 1e-7 * rng.random(len(t)) for t in terms]
    start = np.cumsum([0, *(len(t) for t in terms)])
    query, doc, score = shard.scores(start, np.concatenate(terms), np.concatenate(idf), np.zeros((len(terms), 5)))
    assert len(query) < 4 * 5 * len(terms)
    for q, t in enumerate(terms):
        want = whole[:, t.astype(int)] @ idf[q]
        found = dict(zip(shard.ids[doc[query == q]].tolist(), score[query == q].tolist(), strict=True))
        assert set(np.flatnonzero(want >= np.sort(want)[-5] - 1e-9).tolist()) <= found.keys()
        assert np.allclose([want[i] for i in found], list(found.values()), rtol=0, atol=1e-9)


def test_largest_id_is_an_id(spark):
    rows = [((1 << 63) - 1, "same words here"), (None, "same words here"), (50, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = search(docs, docs.where("doc_id = 50").selectExpr("doc_id as query_id", "text"))
    assert [(r["rank"], r["doc_id"]) for r in found.orderBy("rank").collect()] == [(1, 50), (2, (1 << 63) - 1), (3, None)]


def test_search_query(spark, sf, empty):
    found = op4_bm25(spark, sf)
    assert found.columns == ["query_id", "rank", "doc_id", "score"]
    assert all(r["query_id"] % 50 == 0 for r in found.collect())
    assert search(empty, empty.selectExpr("doc_id as query_id", "text")).collect() == []
