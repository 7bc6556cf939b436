"""Whole queries and every stage of the pipeline against plain Python over the same rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm.common import table, written
from factloom.llm.mixing import root_weights
from factloom.llm.packing import tokenizer_path
from factloom.llm.toxicity import BITS, FEATURES, SIZES, THRESHOLD, _logistic, fit_toxicity, op10_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, k=400):
    return " ".join(f"w{''.join(chr(97 + int(d)) for d in str(rng.randrange(k)))}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Documents with near copies, recurring lines, and two classes of words."""
    rng = random.Random(11)
    notes = [words(rng, 9) for _ in range(4)]
    rows = []
    for i in range(150):
        toxic = i % 9 == 0
        text = words(rng, rng.randint(20, 80)) + ("" if not toxic else " vile awful hateful fools " + " ".join(rng.choices(["vile", "hateful", "awful"], k=6)))
        if i % 5 == 1:
            text += "\n" + notes[i % 4]
        if i % 10 == 3:
            text = rows[-1][1].replace(" ", " x ", 1)
        rows.append([i * 3 % 451, text, "en", f"s{i % 4 and i % 3}", len(text), toxic])
    return rows


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([r[:5] for r in corpus], SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[5])) for r in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


# toxicity


def slow_buckets(text):
    """The hashed cells of all n-grams of a text, by whole numbers."""
    points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in f" {text} "]
    factors, factor = [], 1
    for _ in range(max(SIZES)):
        factor = (factor * 0x85EBCA6B + 0x27D4EB2F) & 0xFFFFFFFF
        factors.append(factor | 1)
    out = set()
    for n in SIZES:
        for i in range(len(points) - n + 1):
            acc = sum(p * f for p, f in zip(points[i : i + n], factors, strict=False)) & 0xFFFFFFFF
            out.add((((acc ^ (acc >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - BITS))
    return out


def slow_model(learnt):
    """chosen buckets in order, their ratios, weights and the intercept; learnt: (doc_id, text, label)."""
    sets = {i: slow_buckets(t) for i, t, _ in learnt}
    n = Counter(y for *_, y in learnt)
    counts = [Counter(), Counter()]
    for i, _, y in learnt:
        counts[y].update(sets[i])
    rated = []
    for b in counts[0].keys() | counts[1].keys():
        p, q = counts[1][b] + 1, counts[0][b] + 1
        ratio = np.log(p / (n[1] + 2)) - np.log(q / (n[0] + 2))
        if counts[0][b] + counts[1][b] >= 3 and ratio:
            rated.append((-abs(ratio) / np.sqrt(1 / p + 1 / q), b, ratio))
    rated.sort()
    names = [b for _, b, _ in rated[:FEATURES]]
    ratios = np.array([r for *_, r in rated[:FEATURES]])
    place = {b: k for k, b in enumerate(names)}
    order = sorted(learnt)
    rows = np.array([k for k, (i, *_) in enumerate(order) for b in sets[i] if b in place])
    features = np.array([place[b] for i, *_ in order for b in sets[i] if b in place])
    w, b = _logistic(rows, features, ratios, np.array([y for *_, y in order], dtype=float), len(names), 1e-4)
    return place, w * ratios, b


def test_toxicity_matches_counted_grams(spark, corpus, folder):
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in corpus}
    place, weights, intercept = slow_model([(r[0], r[1], int(r[5])) for r in corpus if not held[r[0]]])
    model = fit_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    chosen = {int(b): int(model.chosen[b]) for b in np.flatnonzero(model.chosen >= 0)}
    ours = {b: model.weights[k] for b, k in chosen.items()}
    # among equally sure buckets at the end of the list either may be chosen, by the last digit of a float
    assert len(chosen) == len(place) and len(chosen.keys() & place.keys()) >= 0.99 * len(place)
    # which moves the weights of buckets that go with it a little
    off = np.abs([ours[b] - weights[place[b]] for b in chosen.keys() & place.keys()])
    assert (off <= 1e-3).mean() >= 0.98 and off.max() <= 0.2
    found = {r["doc_id"]: r for r in op10_toxicity(spark, folder).collect()}
    for r in corpus:
        logit = intercept + sum(weights[place[b]] for b in slow_buckets(r[1]) if b in place)
        score = 1 / (1 + np.exp(-logit))
        assert found[r[0]]["score"] == pytest.approx(score, abs=2e-3) and found[r[0]]["held_out"] == held[r[0]]
        assert found[r[0]]["predicted"] == int(found[r[0]]["score"] >= THRESHOLD)
    tested = [r for r in corpus if held[r[0]]]
    right = [found[r[0]]["predicted"] == int("hateful" in r[1]) for r in tested]  # copies carry the words, not the label
    assert sum(right) >= 0.9 * len(tested) and any(r[5] for r in tested)


# the pipeline


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def shingles(text, width=5):
    found = re.findall(r"[^ \t-\r]+", text.lower())
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))) if found else frozenset()


def test_every_stage_matches_plain_python(spark, corpus, folder):
    docs = table(spark, folder, "documents")
    before, columns, stages = {r[0]: r[1] for r in corpus}, docs.columns, dict(corpus_pipeline.STAGES)
    sources = {r[0]: r[3] for r in corpus}

    # toxicity: the documents under the threshold, whole
    docs = written(stages["toxicity"](spark, docs, folder), "one")
    scores = {r["doc_id"]: r["score"] for r in op10_toxicity(spark, folder).collect()}
    want = {i: t for i, t in before.items() if scores[i] < THRESHOLD}
    assert rows_of(docs) == want and docs.columns == columns and len(want) < len(before)

    # line dedup: a line of five words or more stays in the first document that has it
    docs, before = written(stages["line_dedup"](spark, docs, folder), "two"), want
    first = {}
    for i in sorted(before):
        for line in before[i].split("\n"):
            first.setdefault(line, i)
    notes = {line for t in before.values() for line in t.split("\n")[1:]}
    after = rows_of(docs)
    assert after.keys() == before.keys() and docs.columns == columns
    for i, text in before.items():
        kept = [line for line in text.split("\n") if line not in notes or first[line] == i]
        if after[i] != "\n".join(kept):  # near copies: stretches of twenty tokens that an earlier document has
            lost = len(" ".join(kept).split()) - len(after[i].split())
            assert lost >= 20 and any(" ".join(text.split()[5:25]) in " ".join(t.split()) for j, t in before.items() if j < i)
    lengths = {r["doc_id"]: r["n_chars"] for r in docs.collect()}
    assert all(lengths[i] == len(t) for i, t in after.items())

    # n-gram join: the smallest id of each component of links stays
    docs, before = written(stages["ngram_join"](spark, docs, folder), "three"), after
    sets = {i: shingles(t) for i, t in before.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert rows_of(docs) == {i: t for i, t in before.items() if root[i] == i} and docs.columns == columns

    # mixing: every row once, in an order where every source keeps its share of each prefix
    before = rows_of(docs)
    docs = written(stages["mixing"](spark, docs, folder), "four")
    assert rows_of(docs) == before and docs.columns == columns
    order = [r["doc_id"] for r in docs.collect()]
    sizes = Counter(sources[i] for i in before)
    weight = root_weights(docs)
    least = min((n - 16) / (weight[s] / sum(weight.values())) for s, n in sizes.items())  # while all sources last
    for n in range(1, int(least)):
        seen = Counter(sources[i] for i in order[:n])
        assert all(abs(seen[s] - n * weight[s] / sum(weight.values())) <= 32 for s in sizes), n

    # packing: whole texts, gapless, none over 1,024 tokens, and no two sequences that fit one
    found = stages["packing"](spark, docs, folder).collect()
    tokenizer, pieces, filled = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == before.keys()
    for i, text in before.items():
        tokens = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["piece"]):
            own = np.array(tokens[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(own)
            at += r["length"]
        assert at == len(tokens)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
