"""Held-out accuracy of the classifiers, defined results on odd input, and the pipeline's stages."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import quality, toxicity
from factloom.llm.common import BATCH_ROWS, bounded_sample, pack_arrays, shared_dir, tree_sum, written
from factloom.llm.line_dedup import dedup_lines
from factloom.llm.mixing import mixed
from factloom.llm.ngram_join import one_of_each
from factloom.llm.packing import in_order, packed_along, pieces
from factloom.llm.quality import fit_quality, op1_quality, pool, tokens
from factloom.llm.toxicity import BITS, ToxicityModel, _present, drop_toxic, fit_toxicity, op10_toxicity

SF = "/root/testdata/sf0.01"


def accuracy(spark, df, target):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = df.where("held_out").join(labels, "doc_id").select("predicted", target).collect()
    return np.mean([a == b for a, b in rows]), np.mean([b for _, b in rows])


def auc(scores, labels):
    """The share of pairs of both classes that are in order, ties by half."""
    ones, zeros = ([s for s, y in zip(scores, labels, strict=True) if y == k] for k in (1, 0))
    return np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])


@pytest.mark.parametrize(("query", "target", "least"), [(op1_quality, "quality", 0.95), (op10_toxicity, "toxic", 0.88)])
def test_held_out_accuracy(spark, query, target, least):
    df = query(spark, SF).cache()
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    right, share = accuracy(spark, df, target)
    assert right > max(share, 1 - share) + 0.01
    judged = df.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", target).collect()
    scores, truth = (np.array(x, dtype=float) for x in zip(*judged, strict=True))
    assert auc(scores, truth) >= least
    scores = np.clip(scores, 1e-12, 1 - 1e-12)
    assert -np.mean(truth * np.log(scores) + (1 - truth) * np.log(1 - scores)) < 0.3
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= (0.7 if target == "quality" else 0.3))


@pytest.mark.parametrize("query", [op1_quality, op10_toxicity])
def test_odd_rows_are_scored(spark, sf, rows, query):
    found = query(spark, sf).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False, False]


def test_labels_of_held_out_rows_are_never_read(spark, docs):
    ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect() if r["doc_id"] is not None]
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    used = {r["doc_id"] for r in bounded_sample(docs, labels, "toxic", 10_000).collect()}
    assert used == {i for i in ids if zlib.crc32(str(i).encode()) % 4 != 2}
    assert bounded_sample(docs, labels, "toxic", 7).select("doc_id").distinct().count() == 7
    twisted = labels.withColumn("quality", (labels["quality"] + (labels["doc_id"] % 1)).cast("int")).union(labels.limit(3).selectExpr("doc_id", "1 - quality", "1 - toxic"))
    assert bounded_sample(docs, twisted, "toxic", 10_000).count() < bounded_sample(docs, labels, "toxic", 10_000).count()


@pytest.mark.parametrize("fit", [fit_quality, fit_toxicity])
def test_without_labels_every_score_is_the_same(spark, docs, empty, fit):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(3, 1, 1), (None, 1, None)], none.schema)):
        model = fit(docs, labels)
        clashing = docs.selectExpr("*", "'kept' as label", "1 as score")
        found = model.score(clashing).collect()
        assert len({round(r["score"], 9) for r in found}) == 1 and found[0]["label"] == "kept"
    assert fit(empty, none).score(empty).collect() == []


def test_toxic_rows_are_dropped(spark, docs):
    model = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    model.intercept = -3.0
    assert drop_toxic(docs, model).columns == docs.columns and drop_toxic(docs, model).count() == docs.count()
    model.intercept = 3.0
    assert drop_toxic(docs, model).count() == 0


def test_n_grams_stay_inside_documents():
    everything = np.arange(1 << toxicity.BITS, dtype=np.int32)
    texts = ["abcab", "", "xyz", "ABCAB"]
    found = [set() for _ in texts]
    total = Counter()
    for doc, feature in _present(texts, everything, 1 << toxicity.BITS):
        for d, f in zip(doc.tolist(), feature.tolist(), strict=True):
            found[d].add(f)
            total[d] += 1
    grams = lambda t: {f" {t} "[i : i + n] for n in toxicity.SIZES for i in range(len(t) + 3 - n)}
    assert [total[i] for i in range(4)] == [len(grams(t)) for t in texts]
    assert found[0] == found[3] and not found[0] & found[2]


def test_pooling_matches_token_by_token():
    random = np.random.default_rng(0)
    vectors = random.normal(size=(quality.WORDS, quality.WIDTH)).astype(np.float32)
    texts = ["one two, two!! three", "", "solo", "a a a b"]
    whole = pool(texts, vectors)
    assert not whole[1].any()
    for text, row in zip(texts, whole, strict=True):
        words, counts = tokens([text.encode()])
        assert counts.tolist() == [len(words)]
        if len(words):
            x = vectors[words]
            assert np.allclose(row[: quality.WIDTH], x.mean(axis=0), atol=1e-5)
            assert np.allclose(row[quality.WIDTH : 2 * quality.WIDTH], x.std(axis=0), atol=1e-3)
            again = sum(a == b for a, b in zip(words, words[1:]))
            assert np.isclose(row[-2], again / len(words))
    assert len(tokens([b"one two, two!! three"])[0]) == 6


def test_word_vectors_match_neighbour_by_neighbour(spark):
    texts = ["one two three", "two one, one", "", None, "alone", "a b a b ! a"] * 3 + ["three two one"]
    place, sign = quality.index_vectors()
    want = np.zeros((quality.WORDS, quality.WIDTH))
    for text in texts:
        words, _ = tokens([(text or "").encode()])
        for a, b in zip(words, words[1:]):
            for x, y in ((a, b), (b, a)):
                for k in range(quality.NONZERO):
                    want[x, place[y, k]] += sign[y, k]
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, length, out=np.zeros_like(want), where=length > 0)
    want -= want[length[:, 0] > 0].mean(axis=0)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-5)


def test_temperature_is_the_best_and_bounded_by_the_number_of_rows():
    random = np.random.default_rng(1)
    for noise in (0.0, 0.5, 2.0):
        x = random.normal(size=(300, 4))
        y = (x[:, 0] + noise * random.normal(size=300) > 0).astype(float)
        (center, scale, w1, b1, w2, b2), found = quality.train(x, y)
        rest = np.random.default_rng(quality.SEED).permutation(300)[:60]
        logits = np.tanh((x[rest] - center) / scale @ w1 + b1) @ w2 + b2
        ones = int(y[rest].sum())

        def loss(t):
            p = 1 / (1 + np.exp(-logits / t))
            q = [(ones + 1) / (ones + 2) if label else 1 / (60 - ones + 2) for label in y[rest]]
            return -sum(a * np.log(b) + (1 - a) * np.log(1 - b) for a, b in zip(q, p, strict=True))

        assert all(loss(found) <= loss(t) + 1e-6 for t in np.exp(np.linspace(-2, 3, 101)))
        if not noise:  # told apart without error: no row is certain beyond what 60 rows can show
            assert np.median(np.abs(logits / found)) < 2 * np.log(61)


def test_word_vectors_alone_tell_quality(spark):
    vectors = quality.word_vectors(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").orderBy("doc_id").select("doc_id", "text", "quality").collect()
    x = pool([r["text"] for r in rows], vectors).astype(float)
    x[:, 2 * quality.WIDTH :] = 0
    y = np.array([r["quality"] for r in rows], dtype=float)
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows])
    model = quality.QualityModel(vectors, *quality.train(x[~held], y[~held]))
    assert auc(model.logits(x[held]), y[held]) >= 0.9


def test_tree_sum(spark):
    import pandas as pd  # noqa: F401
    from pyspark import TaskContext

    def arrays(batches):
        total = np.zeros(10, dtype=np.int64)
        for pdf in batches:
            for x in pdf["id"]:
                total[x % 10] += x
        yield pack_arrays(TaskContext.get().partitionId(), total, 3)

    df = spark.range(0, 1000, 1, 30).mapInPandas(arrays, "part int, chunk int, data binary")
    assert tree_sum(df, (10,), "int64", 3, fan_in=4).tolist() == [sum(range(k, 1000, 10)) for k in range(10)]


def test_tree_sum_of_unsigned_counts_stops_at_the_largest(spark):
    def arrays(batches):
        for _ in batches:
            pass
        yield pack_arrays(TaskContext.get().partitionId(), np.array([60_000, 3], dtype=np.uint16), 1)

    from pyspark import TaskContext

    parts = spark.range(0, 6, 1, 6).mapInPandas(arrays, "part int, chunk int, data binary")
    assert tree_sum(parts, (2,), "uint16", 1, fan_in=2).tolist() == [65_535, 18]


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stages(spark, docs, sf, rows):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    extra = docs.selectExpr("*", "'x' as label", "1 as slot", "2 as token", "3 as row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, sf).columns == extra.columns
    assert corpus_pipeline.STAGES[-1][1](spark, extra, sf).select("doc_id", "sequence_id").count() >= len(rows)


def test_pipeline_runs_whole(spark, sf, rows):
    found = corpus_pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in found if r["piece"] == 0 and r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) <= {r[0] for r in rows}
    by_text = {}
    for i, text, *_ in rows:
        by_text.setdefault(text, set()).add(i)
    for text, own in by_text.items():
        if text and len(text.split()) >= 5 and "\n" not in text:
            assert len(own & set(ids)) <= 1, text[:50]


def test_pipeline_on_an_empty_table(spark, empty, sf):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []


def test_sequences_follow_the_mix(spark):
    # a hot source with the small ids: by weight a third of each prefix while the others last
    sources = ["hot"] * 4000 + ["a"] * 400 + ["b"] * 400
    rows = [(i, f"document number {i} " * 12, "en", s, 1) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(7)
    weights = {"hot": 1, "a": 1, "b": 1}
    found = packed_along(written(mixed(docs, weights), "mix"), stretch=64)
    found = sorted((r["sequence_id"], r["offset"], r["doc_id"], r["length"]) for r in found.collect())
    assert sorted(r[2] for r in found) == [*range(len(rows))]
    filled = Counter()
    for sequence, offset, _, length in found:
        assert offset == filled[sequence]
        filled[sequence] += length
    assert max(filled.values()) <= 1024
    # the others last for 1,200 documents: a stretch and a block of each source are off at most
    for n in range(150, 1200, 50):
        seen = Counter(sources[r[2]] for r in found[:n])
        assert all(abs(seen[s] - n / 3) <= 64 + 16 for s in weights), (n, seen)
    assert {sources[r[2]] for r in found[1400:]} == {"hot"}


def test_what_stretches_leave_over_is_packed_with_their_neighbours(spark):
    """Four documents of a third of a sequence leave one over; stretches packed for themselves only gave 60 sequences."""
    rows = [(i, " ".join(["word"] * 330)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    found = sorted(packed_along(written(docs, "thirds"), stretch=4).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert sorted(r["doc_id"] for r in found) == [*range(120)] and {r["length"] for r in found} == {331}
    filled, first = Counter(), {}
    for r in found:
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
        first.setdefault(r["sequence_id"], r["item"])
    assert max(filled.values()) <= 1024 and len(filled) <= 42
    assert all(i == item for i, item in first.items()) and [i for i in first] == sorted(first)
    places = [r["doc_id"] for r in found]
    assert max(abs(i - place) for i, place in enumerate(places)) <= 4 * 8


def test_packing_reads_the_order_as_written(spark, docs):
    table = written(docs.orderBy("text", "doc_id"), "sorted")
    ids = [r["doc_id"] for r in in_order(table).orderBy("position").collect()]
    assert ids == [r["doc_id"] for r in docs.orderBy("text", "doc_id").collect()]
    # a plan that isn't a table keeps the order of its own rows, not that of the files below
    turned = [r["doc_id"] for r in in_order(table.orderBy(F.desc("doc_id"))).orderBy("position").collect()]
    assert turned == [r["doc_id"] for r in table.orderBy(F.desc("doc_id")).collect()]


def test_sample_is_bounded_whatever_the_ids(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(3, "a"), (3, "a"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (4, 1), (5, 0), (6, 0), (6, 1), (None, 1)], "doc_id long, toxic int")
    rows = bounded_sample(docs, labels, "toxic", 2).collect()
    assert len(rows) <= 2 and len({r["doc_id"] for r in rows}) == len(rows)
    rows = {r["doc_id"]: (r["text"], r["label"]) for r in bounded_sample(docs, labels, "toxic", 100).collect()}
    learnt = {i for i in (1, 3, 4) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert rows.keys() == learnt and all(rows[i] == {3: ("a", 0), 4: ("", 1)}[i] for i in learnt - {1})


def test_toxic_rows_go_with_any_columns(spark):
    model = ToxicityModel(np.full(1 << BITS, -1, dtype=np.int32), np.empty(0), -3.0)
    docs = spark.createDataFrame([(1, "x", "mine", 9.0), (2, None, None, None)], "doc_id long, text string, _toxicity string, score double")
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    assert drop_toxic(docs, model, threshold=0.01).collect() == []


def test_ratios_are_those_of_counted_grams(spark):
    """Every chosen bucket's log-count ratio, by counting the documents of each class that hold its grams."""
    texts = [("you vile fool", 1), ("vile words here", 1), ("a kind word", 0), ("words of a friend", 0), ("kind friend", 0)]
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][: 3 * len(texts)]
    rows = [(i, *texts[k % len(texts)]) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    scores = model.scores([t for t, _ in texts])
    assert all((s > 0.5) == bool(y) for s, (_, y) in zip(scores, texts, strict=True))
    assert (model.chosen >= 0).sum() == len(model.weights) > 0
    # one gram of one class only pushes its way, through the sign of its ratio and a positive weight
    for gram, sign in (("vile", 1), ("kind", -1)):
        held = [k for k, (t, _) in enumerate(texts) if gram in t]
        assert all(np.sign(np.log(scores[k] / (1 - scores[k]))) == sign for k in held)


@pytest.mark.parametrize("stage", [dedup_lines, one_of_each, pieces])
def test_a_stage_that_runs_alone_bounds_its_batches(spark, docs, stage):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        stage(docs.limit(20))
        assert int(spark.conf.get(key)) <= BATCH_ROWS
    finally:
        spark.conf.set(key, before)
