"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows (`bound`, below). N-grams of 3 to 7 characters are
hashed; of each bucket it counts in how many toxic and other documents it occurs, and takes the log
ratio r of the smoothed shares. The buckets whose ratio is surest (largest z-score) are kept. Each
document then has the feature r for every kept bucket that occurs in it, and logistic regression
with an L2 penalty sets the weights. The model is a table of fixed size, broadcast to score all
documents; scoring needs no shuffle.

Defined cases: null texts count as empty and get the probability that the intercept gives; an empty
`documents` gives an empty result; without labels of both classes every score is the smoothed share
of toxic labels; a null doc_id is scored and counts as not held out; repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARRAYS, bounded_sample, drop_written, frugal, held_out, pack_arrays, table, tree_sum, written

BITS = 21
SIZES = (3, 4, 5, 6, 7)
#: Labelled rows that a model is fitted on, at most.
BOUND = 12_000
FEATURES = 4_000
THRESHOLD = 0.3
CHUNKS = 16
#: Tasks that count n-grams of the labelled rows, at most.
FIT_TASKS = 12
_GROUP = 1 << 18


def _lowered(texts: list[str | None]):
    """Groups of documents as code points with A-Z lowered: (first document, code points, bounds)."""
    start, size, group = 0, 0, []
    for i, text in enumerate([*texts, None]):
        text = f" {text or ''} " if i < len(texts) else ""
        if group and (i == len(texts) or size + len(text) > _GROUP):
            points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
            points[(points >= 65) & (points <= 90)] += 32
            yield start, points, np.cumsum([len(x) for x in group])
            start, size, group = i, 0, []
        group.append(text)
        size += len(text)


def _hits(points: np.ndarray, bounds: np.ndarray, chosen: np.ndarray):
    """For each n-gram that stands inside one document and whose bucket is chosen: document and chosen[bucket]."""
    acc = np.zeros(len(points), dtype=np.uint32)
    odd = np.uint32(0x9E3779B1)
    factor = 1
    for n in range(1, max(SIZES) + 1):
        factor = factor * 0x85EBCA6B + 0x27D4EB2F & 0xFFFFFFFF
        usable = len(points) - n + 1
        if usable <= 0:
            return
        acc = acc[:usable] + points[n - 1 :] * np.uint32(factor | 1)
        if n not in SIZES:
            continue
        feature = chosen[((acc ^ (acc >> np.uint32(15))) * odd) >> np.uint32(32 - BITS)]
        at = np.flatnonzero(feature >= 0)
        doc = np.searchsorted(bounds, at, "right")
        inside = at + n <= bounds[doc]
        yield doc[inside], feature[at[inside]]


def _present(texts: list[str | None], chosen: np.ndarray, n_features: int):
    """(document, feature) pairs of a list of texts, a group and a size at a time, each once.

    Documents are in order within what is yielded.
    """
    seen = np.empty(n_features, dtype=np.int32)
    for start, points, bounds in _lowered(texts):
        for doc, feature in _hits(points, bounds, chosen):
            # the last place that a document writes into a feature's cell is the one that counts
            at = np.arange(len(doc), dtype=np.int32)
            once = np.empty(len(doc), dtype=bool)
            edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                seen[feature[a:b]] = at[a:b]
                once[a:b] = seen[feature[a:b]] == at[a:b]
            yield start + doc[once], feature[once]


@dataclass
class ToxicityModel:
    chosen: np.ndarray  # bucket to feature, -1 for none
    weights: np.ndarray  # of each feature, its log ratio included
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        logits = np.full(len(texts), self.intercept)
        if len(self.weights):
            for doc, feature in _present(texts, self.chosen, len(self.weights)):
                logits += np.bincount(doc, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """docs with the column `out`, which replaces one of that name."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        @frugal
        def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(shared.value.scores(texts.tolist()))

        return docs.withColumn(out, toxic(F.coalesce(F.col(text), F.lit(""))))


def _logistic(rows: np.ndarray, features: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, penalty: float, steps: int = 250):
    """Full-batch Adam on a sparse design."""
    w, b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, t = np.zeros(n + 1), np.zeros(n + 1), 0
    x = values[features]
    for t in range(1, steps + 1):
        logits = np.bincount(rows, weights=x * w[features], minlength=len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - y) / len(y)
        grad = np.append(np.bincount(features, weights=x * error[rows], minlength=n) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND, n_features: int = FEATURES, penalty: float = 1e-4) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic. Held-out rows are never read."""
    sample = written(bounded_sample(docs, labels, "toxic", bound), "toxic-sample")
    buckets = 1 << BITS

    @frugal
    def counts(batches):
        total, everything = np.zeros((2, buckets), dtype=np.int32), np.arange(buckets, dtype=np.int32)
        for pdf in batches:
            label = pdf["label"].to_numpy()
            for doc, bucket in _present(pdf["text"].tolist(), everything, buckets):
                for k in (0, 1):
                    cells, n = np.unique(bucket[label[doc] == k], return_counts=True)
                    total[k, cells] += n.astype(np.int32)
        yield pack_arrays(TaskContext.get().partitionId(), total, CHUNKS)

    # a task's counts are a table of a fixed size, so a bounded sample is counted in few tasks
    counted = tree_sum(sample.coalesce(FIT_TASKS).mapInPandas(counts, ARRAYS), (2, buckets), "int32", CHUNKS).astype(float)
    sizes = dict(sample.groupBy("label").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    chosen = np.full(buckets, -1, dtype=np.int32)
    if not n0 or not n1:
        drop_written(sample)
        return ToxicityModel(chosen, np.empty(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    p, q = counted[1] + 1, counted[0] + 1
    ratio = np.log(p / (n1 + 2)) - np.log(q / (n0 + 2))
    sure = np.where(counted.sum(axis=0) >= 3, np.abs(ratio) / np.sqrt(1 / p + 1 / q), 0)
    best = np.lexsort((np.arange(buckets), -sure))[:n_features]
    best = best[sure[best] > 0]
    chosen[best] = np.arange(len(best))
    ratio = ratio[best]
    shared = sample.sparkSession.sparkContext.broadcast(chosen)

    @frugal
    def featured(batches):
        for pdf in batches:
            lists: list[list[np.ndarray]] = [[] for _ in range(len(pdf))]
            for doc, feature in _present(pdf["text"].tolist(), shared.value, len(best)):
                ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
                for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    lists[doc[a]].append(feature[a:b])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "features": [np.concatenate(x or [np.empty(0, dtype=np.int64)]).astype(np.int32).tobytes() for x in lists]})

    # bounded by `bound` rows of n_features small integers
    pdf = sample.mapInPandas(featured, "doc_id long, label int, features binary").toPandas().sort_values(["doc_id", "features"])
    drop_written(sample)
    sets = [np.frombuffer(x, dtype=np.int32) for x in pdf["features"]]
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    features = np.concatenate(sets) if sets else np.empty(0, dtype=np.int32)
    w, b = _logistic(rows, features, ratio, pdf["label"].to_numpy().astype(float), len(best), penalty)
    return ToxicityModel(chosen, w * ratio, float(b))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, with the columns of docs, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    return model.score(rows).where(F.col("score") < threshold).select("row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
