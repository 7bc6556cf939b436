"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token (a run of letters and digits, or a run of other marks) falls into one of `WORDS` hashed
words. Each word has a sparse random index vector; its word vector is the sum of the index vectors
of the words next to it, over all documents. A document is the mean and the spread of its words'
vectors. A two-layer numpy network is trained on a bounded sample of labelled rows, and its
temperature is fitted on a fifth of them that the network hasn't seen, so scores are probabilities.
Labels are smoothed for that by the number of rows of their class, (n + 1)/(n + 2) and 1/(n + 2):
where few rows are told apart without error, plain labels would ask for ever more certain scores.

Both passes over texts are maps; what is added up is one table of fixed size. Defined cases: null
texts count as empty (a zero vector, scored as such); an empty `documents` gives an empty result;
without labels of both classes each score is the smoothed share of label 1; a null doc_id is scored
and counts as not held out; repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import ARRAYS, bounded_sample, frugal, held_out, pack_arrays, table, tree_sum

WORDS = 1 << 14
WIDTH = 32
NONZERO = 2
#: Labelled rows that the network is fitted on, at most.
BOUND = 12_000
#: Means, spreads, two measures of neighbours, size.
POOLED = 2 * WIDTH + 3
HIDDEN = 32
THRESHOLD = 0.7
CHUNKS = 16
SEED = 7
#: Classes of bytes: white space, letters and digits (all bytes from 0x80 too), other marks.
KINDS = np.full(256, 2, dtype=np.int8)
KINDS[textops.SPACES] = 0
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of some documents one after another, and how many each has."""
    buf = np.frombuffer(b"\n".join([*group, b""]), dtype=np.uint8)
    kind = KINDS[buf]
    cut = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    start = cut[kind[np.minimum(cut, len(kind) - 1)] != 0]
    start = start[start < len(kind)]
    ends = cut[np.searchsorted(cut, start, "right")] if len(start) else start
    words = (textops.range_hash(textops.prefix_hash(buf), start, ends) >> np.uint64(64 - 14)).astype(np.int64)
    bounds = np.cumsum([len(x) + 1 for x in group])
    return words, np.diff(np.searchsorted(start, bounds, "left"), prepend=0)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.integers(0, WIDTH, (WORDS, NONZERO)), random.choice([-1, 1], (WORDS, NONZERO)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One vector for each hashed word, from all documents."""

    @frugal
    def count(batches):
        place, sign = index_vectors()
        total = np.zeros(WORDS * WIDTH, dtype=np.int64)
        for pdf in batches:
            for _, group in textops.buffers(pdf["text"].tolist(), 1 << 20):
                words, counts = tokens(group)
                if len(words) < 2:
                    continue
                same = np.ones(len(words) - 1, dtype=bool)
                ends = np.cumsum(counts)
                same[ends[(ends > 0) & (ends < len(words))] - 1] = False
                left, right = words[:-1][same], words[1:][same]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * WIDTH + place[b, k], weights=sign[b, k], minlength=len(total)).astype(np.int64)
        yield pack_arrays(TaskContext.get().partitionId(), total, CHUNKS)

    summed = tree_sum(docs.select("text").mapInPandas(count, ARRAYS), (WORDS, WIDTH), "int64", CHUNKS).astype(np.float32)
    length = np.linalg.norm(summed, axis=1, keepdims=True)
    summed = np.divide(summed, length, out=np.zeros_like(summed), where=length > 0)
    return summed - summed[length[:, 0] > 0].mean(axis=0) if (length > 0).any() else summed


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, how alike neighbours are, log of the number of words."""
    out = np.zeros((len(texts), POOLED), dtype=np.float32)
    for first, group in textops.buffers(texts, 256 << 10):
        words, counts = tokens(group)
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        starts = (np.cumsum(counts) - counts)[some]
        x = vectors[words]
        n = counts[some, None]
        mean = np.add.reduceat(x, starts, axis=0) / n
        spread = np.sqrt(np.maximum(np.add.reduceat(x * x, starts, axis=0) / n - mean**2, 0))
        alike = np.einsum("ij,ij->i", x[1:], x[:-1])
        alike = np.append(alike * (words[1:] != words[:-1]), 0)
        again = np.append(words[1:] == words[:-1], False).astype(np.float32)
        last = starts + counts[some] - 1
        alike[last] = again[last] = 0
        near = np.stack([np.add.reduceat(alike, starts), np.add.reduceat(again, starts)], axis=1)
        out[first + some] = np.hstack([mean, spread, near / n, np.log1p(n)])
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...]  # center, scale, w1, b1, w2, b2
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        center, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - center) / scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pool(texts, self.vectors)) / self.temperature, -500, 500)))

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """docs with the column `out`, which replaces one of that name."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        @frugal
        def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(shared.value.scores(texts.tolist()).astype(float))

        return docs.withColumn(out, quality(F.coalesce(F.col(text), F.lit(""))))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3) -> tuple[tuple[np.ndarray, ...], float]:
    """The layers, trained on four fifths, and the temperature with the least log loss, labels smoothed, on the others."""
    random = np.random.default_rng(SEED)
    order = random.permutation(len(y))
    fit, rest = order[len(y) // 5 :], order[: len(y) // 5]
    center, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z = (x - center) / scale
    weights = [random.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(fit), max(1, len(fit) // 128)):
            h = np.tanh(z[batch] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -50, 50))) - y[batch]) / len(batch)
            back = error[:, None] * weights[2] * (1 - h**2)
            grads = [z[batch].T @ back + decay * weights[0], back.sum(axis=0), h.T @ error + decay * weights[2], error.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g**2
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    layers = (center, scale, *weights[:3], weights[3])
    logits = np.tanh(z[rest] @ weights[0] + weights[1]) @ weights[2] + weights[3]

    ones = y[rest].sum()
    smooth = np.where(y[rest] == 1, (ones + 1) / (ones + 2), 1 / (len(rest) - ones + 2))

    def loss(temperature: float) -> float:
        s = np.clip(logits / temperature, -50, 50)
        return float(np.mean(np.log1p(np.exp(s)) - smooth * s))

    return layers, min(np.exp(np.linspace(-2, 3, 101)), key=loss) if len(rest) else 1.0


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> QualityModel:
    """docs: doc_id, text; labels: doc_id, quality. Labels of held-out rows are never read."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @frugal
    def pooled(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [v.tobytes() for v in pool(pdf["text"].tolist(), shared.value)]})

    # bounded by `bound` rows of one small vector
    pdf = bounded_sample(docs, labels, "quality", bound).mapInPandas(pooled, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    y = pdf["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        flat = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        n = POOLED
        return QualityModel(vectors, (np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), np.array([flat])), 1.0)
    x = np.stack([np.frombuffer(v, dtype=np.float32) for v in pdf["x"]]).astype(float)
    layers, temperature = train(x, y)
    return QualityModel(vectors, layers, float(temperature))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
