"""Quality classifier on random-indexing word vectors (operator 3).

1. Every word falls into one of ``WORDS`` places by its hash, and every place
   has a fixed sparse index vector of +1 and -1. A word's context vector is the
   sum of the index vectors of its neighbours within ``WINDOW`` words, over all
   texts of the corpus. Each task adds up its own table, whose size does not
   depend on the data; the tables are added by place.
2. A word vector is the context vector scaled to length one beside the word's
   own index vector. A text is pooled into the mean and the spread of its word
   vectors, rare words weighing more, its length, and its shares of new and of doubled words.
3. A network of two layers learns from at most about ``SAMPLE`` labelled texts
   (those with the smallest hash of the id; all if there are fewer). A fifth of
   them is kept back to fit one temperature, which calibrates the probability.

Null and empty texts pool to zeros and get a score like any other. If both
labels are not there to learn, every score is the share of label 1, or one half
without any label. Labels without an id or a quality are left out; repeated
labels count once per id and quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from callmetrics.llm.common import id_bucket, small_batches, table
from callmetrics.llm.kernels import SPACE, mix, pieces, span_hashes, text_buffer, word_spans

WORDS = 1 << 13
DIMENSIONS = 32
NONZERO = 4
WINDOW = 2
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.3

POOLED = 4 * DIMENSIONS + 4


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each word's index vector."""
    seed = mix(np.arange(1, WORDS * NONZERO + 1, dtype=np.uint64)).reshape(WORDS, NONZERO)
    return (seed % np.uint64(DIMENSIONS)).astype(np.int64), np.where(seed >> np.uint64(63), 1, -1).astype(np.int64)


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, edges, ~SPACE[data])
    return (span_hashes(data, starts, ends) >> np.uint64(64 - 13)).astype(np.int64), rows


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    sums, seen = np.zeros(WORDS * DIMENSIONS, np.int64), np.zeros(WORDS, np.int64)
    for batch in batches:
        for _, _, part, bounds in pieces(*text_buffer(batch.column(0))):
            words, rows = words_of(part, bounds)
            seen += np.bincount(words, minlength=WORDS)
            for apart in range(1, WINDOW + 1):
                same = rows[apart:] == rows[:-apart]
                left, right = words[:-apart][same], words[apart:][same]
                for k in range(NONZERO):
                    np.add.at(sums, left * DIMENSIONS + places[right, k], signs[right, k])
                    np.add.at(sums, right * DIMENSIONS + places[left, k], signs[left, k])
    used = np.flatnonzero(seen)
    table = sums.reshape(WORDS, DIMENSIONS)[used]
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(seen[used]), *[pa.array(table[:, d]) for d in range(DIMENSIONS)]],
        names=["word", "seen", *[f"d{d}" for d in range(DIMENSIONS)]],
    )


@dataclass
class Vectors:
    table: np.ndarray  # words x 2 dimensions
    weight: np.ndarray


def word_vectors(texts: DataFrame) -> Vectors:
    """Context and index vectors from all rows of (text)."""
    columns = ["seen", *[f"d{d}" for d in range(DIMENSIONS)]]
    sums = (
        small_batches(texts).select(F.lower("text").alias("text"))
        .mapInArrow(_contexts, ", ".join(f"{c} long" for c in ["word", *columns]))
        .groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])
    )
    seen, contexts = np.zeros(WORDS), np.zeros((WORDS, DIMENSIONS))
    for word, count, *row in sums.collect():  # at most WORDS rows
        seen[word], contexts[word] = count, row
    total = max(seen.sum(), 1)
    mean = contexts.sum(axis=0) / max(np.abs(contexts).sum(), 1)
    contexts = contexts / np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1e-9) - mean
    own = np.zeros((WORDS, DIMENSIONS))
    places, signs = index_vectors()
    for k in range(NONZERO):
        own[np.arange(WORDS), places[:, k]] += signs[:, k]
    weight = 1e-3 / (1e-3 + seen / total)
    return Vectors(np.hstack([contexts, own / 2]).astype(np.float32), weight.astype(np.float32))


def pooled(vectors: Vectors, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    out = np.zeros((len(edges) - 1, POOLED), np.float32)
    words, rows = words_of(data, edges)
    if not len(words):
        return out
    begin = np.flatnonzero(np.diff(rows, prepend=-1))
    owner, count = rows[begin], np.diff(np.append(begin, len(rows)))
    weight = vectors.weight[words][:, None]
    values = vectors.table[words]
    total = np.add.reduceat(weight, begin, axis=0)
    mean = np.add.reduceat(values * weight, begin, axis=0) / total
    spread = np.add.reduceat(values * values * weight, begin, axis=0) / total - mean * mean
    new = np.unique(rows * WORDS + words)
    kinds = np.bincount(new // WORDS, minlength=len(out))[owner]
    again = np.append(False, (words[1:] == words[:-1]) & (rows[1:] == rows[:-1]))
    repeats = np.add.reduceat(again.astype(np.float32), begin) / count
    out[owner] = np.hstack([
        mean, np.sqrt(np.maximum(spread, 0)),
        np.log1p(count)[:, None], (kinds / count)[:, None], repeats[:, None], total / count[:, None],
    ])
    return out


def _pooled_udf(spark: SparkSession, vectors: Vectors, finish=None):
    shared = spark.sparkContext.broadcast(vectors)  # of fixed size

    @F.arrow_udf(DoubleType() if finish else ArrayType(FloatType()))
    def pool(text: pa.Array) -> pa.Array:
        data, edges = text_buffer(text)
        parts = [pooled(shared.value, part, bounds) for _, _, part, bounds in pieces(data, edges)]
        rows = np.concatenate(parts) if parts else np.zeros((0, POOLED), np.float32)
        if finish:
            return pa.array(finish(rows), pa.float64())
        flat = pa.array(rows.ravel(), pa.float32())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * POOLED, pa.int32()), flat)

    return lambda text: pool(F.lower(text))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # weights and biases of both layers; empty: constant
    temperature: float
    constant: float = 0.5

    def logits(self, rows: np.ndarray) -> np.ndarray:
        first, first_bias, second, second_bias = self.layers
        hidden = np.maximum((rows - self.mean) / self.scale @ first + first_bias, 0)
        return hidden @ second[:, 0] + second_bias[0]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(rows), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(rows.astype(np.float64)) / self.temperature, -30, 30)))


def train(rows: np.ndarray, labels: np.ndarray, kept_back: np.ndarray, epochs: int = 40) -> Network:
    """Adam on the cross-entropy, then the temperature on the rows kept back."""
    if len(set(labels.tolist())) < 2:
        return Network(np.zeros(0), np.ones(0), [], 1.0, float(labels.mean()) if len(labels) else 0.5)
    fit, labels = ~kept_back, labels.astype(np.float64)
    if len(set(labels[fit].tolist())) < 2:
        fit = np.ones(len(labels), bool)
    mean, scale = rows[fit].mean(axis=0), rows[fit].std(axis=0) + 1e-6
    x, y = (rows[fit] - mean) / scale, labels[fit]
    rng = np.random.default_rng(3)
    net = Network(mean, scale, [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, 1)), np.zeros(1),
    ], 1.0)
    first = [np.zeros_like(w) for w in net.layers]
    second = [np.zeros_like(w) for w in net.layers]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            part = order[at:at + 256]
            hidden = np.maximum(x[part] @ net.layers[0] + net.layers[1], 0)
            guess = 1 / (1 + np.exp(-np.clip(hidden @ net.layers[2][:, 0] + net.layers[3][0], -30, 30)))
            error = ((guess - y[part]) / len(part))[:, None]
            back = (error @ net.layers[2].T) * (hidden > 0)
            grads = [x[part].T @ back + 1e-4 * net.layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * net.layers[2], error.sum(axis=0)]
            step += 1
            rate = 3e-3 * (1 - epoch / epochs)
            for w, g, m, v in zip(net.layers, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    held = kept_back if kept_back.any() else fit
    logits, target = net.logits(rows[held].astype(np.float64)), labels[held]
    choices = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
    losses = [np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in choices]
    net.temperature = float(choices[int(np.argmin(losses))])
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: Vectors, sample: int = SAMPLE, folds: tuple[int, int] | None = (5, 0)) -> Network:
    """Learn from (doc_id, text) and (doc_id, quality). ``folds`` = (n, k)
    leaves out the ids whose crc32 modulo n is k; None learns from all."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    if folds:
        known = known.where(id_bucket(F.col("doc_id"), folds[0]) != folds[1])
    count = known.count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    known = known.where(place < min(1.0, sample / max(count, 1))).dropDuplicates()
    pool = _pooled_udf(small_batches(docs).sparkSession, vectors)
    # About `sample` rows of two numbers, however many labels there are.
    taken = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "doc_id", "quality", pool(F.col("text")).alias("row")
    ).dropDuplicates(["doc_id", "quality"])
    found = sorted((tuple(r) for r in taken.collect()), key=lambda r: (r[0], r[1]))
    rows = np.array([r[2] for r in found], np.float32).reshape(-1, POOLED)
    ids = np.array([r[0] for r in found], np.int64)
    kept_back = mix(ids.view(np.uint64)) % np.uint64(5) == 0
    return train(rows, np.array([r[1] for r in found], np.int64), kept_back)


def with_quality(docs: DataFrame, vectors: Vectors, network: Network) -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of label 1."""
    score = _pooled_udf(small_batches(docs).sparkSession, vectors, network.scores)
    return docs.withColumn("score", score(F.col("text")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; see the module for the method."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = word_vectors(docs)
    network = fit(docs, table(spark, sf_dir, "labels"), vectors)
    return with_quality(docs, vectors, network).select(
        "doc_id", (F.coalesce(id_bucket(F.col("doc_id"), 5), F.lit(-1)) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
