"""Language identification by string kernels (operator 5).

The kernel of two texts is the blended-spectrum presence kernel: the number of
byte n-grams of length 1 to ``MAX_GRAM`` that both hold, of the lower-case
texts, over the root of the product of their own numbers. N-grams are told
apart by a hash into ``FEATURES`` places.

Training: ``SAMPLE`` labelled texts (about as many per language, those with the
smallest hash of the id), of which ``LANDMARKS`` serve as Nystroem landmarks.
With the landmarks' kernel matrix to the power -1/2 every text becomes a short
vector; kernel ridge regression is solved for each language against the rest.

Scoring: the prediction is linear in a text's presence vector, so landmarks and
coefficients fold into one matrix of n-grams by languages, and a batch of
presence vectors is scored by one matrix product. This is exact.

A null text, or one without a letter, is ``und`` with score 0, and so is every
text if there was nothing to learn from. Rows without an id or a language are
never learned from. Ties go to the language that sorts first. Repeated rows are
treated alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from callmetrics.llm.common import fresh, id_bucket, small_batches, table
from callmetrics.llm.kernels import pieces, text_buffer

MAX_GRAM = 4
FEATURES = 1 << 16
SAMPLE = 2048
LANDMARKS = 128
RIDGE = 1e-4
BLOCK = 32
UNDETERMINED = "und"
MIN_SCORE = 0.25
LETTER = r"\p{L}"

_SHIFT = np.uint32(32 - 16)


def presence(data: np.ndarray, edges: np.ndarray, out: np.ndarray) -> None:
    """Mark in ``out`` (rows by features) the n-grams that each row holds."""
    packed = np.zeros(len(data), np.uint32)
    for size in range(1, MAX_GRAM + 1):
        if len(data) < size:
            return
        packed = (packed[:len(data) - size + 1] << np.uint32(8)) | data[size - 1:]
        places = ((packed + np.uint32(size)) * np.uint32(0x9E3779B1) ^ (packed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> _SHIFT
        for row in range(len(edges) - 1):
            low, high = edges[row], edges[row + 1] - size + 1
            if high > low:
                out[row, places[low:high]] = 1


@F.arrow_udf(BinaryType())
def _packed(text: pa.Array) -> pa.Array:
    data, edges = text_buffer(text)
    rows = []
    for first, stop, part, bounds in pieces(data, edges):
        for at in range(0, stop - first, BLOCK):
            some = bounds[at:at + BLOCK + 1]
            marks = np.zeros((len(some) - 1, FEATURES), np.uint8)
            presence(part[some[0]:some[-1]], some - some[0], marks)
            rows += [r.tobytes() for r in np.packbits(marks, axis=1)]
    return pa.array(rows, pa.binary())


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    bias: np.ndarray


def _unpacked(rows: list[bytes]) -> np.ndarray:
    bits = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.unpackbits(bits, axis=1).astype(np.float32)


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, folds: tuple[int, int] | None = (3, 1)) -> Model:
    """Learn from (doc_id, text, lang). ``folds`` = (n, k) leaves out the ids
    whose crc32 modulo n is k; None learns from all."""
    rows = small_batches(docs).where("lang is not null and doc_id is not null")
    if folds:
        rows = rows.where(id_bucket(F.col("doc_id"), folds[0]) != folds[1])
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    share = -(-sample // len(languages))
    rate = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, share / counts[lang]))])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    taken = (
        rows.where(place < rate[F.col("lang")])
        .select("lang", place.alias("place"), _packed(F.lower("text")).alias("bits"))
    )
    found = sorted((tuple(r) for r in taken.collect()), key=lambda r: (r[1], r[0], r[2]))
    quota = {lang: -(-landmarks // len(languages)) for lang in languages}
    marks = []
    for number, (lang, _, _) in enumerate(found):
        if quota[lang]:
            quota[lang] -= 1
            marks.append(number)
    base = _unpacked([found[i][2] for i in marks])
    base /= np.sqrt(np.maximum(base.sum(axis=1, keepdims=True), 1))
    kernel = np.empty((len(found), len(marks)))
    for at in range(0, len(found), BLOCK):
        block = _unpacked([r[2] for r in found[at:at + BLOCK]])
        block /= np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1))
        kernel[at:at + BLOCK] = block @ base.T
    values, vectors = np.linalg.eigh(kernel[marks])
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])  # landmarks' kernel to the power -1/2
    mapped = kernel @ root
    target = np.array([[float(lang == r[0]) for lang in languages] for r in found])
    middle, level = mapped.mean(axis=0), target.mean(axis=0)
    centred = mapped - middle
    solved = np.linalg.solve(
        centred.T @ centred + RIDGE * len(found) * np.eye(centred.shape[1]), centred.T @ (target - level)
    )
    return Model(languages, (base.T @ (root @ solved)).astype(np.float32), level - middle @ solved)


_PREDICTED = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
_ARROW_PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def scores(model: Model, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-versus-rest scores of the texts, block by block."""
    out = np.zeros((len(edges) - 1, len(model.languages)))
    marks = np.zeros((BLOCK, FEATURES), np.float32)
    for at in range(0, len(edges) - 1, BLOCK):
        some = edges[at:at + BLOCK + 1]
        block = marks[:len(some) - 1]
        block[:] = 0
        presence(data[some[0]:some[-1]], some - some[0], block)
        size = np.maximum(block.sum(axis=1, keepdims=True), 1)
        out[at:at + BLOCK] = block @ model.weights / np.sqrt(size) + model.bias
    return out


def _predicted(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the struct column ``name`` of language and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages, whatever the corpus

    @F.arrow_udf(_PREDICTED)
    def predict(text: pa.Array) -> pa.Array:
        model = shared.value
        data, edges = text_buffer(text)
        best, value = [], []
        for _, _, part, bounds in pieces(data, edges):
            found = scores(model, part, bounds)
            best += [model.languages[i] for i in found.argmax(axis=1)]
            value += np.clip(found.max(axis=1), 0, 1).tolist()
        return pa.StructArray.from_arrays(
            [pa.array(best, pa.string()), pa.array(value, pa.float64())], fields=list(_ARROW_PREDICTED)
        )

    return small_batches(docs).withColumn(name, predict(F.lower("text")))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    name = fresh(docs, "predicted")
    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    return _predicted(docs, model, name).withColumns({
        "lang_pred": F.when(lettered, F.col(name)["lang_pred"]).otherwise(UNDETERMINED),
        "score": F.when(lettered, F.col(name)["score"]).otherwise(0.0),
    }).drop(name)


def in_known_language(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose language is recognised; a missing ``lang`` is filled in.
    Where nothing could be learned, every text with a letter stays."""
    lettered = docs.where(F.col("text").rlike(LETTER))
    if not model.languages:
        return lettered
    name = fresh(docs, "predicted")
    found = _predicted(lettered, model, name).where(F.col(name)["score"] >= min_score)
    return found.withColumn("lang", F.coalesce(F.col("lang"), F.col(name)["lang_pred"])).drop(name)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document; see the module for the method."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = with_language(docs.select("doc_id", "text"), fit(docs))
    return found.select(
        "doc_id", (F.coalesce(id_bucket(F.col("doc_id"), 3), F.lit(-1)) == 1).alias("held_out"), "lang_pred", "score"
    )
