"""Resampling by importance towards a target text (operator 11).

Texts and a target are seen through hashed features: all words and all pairs of
following words, each in one of ``BUCKETS`` buckets. A bucket that is more
frequent in the target than in the documents has a gain above zero; a
document's weight is the mean gain of its features. Adding Gumbel noise, drawn
from the document's id, to the weights and taking the highest sums draws
without replacement in proportion to the weights' exponentials.

Kernels. A run of texts goes through Arrow: ``ascii_lower``, then
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode``. A word is
from there on its dictionary index, and the indices shifted by one against each
other are the pairs. Bytes are read once per distinct word: a pair's CRC follows
from those of its two words, since appending n bytes to a text is a linear map
of its CRC. Distinct pairs get a bucket, each place takes its gain from there,
and gains are reduced over the segments that are the documents.

At scale. Two passes over the texts, neither of which moves them: the first
counts the buckets (at most ``BUCKETS`` rows per task, summed by Spark), the
second weighs. The gains are ``BUCKETS`` numbers. Only ids and scores are
sorted, in ranges (``places.py``).

Null and empty texts, and texts without a word, have no features and the weight
0. A missing id counts as empty in the noise and comes last among equal scores.
Repeated rows are rows of their own. An empty table gives an empty result; with
an empty target, buckets still have gains, from their counts alone. Columns of
other names are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from callmetrics.llm.common import fresh, stored, table
from callmetrics.llm.kernels import text_buffer
from callmetrics.llm.places import placed

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25  # percent of the documents with enough words
SEED = 7

# What stands between words: all ASCII but digits and (lower-cased) letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE_BYTES = 1 << 21
CRC_POLYNOMIAL = 0xEDB88320  # fixed value of CRC-32, lowest bit first


def _times(columns: list[int], value: int) -> int:
    """A 32 x 32 bit matrix, given by columns, times a vector."""
    found = 0
    for column in columns:
        if value & 1:
            found ^= column
        value >>= 1
    return found


@lru_cache(maxsize=512)
def append_tables(length: int) -> np.ndarray:
    """What appending ``length`` zero bytes does to a CRC, as four tables by its bytes."""
    power = [CRC_POLYNOMIAL, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        power = [_times(power, c) for c in power]  # eight of them
    whole = [1 << i for i in range(32)]
    while length:
        if length & 1:
            whole = [_times(power, c) for c in whole]
        power = [_times(power, c) for c in power]
        length >>= 1
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            tables[byte] ^= np.where(np.arange(256) >> bit & 1, np.uint32(whole[byte * 8 + bit]), np.uint32(0))
    return tables


def appended(crc: np.ndarray, lengths: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """CRC of texts with the given CRCs, followed by texts of the given lengths and CRCs."""
    out = tails.astype(np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        tables, head = append_tables(int(lengths[own[0]])), crc[own]
        out[own] ^= tables[0][head & 255] ^ tables[1][head >> 8 & 255] ^ tables[2][head >> 16 & 255] ^ tables[3][head >> 24]
    return out


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows within the byte budget; a longer text comes alone."""
    _, edges = text_buffer(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + PIECE_BYTES, "right")) - 1)
        yield texts.slice(row, stop - row)
        row = stop


class Features:
    """Buckets of all words and pairs of a run of texts."""

    def __init__(self, texts: pa.Array, buckets: int):
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
        values, edges = pc.list_flatten(lists), np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=edges[1:])
        there = pc.not_equal(values, "")  # a text may begin or end between words
        kept = np.zeros(len(values) + 1, np.int64)
        np.cumsum(there.to_numpy(zero_copy_only=False), out=kept[1:])
        self.edges = kept[edges]  # of the texts, in words
        coded = pc.dictionary_encode(values.filter(there))
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        crc, length = self._words(coded.dictionary)
        self.words = (crc % np.uint32(buckets)).astype(np.int64)[index]

        follows = np.ones(max(0, len(index) - 1), bool)  # the next word is of the same text
        ends = self.edges[1:-1]
        follows[ends[(ends > 0) & (ends < len(index))] - 1] = False
        self.at = np.flatnonzero(follows)
        pairs = pc.dictionary_encode(pa.array(index[self.at] * max(1, len(crc)) + index[self.at + 1]))
        codes = pairs.dictionary.to_numpy()
        left, right = np.divmod(codes, max(1, len(crc)))
        spaced = appended(np.full(len(crc), zlib.crc32(b" "), np.uint32), length, crc)
        found = appended(crc[left], length[right] + 1, spaced[right]) % np.uint32(buckets)
        self.pairs = found.astype(np.int64)[pairs.indices.to_numpy()]

    @staticmethod
    def _words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of every distinct word."""
        data, edges = text_buffer(words)
        view, crc32 = memoryview(data), zlib.crc32
        crc = np.fromiter((crc32(view[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())), np.uint32, len(words))
        return crc, np.diff(edges)

    def counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.words, minlength=buckets) + np.bincount(self.pairs, minlength=buckets)

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and floored mean gain of every text."""
        gain = gains[self.words]
        gain[self.at] += gains[self.pairs]
        n_words = np.diff(self.edges)
        n_features, totals, some = np.maximum(2 * n_words - 1, 0), np.zeros(len(n_words), np.int64), n_words > 0
        if some.any():
            totals[some] = np.add.reduceat(gain, self.edges[:-1][some])
        return n_words, n_features, totals // np.maximum(n_features, 1)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all texts fall in each bucket.

    A task gives one row per bucket it met; after Spark's sum there are at most
    ``buckets`` rows, which is what the driver reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                total += Features(piece, buckets).counts(buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    found = texts.select(F.col("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():
        counts[bucket] = n
    return counts


def gains_of(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the logarithm, in thousandths, of its smoothed share in the
    target over that in the documents."""
    buckets, own, other = len(counts), float(counts.sum()), float(target.sum())
    ratio = (target + 1.0) * (own + buckets) / ((counts + 1.0) * (other + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


_WEIGHED = StructType([StructField(n, LongType()) for n in ("n_words", "n_features", "weight")])


def weighed(docs: DataFrame, gains: np.ndarray, name: str) -> DataFrame:
    """``docs`` with the struct ``name``: n_words, n_features and weight."""

    @F.arrow_udf(_WEIGHED)
    def weigh(texts: pa.Array) -> pa.Array:
        parts = [Features(piece, len(gains)).weights(gains) for piece in _pieces(texts)]
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=_WEIGHED.names)

    return docs.withColumn(name, weigh(F.col("text")))


def noise(doc_id, seed: int = SEED) -> F.Column:
    """Gumbel noise in thousandths, from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def _gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    return gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of ``docs``."""
    found = weighed(docs.select("doc_id", "text"), _gains(docs, target, buckets), "weighed")
    return found.select("doc_id", "weighed.*", (F.col("weighed.weight") + noise(F.col("doc_id"), seed)).alias("score"))


def drawn(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows of ``importance`` with the column rank: 1 to the number drawn, which
    is ``share`` percent of the documents with enough words; null if not drawn."""
    enough = F.col("n_words") >= least_words
    rows = placed(scored, [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], fresh(scored, "rank_place"))
    place = rows.columns[-1]
    many = scored.where(enough).count() * share // 100
    return rows.withColumn("rank", F.when(enough & (F.col(place) <= many), F.col(place))).drop(place)


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``. Texts are not moved: every row is compared with
    the last one that is drawn, and rows that tie with it in score and id come too."""
    name = fresh(docs, "weighed")
    rows = weighed(docs, _gains(docs, target, buckets), name)
    score = F.col(f"{name}.weight") + noise(F.col("doc_id"), seed)
    narrow = stored(rows.select("doc_id", f"{name}.n_words", score.alias("score")), "importance")
    last = drawn(narrow, share).where("rank IS NOT NULL").orderBy(F.col("rank").desc()).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    up_to = F.lit(True) if last.doc_id is None else F.col("doc_id") <= last.doc_id
    return rows.where(
        (F.col(f"{name}.n_words") >= LEAST_WORDS) & ((score > last.score) | ((score == last.score) & up_to))
    ).drop(name)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark's texts."""
    scored = stored(importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "importance")
    return drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")
