"""Trace words scored in NumPy, a few texts at a time.

Texts stay in their rows: a function takes the text column as Arrow batches and
gives one small result per row. Words are compared by 64-bit hashes. A window's
repeated shingles are those whose previous occurrence in the text lies inside
the window too, so every shingle is looked up once whatever the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from callmetrics.functions import texts as X
from callmetrics.functions.kernels import mix, pieces, rolling_sums, span_hashes, text_buffer, word_spans

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in X.PUNCTUATION + " \t\n\r\f"]] = True


@dataclass
class Words:
    """Hashes of the words of some texts; row i has those in edges[i]:edges[i + 1]."""

    hashes: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, edges: np.ndarray) -> Words:
        question = data == ord("?")
        starts, ends, _ = word_spans(data, edges, ~(_SEPARATOR[data] | question))
        marks = np.flatnonzero(question)
        starts, ends = np.concatenate([starts, marks]), np.concatenate([ends, marks + 1])
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        return cls(span_hashes(data, starts, ends[order]), np.searchsorted(starts, edges))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.edges)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), self.sizes)


def marker_hashes(markers: Sequence[str]) -> np.ndarray:
    return Words.of(*text_buffer(pa.array(list(markers)))).hashes


def sums_before(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def previous(words: Words, k: int) -> np.ndarray:
    """Where the shingle of k words that begins at a word occurred last in its
    row; -1 if it did not, -2 if the row ends before the shingle does."""
    found = np.full(len(words.hashes), -2)
    rows = words.rows
    at = np.flatnonzero(np.arange(len(rows)) + k <= words.edges[1:][rows])
    if len(at):
        sums, factors = rolling_sums(words.hashes)
        keys = mix((sums[at + k] - sums[at]) * factors[at]) + mix(rows[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        found[at] = -1
        found[at[order[1:][same]]] = at[order[:-1][same]]
    return found


def rolling_scores(words: Words, points: np.ndarray, before: np.ndarray, chunk_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Score after every full chunk over the last words, and the rows' offsets;
    ``before`` is where every shingle occurred last."""
    span = X.WINDOW_WORDS // chunk_words
    counts = words.sizes // chunk_words
    offsets = sums_before(counts)
    base = np.repeat(words.edges[:-1], counts)
    chunk = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    begin = base + np.maximum(chunk - (span - 1), 0) * chunk_words
    end = base + (chunk + 1) * chunk_words
    marked = sums_before(points)
    scores = marked[end] - marked[begin]
    # Windows side by side: the shingle starts of each, and whose they are.
    held = end - begin - (X.SHINGLE - 1)
    place = sums_before(held)
    starts = np.arange(place[-1]) - np.repeat(place[:-1] - begin, held)
    repeated = before[starts] >= np.repeat(begin, held)
    within = sums_before(repeated)
    return scores + X.REPEAT_POINTS * (within[place[1:]] - within[place[:-1]]), offsets


def _points(words: Words, lexicon: Mapping[str, np.ndarray]) -> np.ndarray:
    return sum(np.isin(words.hashes, lexicon[family]) * worth for family, worth in X.POINTS.items())


def _hashed(lexicon: Mapping[str, Sequence[str]]) -> dict[str, np.ndarray]:
    return {family: marker_hashes(markers) for family, markers in lexicon.items()}


def rolling_scores_udf(lexicon: Mapping[str, Sequence[str]], chunk_sizes: Sequence[int] = (X.CHUNK_WORDS,)):
    """Column function: text to the struct of ``total_words`` and, per chunk
    size c, ``s<c>``, the array of its chunks' scores."""
    families = _hashed(lexicon)
    names = [f"s{c}" for c in chunk_sizes]

    @F.arrow_udf(StructType([StructField("total_words", LongType()), *[StructField(n, ArrayType(LongType())) for n in names]]))
    def scored(text: pa.Array) -> pa.Array:
        sizes = [np.zeros(0, np.int64)]
        values, ends = {n: [np.zeros(0, np.int64)] for n in names}, {n: [np.zeros(1, np.int64)] for n in names}
        for _, _, part, bounds in pieces(*text_buffer(text)):
            words = Words.of(part, bounds)
            points, before = _points(words, families), previous(words, X.SHINGLE)
            sizes.append(words.sizes)
            for name, chunk_words in zip(names, chunk_sizes):
                scores, offsets = rolling_scores(words, points, before, chunk_words)
                values[name].append(scores)
                ends[name].append(offsets[1:] + ends[name][-1][-1])
        lists = [
            pa.ListArray.from_arrays(pa.array(np.concatenate(ends[n]), pa.int32()), pa.array(np.concatenate(values[n]), pa.int64()))
            for n in names
        ]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes), pa.int64()), *lists], names=["total_words", *names])

    # Marked so that a filter on the result is not moved below it, which would
    # score every text twice.
    once = scored.asNondeterministic()
    return lambda text: once(F.lower(text))


PIECE_WORDS = 1 << 16
CHUNKS = "call_id bigint, chunk bigint, words binary, points bigint"


def chunker(lexicon: Mapping[str, Sequence[str]], chunk_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (call_id, lower-case text) to a row per full chunk, a few
    texts at a time: its number, its words' hashes and its points."""
    families = _hashed(lexicon)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            calls = batch.column(0)
            for row, _, part, bounds in pieces(*text_buffer(batch.column(1))):
                words = Words.of(part, bounds)
                counts = words.sizes // chunk_words
                offsets = sums_before(counts)
                chunk = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
                begin = np.repeat(words.edges[:-1], counts) + chunk * chunk_words
                marked = sums_before(_points(words, families))
                held = words.hashes[begin[:, None] + np.arange(chunk_words)]
                edges = np.arange(len(begin) + 1, dtype=np.int32) * np.int32(8 * chunk_words)
                yield pa.RecordBatch.from_arrays([
                    calls.take(pa.array(row + np.repeat(np.arange(len(counts)), counts))), pa.array(chunk, pa.int64()),
                    pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(held)]),
                    pa.array(marked[begin + chunk_words] - marked[begin], pa.int64()),
                ], names=["call_id", "chunk", "words", "points"])

    return cut


def chunk_scores(hashes: Sequence[np.ndarray], points: Sequence[np.ndarray], chunk_words: int) -> list[np.ndarray]:
    """``rolling_scores`` of rows given by their full chunks: the words' hashes
    and the points of each chunk. Some rows at a time, as windows overlap."""
    found = []
    for first, stop, part, bounds in pieces(np.concatenate(hashes), sums_before([len(h) for h in hashes]), PIECE_WORDS):
        words, worth = Words(part, bounds), np.zeros(len(part), np.int64)
        worth[::chunk_words] = np.concatenate(points[first:stop])
        scores, offsets = rolling_scores(words, worth, previous(words, X.SHINGLE), chunk_words)
        found += np.split(scores, offsets[1:-1])
    return found


def repetition(words: Words, first: np.ndarray, k: int) -> np.ndarray:
    """Share of repeated shingles from ``first`` to the end of every row."""
    before, rows = previous(words, k), words.rows
    inside = (np.arange(len(rows)) >= first[rows]) & (before >= first[rows])
    repeats = np.bincount(rows[inside], minlength=len(first))
    total = words.edges[1:] - first - (k - 1)
    return np.divide(repeats, total, out=np.zeros(len(first)), where=total > 0)


def repetition_udf(k: int = X.SHINGLE):
    @F.arrow_udf(DoubleType())
    def repeated(text: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for _, _, part, bounds in pieces(*text_buffer(text)):
            words = Words.of(part, bounds)
            found.append(repetition(words, words.edges[:-1], k))
        return pa.array(np.concatenate(found), pa.float64())

    return lambda text: repeated(F.lower(text))


FEATURES = (
    "rep_tail", "bt_tail", "hedge_tail", "rep_full", "bt_full", "wait_tail", "hedge_ans", "giveup_full", "flip",
    "qmark_tail", "rep_tail_k4", "wait_full", "bt_last10", "neg_tail", "len_ratio", "trace_visible",
)


def trace_features(words: Words, answer: Words, families: Mapping[str, np.ndarray], question: np.ndarray) -> dict[str, np.ndarray]:
    """Sixteen features over the words, their last 30 percent and the answer."""
    begin, end, size = words.edges[:-1], words.edges[1:], words.sizes
    last = lambda share: begin + np.floor(size * (1.0 - share)).astype(np.int64)
    tail = last(X.TAIL)
    hits = {f: sums_before(np.isin(words.hashes, m)) for f, m in {**families, "?": question}.items()}
    spoken = sums_before(np.isin(answer.hashes, families["hedge"]))
    spoken = spoken[answer.edges[1:]] - spoken[answer.edges[:-1]]

    def per_thousand(found: np.ndarray, held: np.ndarray) -> np.ndarray:
        return np.divide(found * 1000.0, held, out=np.zeros(len(held)), where=held > 0)

    def density(family: str, first: np.ndarray) -> np.ndarray:
        return per_thousand(hits[family][end] - hits[family][first], end - first)

    region = last(X.HEDGE_TAIL)
    return {
        "rep_tail": repetition(words, tail, X.LONG_SHINGLE), "bt_tail": density("backtrack", tail),
        "hedge_tail": per_thousand(hits["hedge"][end] - hits["hedge"][region] + spoken, end - region + answer.sizes),
        "rep_full": repetition(words, begin, X.LONG_SHINGLE), "bt_full": density("backtrack", begin),
        "wait_tail": density("wait", tail), "hedge_ans": per_thousand(spoken, answer.sizes),
        "giveup_full": density("giveup", begin), "flip": density("flip", begin), "qmark_tail": density("?", tail),
        "rep_tail_k4": repetition(words, tail, X.SHINGLE), "wait_full": density("wait", begin),
        "bt_last10": density("backtrack", last(X.LAST)), "neg_tail": density("negative", tail),
        "len_ratio": np.divide(answer.sizes, size, out=np.zeros(len(size)), where=size > 0),
        "trace_visible": (size > 0).astype(np.float64),
    }


def trace_features_udf(lexicon: Mapping[str, Sequence[str]]):
    """Column function: (text, answer) to the struct of the sixteen features."""
    families, question = _hashed(lexicon), marker_hashes(["?"])
    arrow = [pa.field(name, pa.float64()) for name in FEATURES]

    @F.arrow_udf(StructType([StructField(name, DoubleType()) for name in FEATURES]))
    def features(text: pa.Array, answer: pa.Array) -> pa.Array:
        found = {name: [np.zeros(0)] for name in FEATURES}
        spoken, marks = text_buffer(answer)
        for first, stop, part, bounds in pieces(*text_buffer(text)):
            own = marks[first:stop + 1]
            made = trace_features(
                Words.of(part, bounds), Words.of(spoken[own[0]:own[-1]], own - own[0]), families, question
            )
            for name in FEATURES:
                found[name].append(made[name])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(found[name]), pa.float64()) for name in FEATURES], fields=arrow)

    return lambda text, answer: features(F.lower(text), F.lower(answer))
