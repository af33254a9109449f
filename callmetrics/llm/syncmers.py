"""Document fingerprints from closed syncmers (operator 2).

A window of ``K`` bytes is a closed syncmer if the smallest hash among its
``W`` inner strings of ``S`` bytes stands first or last. Whether a window is
chosen depends on the window alone, so equal passages have equal anchors
wherever they stand. Of any ``W - 1`` windows in a row at least one is chosen;
as every byte is in ``K`` windows, no change of a byte goes past all anchors.

The fingerprint is all of a text's anchors in order, each as its distance from
the one before (two hex digits) and the first 32 bits of its hash (eight). It
grows with the text: about six digits for ten bytes.

The likeness of two fingerprints is positional. Equal anchors (the n-th of a
hash in one with the n-th of it in the other) are aligned by the longest chain
that ascends in both; the stretches that the chain's windows cover in both,
over all that the windows of either cover, is the likeness. A passage that was
moved leaves the chain, so it counts less than one that stayed.

A text without an anchor (shorter than a window, or none chosen) has one over
its whole bytes. Null counts as empty; empty texts have the empty fingerprint,
which is like itself (1) and like no other (0). Equal texts have equal
fingerprints.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from callmetrics.llm.common import cut_points, small_batches, table
from callmetrics.llm.kernels import mix, pieces, span_hashes, text_buffer
from callmetrics.session import parallelism

S, W = 8, 33
K = S + W - 1

ANCHOR = np.dtype([("gap", "u1"), ("hash", ">u4")])


def syncmers(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the bytes and hash of every anchor, by row and start."""
    rows = starts = np.zeros(0, np.int64)
    hashes = np.zeros(0, np.uint64)
    if len(data) >= K:
        inner = mix(np.ndarray((len(data) - S + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64))
        least = inner
        for reach in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-reach], least[reach:])
        least = np.minimum(least[:-1], least[1:])  # over W = 33
        starts = np.flatnonzero((inner[:len(least)] == least) | (inner[W - 1:] == least))
        rows = np.searchsorted(edges, starts, "right") - 1
        whole = starts + K <= edges[rows + 1]
        starts, rows = starts[whole], rows[whole]
        hashes = inner[starts]
        for part in range(S, K, S):  # the whole window
            hashes = mix(hashes * np.uint64(3) + inner[starts + part])
    bare = np.flatnonzero((np.bincount(rows, minlength=len(edges) - 1) == 0) & (edges[1:] > edges[:-1]))
    if len(bare):
        rows, starts = np.concatenate([rows, bare]), np.concatenate([starts, edges[bare]])
        hashes = np.concatenate([hashes, span_hashes(data, edges[bare], edges[bare + 1])])
        order = np.argsort(rows, kind="stable")
        rows, starts, hashes = rows[order], starts[order], hashes[order]
    return rows, starts, hashes


def sketches(data: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Each row's anchors in order."""
    rows, starts, hashes = syncmers(data, edges)
    found = np.zeros(len(rows), ANCHOR)
    begins = np.searchsorted(rows, np.arange(len(edges)))
    at = starts - edges[rows]
    gaps = np.diff(at, prepend=0)
    filled = begins[:-1][begins[:-1] < begins[1:]]
    gaps[filled] = at[filled]
    found["gap"], found["hash"] = gaps, hashes >> np.uint64(32)
    return [found[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]


def _all_sketches(text: pa.Array) -> list[np.ndarray]:
    data, edges = text_buffer(text)
    return [s for _, _, part, bounds in pieces(data, edges) for s in sketches(part, bounds)]


def _hex(sketch: np.ndarray) -> str:
    return sketch.tobytes().hex()


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Every hash with the number of its occurrence below it."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order].astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    number = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    out = np.zeros(len(hashes), np.uint64)
    out[order] = ordered << np.uint64(32) | number.astype(np.uint64)
    return out


def _ascending(values: list[int]) -> list[int]:
    """Positions of a longest strictly ascending part."""
    ends, at, before = [], [], []
    for i, value in enumerate(values):
        place = bisect_left(ends, value)
        before.append(at[place - 1] if place else -1)
        if place == len(ends):
            ends.append(value)
            at.append(i)
        else:
            ends[place], at[place] = value, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the aligned anchors of two sketches, in both texts."""
    _, i, j = np.intersect1d(_numbered(a["hash"]), _numbered(b["hash"]), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    if np.any(j[1:] < j[:-1]):
        chain = _ascending(j.tolist())
        i, j = i[chain], j[chain]
    return np.cumsum(a["gap"], dtype=np.int64)[i], np.cumsum(b["gap"], dtype=np.int64)[j]


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    left, right = aligned(a, b)
    if not len(left):
        return 0.0
    covered = K + int(np.minimum(np.minimum(np.diff(left), np.diff(right)), K).sum())
    spans = sum(int(x["gap"][1:].sum(dtype=np.int64)) + K for x in (a, b))
    return covered / (spans - covered)


def likeness(a: str | None, b: str | None) -> float:
    """Positional likeness of two fingerprints, 0 to 1."""
    return _likeness(*(np.frombuffer(bytes.fromhex(x or ""), ANCHOR) for x in (a, b)))


@F.arrow_udf(StringType())
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array([_hex(s) for s in _all_sketches(text)], pa.string())


_LIKENESS = [
    ("fingerprint", StringType(), pa.string()), ("edited_fingerprint", StringType(), pa.string()),
    ("near_edited", DoubleType(), pa.float64()), ("near_next", DoubleType(), pa.float64()),
]


@F.arrow_udf(StructType([StructField(n, t) for n, t, _ in _LIKENESS]))
def _compared(text: pa.Array, edited: pa.Array, following: pa.Array) -> pa.Array:
    """Rows come in order, so a row's successor mostly is the next row."""
    own, other = _all_sketches(text), _all_sketches(edited)
    size = len(text)
    known = pc.equal(following.slice(0, max(size - 1, 0)), text.slice(1)).to_pylist() + [False] * min(size, 1)
    strange = [i for i, same in enumerate(known) if not same]
    found = dict(zip(strange, _all_sketches(following.take(pa.array(strange, pa.int64())))))
    after = [own[i + 1] if same else found[i] for i, same in enumerate(known)]
    columns = (
        [_hex(s) for s in own], [_hex(s) for s in other],
        [_likeness(a, b) for a, b in zip(own, other)], [_likeness(a, b) for a, b in zip(own, after)],
    )
    return pa.StructArray.from_arrays(
        [pa.array(v, t) for v, (_, _, t) in zip(columns, _LIKENESS)], fields=[pa.field(n, t) for n, _, t in _LIKENESS]
    )


@F.arrow_udf(ArrayType(StructType([StructField("start", LongType()), StructField("hash", LongType())])))
def _anchors(text: pa.Array) -> pa.Array:
    data, edges = text_buffer(text)
    out: list[list[dict]] = []
    for first, stop, part, bounds in pieces(data, edges):
        rows, starts, hashes = syncmers(part, bounds)
        marks = [{"start": s, "hash": h} for s, h in zip((starts - bounds[rows]).tolist(), hashes.view(np.int64).tolist())]
        ends = np.searchsorted(rows, np.arange(stop - first + 1)).tolist()
        out += [marks[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("hash", pa.int64())])))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, start, hash) of every anchor; starts count bytes. Passages that
    two texts share show as equal hashes at equal distances."""
    return small_batches(docs).select("doc_id", F.explode(_anchors(F.col("text"))).alias("a")).select("doc_id", "a.*")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    return small_batches(docs).withColumn("fingerprint", fingerprint(F.col("text")))


def _cell(doc_id: Column, df: DataFrame, points: list[int]) -> DataFrame:
    inf = float("inf")
    splits = [-inf, *sorted({float(p) for p in points}), inf] if points else [-inf, 0.0, inf]
    cutter = Bucketizer(splits=splits, inputCol="_key", outputCol="_cell", handleInvalid="keep")
    # A missing id sorts first.
    keyed = df.withColumn("_key", F.coalesce(doc_id.cast("double"), F.lit(-1.7e308)))
    return cutter.transform(keyed).withColumn("cell", F.col("_cell").cast("long")).drop("_key", "_cell")


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) in ascending order of ids; after the last comes
    the first. Null ids come first, equal ids go by text.

    Ids are cut into about as many ranges as there are shuffle partitions. The
    first document of every range is also sent, as a guest, to the end of the
    range before, so every successor is found inside one range and each text
    moves once."""
    spark = small_batches(docs).sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    points = cut_points(ids, "doc_id", parallelism(spark))
    firsts = sorted(  # one row per range
        tuple(r) for r in _cell(F.col("doc_id"), ids, points).groupBy("cell")
        .agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).collect()
    )
    homes = [(None if r[2] else r[1], firsts[i - 1][0]) for i, r in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(homes, "first long, home long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.struct(F.col("cell"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("home").alias("cell"), F.lit(True).alias("guest"))
    dealt = (
        _cell(F.col("doc_id"), rows, points)
        .join(guests, F.col("doc_id").eqNullSafe(F.col("first")), "left")
        .withColumn("seat", F.explode(F.when(F.col("home").isNull(), F.array(own)).otherwise(F.array(own, visit))))
        .select("doc_id", "text", "seat.cell", "seat.guest")
    )
    order = Window.partitionBy("cell").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where(~F.col("guest")).select("doc_id", "text", "next_text")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; see the module for the method."""
    docs = beside_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    length = F.length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), length - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    return (
        docs.withColumn("edited", edited)
        .select(
            "doc_id", length.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            _compared(F.col("text"), F.col("edited"), F.col("next_text")).alias("b"),
        )
        .select("doc_id", "n_chars", "edited_sha256", "b.*")
    )
