"""Near-duplicates by SimHash with pigeonring candidates (operator 8).

The fingerprint has 64 bits over XXH64 hashes of the 3-word shingles. Two
fingerprints are linked when at most three bits differ.

Candidates. The 64 bits form a ring of four segments of 16 bits. If the four
differences add up to at most 3, the strong pigeonring principle gives a start
from which every chain of consecutive segments stays within its proportional
budget: after 1, 2, 3 and 4 segments at most 0, 1, 2 and 3 differing bits. So
from that start one segment is equal and the next differs in one bit at most,
which leaves one of its halves equal. Start, half and those 24 bits are the
key: eight rows per distinct fingerprint, however many copies it has. Within a
key the chain budgets are checked segment by segment before the full distance.

Copies never become pairs: equal texts share a fingerprint and are one row.
Inside a key a task keeps a union-find and emits only links that join two
parts, so at most one row less than it read. A key with many fingerprints is
cut into blocks, and each pair of blocks goes to a task of its own.

Nulls and empty texts have the fingerprint zero and are linked like any other.
Repeated rows (equal ids too) come back as often as they came in. A null id
counts last: its group's component is null only if no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from callmetrics.llm.common import small_batches, stored, table
from callmetrics.llm.graph import connected_components

SHINGLE = 3
DISTANCE = 3
SEGMENTS = 4
BLOCK_ROWS = 4096

_POWERS = 1 << np.arange(64, dtype=np.uint64)
_SIGN = np.uint64(1 << 63)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of every run of ``shingle`` words; a shorter text is one run."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    begins = [0, *(ends[:len(words) - width] + 1).tolist()]
    return np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(begins, ends[width - 1:].tolist())), np.uint64, len(begins)
    )


def fingerprint_of(text: str | None) -> int:
    """SimHash of one text, unsigned."""
    hashes = shingle_hashes(text, SHINGLE)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(_POWERS[counts * 2 > len(hashes)].sum(dtype=np.uint64))


@F.arrow_udf(LongType())
def _fingerprint(text: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint_of(t.as_py()) for t in text), np.uint64, len(text))
    return pa.array(found.view(np.int64))


def fingerprints(docs: DataFrame, name: str = "simhash") -> DataFrame:
    """``docs`` with the column ``name``: the 64 bits as a signed long."""
    return small_batches(docs).withColumn(name, _fingerprint(F.col("text")))


def _keys(simhash) -> F.Column:
    """Per start segment and half of the next segment: the 24 equal bits, and
    start and half above them."""
    keys = []
    for start in range(SEGMENTS):
        segment = F.shiftrightunsigned(simhash, 16 * start).bitwiseAND(0xFFFF)
        following = F.shiftrightunsigned(simhash, 16 * ((start + 1) % SEGMENTS)).bitwiseAND(0xFFFF)
        for half in range(2):
            part = F.shiftrightunsigned(following, 8 * half).bitwiseAND(0xFF)
            keys.append(F.lit((start * 2 + half) << 24) + F.shiftleft(segment, 8) + part)
    return F.array(*keys)


def _within(left: np.ndarray, right: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Pairs whose chains from the start segment stay within the budgets."""
    shift = (start.astype(np.uint64) * np.uint64(16)) % np.uint64(64)
    other = left ^ right
    turned = (other >> shift) | np.where(shift == 0, np.uint64(0), other << ((np.uint64(64) - shift) % np.uint64(64)))
    ok = np.ones(len(left), bool)
    for segments in range(1, SEGMENTS):
        mask = np.uint64((1 << (16 * segments)) - 1)
        ok &= np.bitwise_count(turned & mask) <= segments * DISTANCE // SEGMENTS
    return ok & (np.bitwise_count(other) <= DISTANCE)


class _Forest:
    """Union-find over the rows of one batch."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, lefts: np.ndarray, rights: np.ndarray) -> list[int]:
        """Positions of the pairs that joined two parts."""
        kept = []
        for at, (x, y) in enumerate(zip(lefts.tolist(), rights.tolist())):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                kept.append(at)
        return kept

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up


def _links_of(cell: np.ndarray, prints: np.ndarray, side: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links inside every run of equal cells. ``side`` is
    0 or 1 for the two blocks of a pair of blocks, 2 if a block meets itself."""
    forest, lefts, rights = _Forest(len(cell)), [], []
    apart = 1
    alive = np.flatnonzero(cell[:-1] == cell[1:])
    while len(alive):
        a, b = alive, alive + apart
        near = ((side[a] != side[b]) | (side[a] == 2)) & (forest.parent[a] != forest.parent[b])
        a, b = a[near], b[near]
        if len(a):
            near = _within(prints[a], prints[b], start[a])
            a, b = a[near], b[near]
            kept = forest.join(a, b)
            if kept:
                forest.flatten()
                lefts.append(prints[a[kept]])
                rights.append(prints[b[kept]])
        apart += 1
        alive = alive[alive + apart < len(cell)]
        alive = alive[cell[alive] == cell[alive + apart]]
    if not lefts:
        return (np.zeros(0, np.uint64),) * 2
    return np.concatenate(lefts), np.concatenate(rights)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by cell; a cell is short, so one that a batch cuts is
    carried over to the next."""
    carried: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if carried is not None:
            rows = pa.concat_tables([carried, rows])
        if not len(rows):
            continue
        cell = rows["cell"].to_numpy()
        cut = int(np.searchsorted(cell, cell[-1], "left")) if np.all(cell[:-1] <= cell[1:]) else 0
        carried = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if carried is not None and len(carried):
        yield carried


def _pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["a", "b"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_cells(batches):
        yield _pairs(*_links_of(
            rows["cell"].to_numpy(), rows["simhash"].to_numpy().view(np.uint64), rows["side"].to_numpy(), rows["start"].to_numpy()
        ))


def _cells(keyed: DataFrame, node: str, block_rows: int) -> DataFrame:
    """``keyed`` with the columns cell and side: the cells of every key that has
    more than one row. Block i of a key meets blocks i..last, so cells are (low
    block, high block)."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    block = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    return (
        keyed.join(sizes.select("key", blocks.alias("blocks")), "key")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        .withColumn("side", F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")))
        .drop("blocks", "block", "other")
    )


def links(prints: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within the distance;
    links inside one key that close a circle are left out.

    ``prints``: distinct values in ``simhash``."""
    keyed = prints.select("simhash", F.explode(_keys(F.col("simhash"))).alias("key"))
    cells = _cells(keyed, "simhash", block_rows).select("simhash", F.shiftright("key", 25).cast("int").alias("start"), "cell", "side")
    return (
        cells.repartition("cell").sortWithinPartitions("cell", "simhash")
        .mapInArrow(_links, "a long, b long")
    )


def groups_of(narrow: DataFrame) -> DataFrame:
    """(simhash, least, root) per distinct fingerprint of (doc_id, simhash):
    its smallest document and the fingerprint that stands for its group."""
    prints = stored(narrow.groupBy("simhash").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected_components(links(prints.select("simhash")))
    return stored(
        prints.join(roots, prints["simhash"] == roots["node"], "left")
        .select("simhash", "least", F.coalesce("root", "simhash").alias("root")),
        "groups",
    )


def components(narrow: DataFrame) -> DataFrame:
    """(doc_id, simhash, component_id) for rows of (doc_id, simhash)."""
    groups = groups_of(narrow)
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "root").select("simhash", "component_id")
    return narrow.join(named, "simhash").select("doc_id", "simhash", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; see the module for the method."""
    docs = table(spark, sf_dir, "documents")
    narrow = stored(fingerprints(docs.select("doc_id", "text")).select("doc_id", "simhash"), "simhash")
    return components(narrow).select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )
