"""Prefix trie of conversations on minimal-perfect-hash node tables (operator 13).

Conversations that begin alike share their first turns. Every distinct sequence
of first turns is a node; its children are one turn longer. For every node the
operator counts conversations, children and leaves, and the code points that
need not be read again when a shared turn is kept.

Digests. A turn has a 128-bit hash of role and text; texts go no further. Salted
with its depth, a turn is an element, and the exclusive-or of the elements of
the first d turns is the digest of that prefix. So a prefix sum gives digests,
in parts if need be, and a node's parent has the digest less the node's own
element. Rows that meet under one digest must agree in depth, parent and length,
or the job fails: no collision passes unseen.

Node tables. For the sums over subtrees, conversations are dealt to tasks, cut
into segments of ``SEGMENT`` turns. A task enumerates the distinct digests of
its paths, gives each a slot by a minimal perfect hash (a cascade of bitmaps:
keys alone in their place of a level take the next slots, the others go on to
the next level) and verifies looked-up slots against the digest kept there.
Every node is counted by the one conversation that stands for it, the smallest:
its counts are scattered into flat arrays by slot and added into the parents'
slots from the deepest depth up. Tasks give one row per node they touched,
which Spark adds up. What lies below a segment is added at its last node.

At scale. Nothing needs all rows of a conversation or of a node in one task: a
first turn that a third of all conversations share is counted by partial sums,
and a conversation of any length is cut into segments. The text that the hash
of members is taken of is built in ranges of (node, conversation); only the
hash itself, which can't be cut, reads a node's finished text in one task.

Rows without a conv_id take no part. Null role or text counts as empty, turns
without a number come first; turns of the same number follow in an order given
by their hash, so repeated rows are turns of their own. An empty table has no
node. Columns of other names are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmetrics.llm.common import stored, table
from callmetrics.llm.kernels import mix
from callmetrics.llm.places import placed
from callmetrics.session import parallelism

SHARED_BY = 100  # conversations c with the same c - c % 100 share that one's first turns
LEAST_SHARED = 6  # crc32(c) modulo this many turns are shared
SEGMENT = 4096  # turns of a path that one group holds
TABLE_ROWS = 1 << 18  # path rows of a node table
IDS_A_ROW = 4096  # ids of a piece of a node's text of members

_STEP = 0x9E3779B97F4A7C15


class NodeTable:
    """Slots 0 to n-1 for n distinct digests (a, b), by a minimal perfect hash."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.a, self.b = np.zeros_like(a), np.zeros_like(b)
        rest, base = np.arange(len(a)), 0
        while len(rest):
            at = self._at(a[rest], b[rest], len(self.levels), 2 * len(rest))
            alone = np.bincount(at, minlength=2 * len(rest)) == 1
            slots = np.where(alone, base - 1 + np.cumsum(alone), -1)
            won = slots[at] >= 0
            own = rest[won]
            self.a[slots[at[won]]], self.b[slots[at[won]]] = a[own], b[own]
            self.levels.append(slots)
            base += len(own)
            rest = rest[~won]

    @staticmethod
    def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        turn = np.uint64(_STEP * (level + 1) & (1 << 64) - 1)
        return (mix(mix(a ^ turn) + b) % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The digests' slots; -1 where the one kept in the slot is another."""
        found, rest = np.full(len(a), -1), np.arange(len(a))
        for level, slots in enumerate(self.levels):
            slot = slots[self._at(a[rest], b[rest], level, len(slots))]
            found[rest[slot >= 0]] = slot[slot >= 0]
            rest = rest[slot < 0]
        inside = found >= 0
        inside[inside] = (self.a[found[inside]] == a[inside]) & (self.b[found[inside]] == b[inside])
        return np.where(inside, found, -1)


def rebuilt(conversations: DataFrame, shared_by: int = SHARED_BY, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Turns of every conversation after its first h were replaced by the first
    h of conversation c - c % shared_by; h is crc32(c) modulo ``least_shared``.

    (conv_id, depth, a, b, size, last): 1 for the first turn, the turn's hash,
    its code points and whether it is the last one; depth 0 is in all of them."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = placed(
        conversations.where("conv_id IS NOT NULL").select(
            "conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"),
            F.length(text).cast("long").alias("size"),
        ),
        [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "place",
    )
    most = least_shared - 1
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("place"))
    heads = (
        turns.where(F.col("conv_id") % shared_by == 0).withColumn("nth", first).where(F.col("nth") <= most)
        .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("nth", "a", "b", "size"))).alias("head"))
    )  # at most five turns of each
    plan = stored(
        turns.groupBy("conv_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("turns"))
        .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % least_shared)
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % shared_by)
        .join(heads, "base", "left")
        .withColumn("taken", F.when(F.col("head").isNull(), 0).otherwise(F.least("h", F.size("head").cast("long"))))
        .withColumn("whole", F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))),
        "plan",
    )
    shape = ["conv_id", "depth", "a", "b", "size", (F.col("depth") == F.col("whole")).alias("last")]
    zero = F.lit(0).cast("long")
    roots = plan.select("conv_id", "whole", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("size"))
    shared = plan.where("taken > 0").select("conv_id", "whole", F.explode(F.expr("slice(head, 1, int(taken))")).alias("t"))
    own = (
        turns.join(plan.where("turns > h").select("conv_id", "start", "h", "taken", "whole"), "conv_id")
        .withColumn("depth", F.col("taken") + F.col("place") - F.col("start") + 1 - F.col("h"))
        .where(F.col("place") - F.col("start") >= F.col("h"))
    )
    return (
        roots.select(*shape)
        .union(shared.select("conv_id", "whole", F.col("t.nth").cast("long").alias("depth"), "t.a", "t.b", "t.size").select(*shape))
        .union(own.select(*shape))
    )


def paths_of(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, segment, s1, s2, p1, p2, size, last): every turn with the
    digests of the prefix that it ends and of that one's parent."""
    within = Window.partitionBy("conv_id", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    element = [F.when(F.col("depth") > 0, F.xxhash64("depth", c)).otherwise(F.lit(0)).alias(e) for c, e in (("a", "e1"), ("b", "e2"))]
    parts = stored(
        turns.select("conv_id", "depth", F.expr(f"depth div {segment}").alias("segment"), "size", "last", *element)
        .withColumns({f"s{i}": F.bit_xor(f"e{i}").over(within) for i in (1, 2)}),
        "parts",
    )
    # What earlier segments of a long conversation add: one row per full segment.
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    earlier = (
        parts.where(F.col("depth") % segment == segment - 1)
        .select("conv_id", (F.col("segment") + 1).alias("segment"), *[F.bit_xor(f"s{i}").over(before).alias(f"o{i}") for i in (1, 2)])
    )
    whole = [F.col(f"s{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))) for i in (1, 2)]
    return parts.join(earlier, ["conv_id", "segment"], "left").select(
        "conv_id", "depth", "segment", whole[0].alias("s1"), whole[1].alias("s2"),
        whole[0].bitwiseXOR(F.col("e1")).alias("p1"), whole[1].bitwiseXOR(F.col("e2")).alias("p2"), "size", "last",
    )


def nodes_of(paths: DataFrame) -> DataFrame:
    """(s1, s2, p1, p2, conv_id, depth, size, n_convs, n_children) per distinct prefix."""
    same = ("depth", "p1", "p2", "size")
    found = paths.groupBy("s1", "s2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[f(c).alias(f"{n}_{c}") for c in same for f, n in ((F.min, "least"), (F.max, "most"))],
    )
    alike = F.lit(True)
    for c in same:
        alike = alike & (F.col(f"least_{c}") == F.col(f"most_{c}"))
    verified = F.when(alike, F.col("least_depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    nodes = stored(
        found.select("s1", "s2", "conv_id", "n_convs", verified.alias("depth"), *[F.col(f"least_{c}").alias(c) for c in same[1:]]),
        "nodes",
    )
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, ["s1", "s2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


_COUNTED = ("s1", "s2", "p1", "p2", "depth", "leaves", "saved")


def _summed(rows: list[np.ndarray], segment: int) -> pa.RecordBatch:
    """Sums over the subtrees of the paths' nodes, as far as these rows count."""
    s1, s2, p1, p2, depth, leaves, saved = rows
    order = np.lexsort((s2, s1))
    new = np.ones(len(order), bool)
    new[1:] = (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
    one = order[new]  # a row of each distinct digest
    nodes = NodeTable(s1[one], s2[one])
    slot = nodes.find(s1, s2)
    parent, deep = np.full(len(one), -1), np.zeros(len(one), np.int64)
    deep[slot[one]] = depth[one]
    inner = one[depth[one] % segment > 0]  # a segment's first node has its parent in another one
    parent[slot[inner]] = nodes.find(p1[inner], p2[inner])
    total = np.zeros((2, len(one)), np.int64)
    np.add.at(total[0], slot, leaves)
    np.add.at(total[1], slot, saved)
    below = np.argsort(-deep, kind="stable")
    for own in np.split(below, np.flatnonzero(np.diff(deep[below])) + 1):
        own = own[parent[own] >= 0]
        for values in total:
            np.add.at(values, parent[own], values[own])
    some = np.flatnonzero(total.any(axis=0))
    columns = [nodes.a[some].view(np.int64), nodes.b[some].view(np.int64), total[0][some], total[1][some]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s1", "s2", "leaves", "saved"])


def _accumulate(segment: int, table_rows: int):
    """Node tables over runs of whole (conversation, segment) groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def columns(t: pa.Table) -> list[np.ndarray]:
            found = [t[c].to_numpy() for c in _COUNTED]
            return [x.view(np.uint64) for x in found[:4]] + found[4:]

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < table_rows:
                continue
            t = pa.Table.from_batches(held)
            conv, part = t["conv_id"].to_numpy(), t["segment"].to_numpy()
            new = np.flatnonzero((conv[1:] != conv[:-1]) | (part[1:] != part[:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield _summed(columns(t.slice(0, cut)), segment)
            held, rows = t.slice(cut).to_batches(), len(t) - cut
        if rows:
            yield _summed(columns(pa.Table.from_batches(held)), segment)

    return work


def subtree_sums(paths: DataFrame, nodes: DataFrame, segment: int = SEGMENT, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(s1, s2, n_leaves, saved_tokens) per node of ``nodes_of``."""
    key = ["conv_id", "segment", *_COUNTED[:5]]
    zero = F.lit(0).cast("long")
    own = nodes.select(
        "conv_id", F.expr(f"depth div {segment}").alias("segment"), *_COUNTED[:5],
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    # Sums of a long conversation's later segments, added at the last node of each earlier one.
    later = own.where("segment > 0").groupBy("conv_id", "segment").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    marks = paths.where(F.col("depth") % segment == segment - 1)
    behind = Window.partitionBy("conv_id").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        marks.select(*key, zero.alias("leaves"), zero.alias("saved"), (F.col("segment") * 2 + 1).alias("step"))
        .unionByName(later.withColumn("step", F.col("segment") * 2), allowMissingColumns=True)
        .withColumns({c: F.sum(c).over(behind) for c in ("leaves", "saved")})
        .where("depth IS NOT NULL").drop("step")
    )
    rows = paths.select(*key, zero.alias("leaves"), zero.alias("saved")).union(own).union(carried)
    return (
        rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment")
        .mapInArrow(_accumulate(segment, table_rows), "s1 long, s2 long, leaves long, saved long")
        .groupBy("s1", "s2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (s1, s2, conv_id): pieces of each node's text of ids."""
    for batch in batches:
        s1, s2, conv = (batch.column(i).to_numpy() for i in range(3))
        if not len(conv):
            continue
        new = np.flatnonzero((s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])) + 1
        begins = np.union1d(np.concatenate([[0], new]), np.arange(0, len(conv), IDS_A_ROW))
        ends = np.append(begins[1:], len(conv))
        ids = conv.tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(begins.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s1[begins]), pa.array(s2[begins]), pa.array(conv[begins]), pa.array(texts)], names=["s1", "s2", "first", "ids"]
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (s1, s2, first): the hash of each node's text, piece by piece."""
    node, digest = None, None

    def flush(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())],
            names=["s1", "s2", "ends"],
        )

    for batch in batches:
        done = []
        for s1, s2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (s1, s2) != node:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (s1, s2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield flush(done)
    if node:
        yield flush([(*node, digest.hexdigest())])


def ends_of(paths: DataFrame) -> DataFrame:
    """(s1, s2, ends): the SHA-256 of the ids of the conversations that end at a node."""
    last = stored(paths.where("last").select("s1", "s2", "conv_id"), "ends")
    pieces = (
        last.repartitionByRange(max(1, parallelism(last.sparkSession)), "s1", "s2", "conv_id")
        .sortWithinPartitions("s1", "s2", "conv_id")
        .mapInArrow(_joined_ids, "s1 long, s2 long, first long, ids string")
    )
    return (
        pieces.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "first").select("s1", "s2", "ids")
        .mapInArrow(_hashed, "s1 long, s2 long, ends string")
    )


def trie(paths: DataFrame, segment: int = SEGMENT, table_rows: int = TABLE_ROWS) -> DataFrame:
    """One row per node of ``paths_of``: the conversation that stands for it,
    its depth and parent, and what is counted."""
    nodes = stored(nodes_of(paths), "trie")
    root = nodes.where("depth = 0").agg(F.min("conv_id").alias("conv_id")).first().conv_id
    near = nodes.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root)).cast("long"))
    parents = nodes.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    far = nodes.where("depth >= 2").join(parents.where("p1 <> 0 OR p2 <> 0"), ["p1", "p2"], "left")
    return (
        near.unionByName(far)
        .join(subtree_sums(paths, nodes, segment, table_rows), ["s1", "s2"], "left")
        .join(ends_of(paths), ["s1", "s2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations with shared first turns."""
    return trie(stored(paths_of(rebuilt(table(spark, sf_dir, "conversations"))), "paths"))
