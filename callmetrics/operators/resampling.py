"""Resampling of whole clusters without a table of draws.

A replicate draws as many clusters as there are, with replacement. Here a
cluster carries what it was drawn: either picked out of the seeded md5 draws,
which any engine can repeat, or, where clusters times replicates are too many
to be drawn one by one, by splitting. There the clusters are the leaves of a
tree of index ranges, and a replicate's draws go down it by binomials seeded
with the range. A task that holds some clusters walks to their leaves only, so
it knows their draws without having seen any other, and all draws of a
replicate still add up to the number of clusters.

Replicates go in blocks of ``BLOCK``: a row of the data meets one list of draws
per block, and a task adds up arrays over the replicates.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.functions.hashing import md5_heads
from callmetrics.operators.metrics import NAN, bootstrap_draws, cluster_sums, indexed_clusters, skill
from callmetrics.operators.ordered import CELL, with_cell
from callmetrics.session import materialize, parallelism

LEAF = 64  # clusters
BLOCK = 250  # replicates
HELD = 2000  # groups of sums that a task holds before it gives them on
RANGE = 1 << 14  # clusters whose draws meet their rows in one task
PIECE = 1 << 20  # draws of a replicate that a task makes at once
REPS_AT_ONCE = 25
SCANNED_ROWS = 256  # of BLOCK counts each, several times over


def leaf_draws(wanted: Sequence[int], clusters: int, replicates: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per wanted leaf (ascending) the number of draws that fall in it, by replicate."""
    whole = -(-clusters // LEAF)
    stack = [(0, whole, np.full(replicates, clusters), list(wanted))]
    while stack:
        low, high, draws, mine = stack.pop()
        if not mine:
            continue
        if high - low == 1:
            yield low, draws
            continue
        middle = (low + high) // 2
        left, size = (middle - low) * LEAF, min(high * LEAF, clusters) - low * LEAF
        taken = np.random.default_rng([seed, low, high]).binomial(draws, left / size)
        cut = bisect_left(mine, middle)
        stack += [(middle, high, draws - taken, mine[cut:]), (low, middle, taken, mine[:cut])]


def leaf_weights(leaf: int, draws: np.ndarray, clusters: int, seed: int) -> np.ndarray:
    """How often each cluster of a leaf is drawn: replicates x clusters."""
    size = min((leaf + 1) * LEAF, clusters) - leaf * LEAF
    return np.random.default_rng([seed, leaf, 0]).multinomial(draws, np.full(size, 1.0 / size))


def _by_leaf(indexed: DataFrame) -> DataFrame:
    return indexed.repartition(F.expr(f"idx div {LEAF}")).sortWithinPartitions("idx")


def split_sums(indexed: DataFrame, sums: Sequence[str], clusters: int, replicates: int, seed: int) -> DataFrame:
    """(rep, sums) over the resampled clusters of ``indexed`` (idx and doubles).
    A task gives one row per replicate, whatever number of clusters it holds."""
    sums = list(sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, len(sums)))
        some = False
        for batch in batches:
            idx = batch.column(0).to_numpy()
            values = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(sums))], axis=1)
            leaf = idx // LEAF
            some = some or len(idx) > 0
            for number, draws in leaf_draws(np.unique(leaf).tolist(), clusters, replicates, seed):
                mine = leaf == number
                total += leaf_weights(number, draws, clusters, seed)[:, idx[mine] % LEAF] @ values[mine]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), *map(pa.array, total.T)], names=["rep", *sums])

    shape = "rep long, " + ", ".join(f"{s} double" for s in sums)
    rows = _by_leaf(indexed.select("idx", *[F.col(s).cast("double").alias(s) for s in sums]))
    return rows.mapInArrow(work, shape).groupBy("rep").agg(*[F.sum(s).alias(s) for s in sums])


def split_interval(rows: DataFrame, cluster: str = "instance_id", replicates: int = 2000, seed: int = 20260712) -> DataFrame:
    """``clustered_interval`` by splitting: 2.5 and 97.5 percent points of the
    Brier skill, and the smallest and largest number of draws of a replicate."""
    clusters = materialize(indexed_clusters(cluster_sums(rows, cluster), cluster).select("idx", "error", "baseline"))
    count = clusters.count()
    if count >= 2:
        sums = split_sums(clusters.withColumn("drawn", F.lit(1.0)), ["error", "baseline", "drawn"], count, replicates, seed)
    else:
        sums = clusters.sparkSession.createDataFrame([], "rep bigint, error double, baseline double, drawn double")
    skills = sums.select(skill(F.col("error"), F.col("baseline")).alias("skill"), "drawn").where(~F.isnan("skill"))
    # At most one row per replicate.
    points = skills.agg(
        F.percentile("skill", F.lit(0.025)).alias("lo"), F.percentile("skill", F.lit(0.975)).alias("hi"),
        F.count(F.lit(1)).alias("replicates"), F.min("drawn").alias("least"), F.max("drawn").alias("most"),
    )
    return points.select(
        F.lit(count).cast("bigint").alias("clusters"), "replicates",
        F.coalesce("lo", F.lit(NAN)).alias("ci_low"), F.coalesce("hi", F.lit(NAN)).alias("ci_high"),
        F.col("least").cast("bigint").alias("least_draws"), F.col("most").cast("bigint").alias("most_draws"),
    )


def drawn_lists(index: DataFrame, clusters: int, replicates: int, seed: int) -> DataFrame:
    """(idx, block, drawn) from the md5 draws: the replicates of the block, by
    their place in it, that drew the cluster, as often as they did."""
    draws = bootstrap_draws(index.sparkSession, max(clusters, 1), replicates, seed)
    return draws.groupBy("idx", F.expr(f"rep div {BLOCK}").alias("block")).agg(
        F.collect_list((F.col("rep") % BLOCK).cast("int")).alias("drawn")
    )  # about BLOCK entries


def split_lists(index: DataFrame, clusters: int, replicates: int, seed: int) -> DataFrame:
    """The same by splitting, from the indices alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx = batch.column(0).to_numpy()
            leaf = idx // LEAF
            for number, draws in leaf_draws(np.unique(leaf).tolist(), clusters, replicates, seed):
                mine = idx[leaf == number]
                weights = leaf_weights(number, draws, clusters, seed)[:, mine % LEAF]
                for low in range(0, replicates, BLOCK):
                    part = weights[low:low + BLOCK].T
                    place = np.broadcast_to(np.arange(part.shape[1], dtype=np.int32), part.shape)
                    edges = np.concatenate([[0], np.cumsum(part.sum(axis=1))]).astype(np.int32)
                    drawn = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.repeat(place.ravel(), part.ravel())))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mine), pa.array(np.full(len(mine), low // BLOCK)), drawn], names=["idx", "block", "drawn"]
                    )

    return _by_leaf(index.select("idx").distinct()).mapInArrow(work, "idx long, block long, drawn array<int>")


def _weights(batch: pa.RecordBatch | pa.Table, name: str = "drawn") -> np.ndarray:
    """rows x BLOCK: how often each replicate of the row's block drew it."""
    lists = batch.column(name)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    place = np.repeat(np.arange(len(sizes)), sizes) * BLOCK + lists.flatten().to_numpy()
    return np.bincount(place, minlength=len(sizes) * BLOCK).reshape(-1, BLOCK)


def _group_id(columns: Sequence[str]):
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns]) if columns else F.lit(0).cast("long")


def weighted_sums(rows: DataFrame, lists: DataFrame, groups: Sequence[str], sums: Sequence[str], replicates: int) -> DataFrame:
    """(rep, groups, sums) for rows (idx, groups and whole numbers): the sums of
    every replicate. Each task adds up what it reads, so a group gives at most
    one row per replicate and task."""
    groups, sums = list(groups), list(sums)
    rows = rows.withColumn("__gid", _group_id(groups))
    names = rows.select("__gid", *groups).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (gid, block), total in held.items():
                rep = np.arange(block * BLOCK, min((block + 1) * BLOCK, replicates))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rep), gid)), pa.array(rep), *[pa.array(t[:len(rep)]) for t in total]], names=["__gid", "rep", *sums]
                )
            held.clear()

        for batch in batches:
            gid, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = np.stack([batch.column(3 + i).to_numpy() for i in range(len(sums))])
            weights = _weights(batch)
            order = np.lexsort((block, gid))
            cuts = np.flatnonzero((np.diff(gid[order]) != 0) | (np.diff(block[order]) != 0)) + 1
            for own in np.split(order, cuts) if len(order) else []:
                key = (int(gid[own[0]]), int(block[own[0]]))
                held[key] = held.get(key, 0) + values[:, own] @ weights[own]
            if len(held) > HELD:
                yield from given()
        yield from given()

    shape = "__gid long, rep long, " + ", ".join(f"{s} long" for s in sums)
    met = rows.join(lists, "idx").select("__gid", "block", "drawn", *[F.col(s).cast("long").alias(s) for s in sums])
    return (
        met.mapInArrow(work, shape).groupBy("__gid", "rep").agg(*[F.sum(s).alias(s) for s in sums])
        .join(names, "__gid").select("rep", *groups, *sums)
    )


def _picked(replicates: int, clusters: int, seed: int):
    """A task's part of the md5 draws: per replicate, piece of its draws and range
    of clusters the places in the range that were drawn, two bytes a draw."""
    pieces = -(-clusters // PIECE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rep, piece = divmod(number, pieces)
                drawn = md5_heads(f"{seed}|{rep}|", piece * PIECE, min((piece + 1) * PIECE, clusters)) % np.uint32(clusters)
                part = drawn // RANGE
                order = np.argsort(part, kind="stable") if clusters > RANGE else np.arange(len(drawn))
                parts, first = np.unique(part[order], return_index=True)
                places = np.split((drawn % RANGE).astype(np.uint16)[order], first[1:])
                yield pa.RecordBatch.from_arrays([
                    pa.array(parts.astype(np.int64)), pa.array(np.full(len(parts), rep // BLOCK)), pa.array(np.full(len(parts), rep)),
                    pa.array([p.tobytes() for p in places], pa.binary()),
                ], names=["part", "block", "rep", "places"])

    return work, replicates * pieces


def drawn_sums(rows: DataFrame, clusters: int, groups: Sequence[str], sums: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """``weighted_sums`` by the md5 draws, for any number of clusters: draws meet
    the rows (idx, groups and whole numbers; a few per cluster) by ranges of
    ``RANGE`` clusters and blocks of replicates. No list of draws is kept per row;
    what is shuffled is two bytes a draw, and a task holds one range's."""
    groups, sums = list(groups), list(sums)
    rows = rows.withColumn("__gid", _group_id(groups))
    names = rows.select("__gid", *groups).distinct()
    spark = rows.sparkSession
    work, count = _picked(replicates, clusters, seed)
    draws = spark.range(0, count, 1, min(count, 4 * parallelism(spark))).mapInArrow(work, "part long, block long, rep long, places binary")
    blocks = F.sequence(F.lit(0).cast("long"), F.lit((replicates - 1) // BLOCK).cast("long"))
    held = rows.select(
        F.expr(f"idx div {RANGE}").alias("part"), F.explode(blocks).alias("block"), "__gid", F.expr(f"cast(idx % {RANGE} AS int)").alias("place"),
        *[F.col(s).cast("long").alias(s) for s in sums],
    )

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("__gid")
        gid, place = left["__gid"].to_numpy(), left["place"].to_numpy()
        values = np.stack([left[s].to_numpy() for s in sums], axis=1) if len(gid) else np.zeros((0, len(sums)), np.int64)
        edges = np.flatnonzero(np.diff(gid)) + 1
        owns = np.split(np.arange(len(gid)), edges) if len(gid) else []
        rep, drawn = right["rep"].to_numpy(), right["places"]
        whole = np.abs(values).sum(axis=0, dtype=np.float64).max(initial=0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        wanted = np.unique(rep)
        for at in range(0, len(wanted), REPS_AT_ONCE):
            some = wanted[at:at + REPS_AT_ONCE]
            times = np.zeros((len(some), RANGE))
            for row in np.flatnonzero(np.isin(rep, some)).tolist():
                times[np.searchsorted(some, rep[row])] += np.bincount(np.frombuffer(drawn[row].as_buffer(), np.uint16), minlength=RANGE)
            exact = whole * times.max(initial=0) < 2**53  # doubles add up whole numbers below that exactly
            for own in owns:
                weights, mine = times[:, place[own]], values[own]
                total = (weights @ mine.astype(float)).astype(np.int64) if exact else weights.astype(np.int64) @ mine
                found.append((np.full(len(some), gid[own[0]]), some, total))
        if not found:
            return pa.table({c: pa.array([], pa.int64()) for c in ["__gid", "rep", *sums]})
        total = np.concatenate([f[2] for f in found])
        return pa.table([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), *total.T.copy()], names=["__gid", "rep", *sums])

    shape = "__gid long, rep long, " + ", ".join(f"{s} long" for s in sums)
    met = held.groupBy("part", "block").cogroup(draws.groupBy("part", "block")).applyInArrow(add_up, shape)
    return met.groupBy("__gid", "rep").agg(*[F.sum(s).alias(s) for s in sums]).join(names, "__gid").select("rep", *groups, *sums)


_SCANNED = "__gid long, cell long, block long, pos array<long>, neg array<long>, twice array<double>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gid, cell, block, score): per such group the weighted
    positives and negatives, and twice the pairs won inside it, by replicate.
    Equal scores are added up before they meet, also over the end of a batch."""
    key, pending, pos, neg, twice = None, None, None, None, None

    def settle() -> None:
        """The scores so far meet the negatives below them."""
        nonlocal pending
        if pending is not None:
            _, p, n = pending
            twice[:] += p * (2.0 * neg + n)
            pos[:] += p
            neg[:] += n
            pending = None

    def result() -> pa.RecordBatch:
        settle()
        arrays = [pa.array([k], pa.int64()) for k in key] + [pa.array([pos.tolist()]), pa.array([neg.tolist()]), pa.array([twice.tolist()])]
        return pa.RecordBatch.from_arrays(arrays, names=["__gid", "cell", "block", "pos", "neg", "twice"])

    for batch in (whole.slice(at, SCANNED_ROWS) for whole in batches for at in range(0, whole.num_rows, SCANNED_ROWS)):
        gid, cell, block, score, up, down = (batch.column(i).to_numpy() for i in range(6))
        weights = _weights(batch)
        change = np.flatnonzero((np.diff(gid) != 0) | (np.diff(cell) != 0) | (np.diff(block) != 0)) + 1
        for own in np.split(np.arange(len(gid)), change):
            now = (int(gid[own[0]]), int(cell[own[0]]), int(block[own[0]]))
            if now != key:
                if key is not None:
                    yield result()
                key, pending = now, None
                pos, neg, twice = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64), np.zeros(BLOCK)
            first = np.concatenate([[0], np.flatnonzero(np.diff(score[own]) != 0) + 1])
            ups = np.add.reduceat(up[own, None] * weights[own], first, axis=0)
            downs = np.add.reduceat(down[own, None] * weights[own], first, axis=0)
            if pending is not None:
                if pending[0] == score[own[0]]:
                    ups[0] += pending[1]
                    downs[0] += pending[2]
                    pending = None
                else:
                    settle()
            below = neg + np.cumsum(downs, axis=0) - downs
            twice += (ups[:-1] * (2.0 * below[:-1] + downs[:-1])).sum(axis=0)
            pos += ups[:-1].sum(axis=0)
            neg += downs[:-1].sum(axis=0)
            pending = (score[own[-1]], ups[-1], downs[-1])
    if key is not None:
        yield result()


def resampled_areas(indexed: DataFrame, lists: DataFrame, keys: Sequence[str], strata: Sequence[str], replicates: int) -> DataFrame:
    """(rep, keys, auc) of the score histogram ``indexed`` (idx, keys, strata,
    score, pos, neg): wins over pairs of positives and negatives of one stratum.

    A stratum is cut into ranges of the score; each range is scanned alone, and
    what it wins against lower ranges follows from their negatives."""
    keys, strata = list(keys), list(strata)
    placed = with_cell(indexed, "score").withColumn("__gid", _group_id([*keys, *strata])).withColumnRenamed(CELL, "cell")
    names = placed.select("__gid", *keys).distinct()
    met = placed.join(lists, "idx").select("__gid", "cell", "block", F.col("score").cast("double").alias("score"), "pos", "neg", "drawn")
    scanned = (
        met.repartition("__gid", "cell", "block").sortWithinPartitions("__gid", "cell", "block", "score").mapInArrow(_scan, _SCANNED)
    )
    each = scanned.select("__gid", "cell", "block", F.posexplode(F.arrays_zip("pos", "neg", "twice")).alias("at", "t")).select(
        "__gid", "cell", (F.col("block") * BLOCK + F.col("at")).alias("rep"), "t.*"
    ).where(F.col("rep") < replicates)
    lower = Window.partitionBy("__gid", "rep").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0)).cast("double")
    sums = each.withColumn("twice", F.col("twice") + 2.0 * F.col("pos").cast("double") * below).groupBy("__gid", "rep").agg(
        (F.sum("twice") / 2.0).alias("wins"), (F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("pairs")
    )
    return sums.join(names, "__gid").groupBy("rep", *keys).agg((F.sum("wins") / F.nullif(F.sum("pairs"), F.lit(0.0))).alias("auc"))
