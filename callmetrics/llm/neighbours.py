"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 12).

Index. ``TABLES`` tables; in each, a vector's bucket is the row of whole numbers
floor((a.x + b) / w) over some Gaussian directions a. Near vectors differ by
little along every direction, so a near one is in the query's bucket or in one
that is perturbed by a step in some coordinates. Along one direction a
neighbour at distance r differs by a normal deviate of spread r, which gives
each step's probability; buckets are visited in the order of their product
until the visited ones hold a neighbour, by this estimate, with the probability
``SUCCESS`` over all tables. What the tables propose is merged, and distances
are exact: square root of the summed squares of differences, in doubles.

Fit. A sample of about ``SAMPLE`` distinct vectors, chosen by hash, gives r (the
``SPREAD`` quantile of distances to the k-th neighbour, carried on to all rows
by the sample's own rate of growth), w and the number of directions: enough for
``CELL_ROWS`` rows a bucket, but so few that a query visits ``PROBES`` buckets of
a table on average. All rows are indexed.

At scale. Equal vectors are one entry, with the k + 1 smallest ids that have it
(a further copy can't be among the k nearest), so a vector that a third of all
rows share is no hot bucket. A bucket beyond ``BLOCK_ROWS`` entries, or the
mean number of a shard, is cut into blocks, and a query that visits it meets each of them: nothing is dropped.
Entries are dealt to shards once per table; a query goes to a shard once, with
the list of the blocks it visits there, and leaves its k + 1 nearest. Pairs of
query and candidate are never rows. Queries are 1 in 100 rows and stream past a
shard's entries in batches. A query for which fewer than k neighbours were found
(an outlier) is compared with all rows in blocks, exactly.

Vectors that are null, zero, or hold null or non-finite components, rows without
an id and vectors of another length than the most frequent one (the longer of
two) take no part. A row repeated with id and vector counts once; an id with
several vectors is a query and a candidate for each. Equal distances go to the
smaller id. Fewer than k candidates are all returned; an empty table, or one
without queries, gives no rows. Columns of other names are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from callmetrics.llm.common import stored, table
from callmetrics.llm.kernels import mix
from callmetrics.session import parallelism

NEIGHBOURS = 10
TABLES = 4
SUCCESS = 0.95
SPREAD = 0.9
WIDTH = 2.25  # of a bucket, in r
SAMPLE = 2048
CELL_ROWS = 512
PROBES = 128
BLOCK_ROWS = 4096
SHARD_ROWS = 32_768
QUERIES_AT_ONCE = 256
HELD = 1 << 20  # candidates held before they are trimmed
REACH = 2  # steps to either side in a coordinate

_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRID = np.linspace(-8, 8, 8001)
_BELOW = np.array([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in _GRID])
_OFFSETS = np.arange(-REACH, REACH + 1)


@dataclass(frozen=True)
class Index:
    """Directions (dimensions x tables*keys), shifts in buckets, and scales."""

    directions: np.ndarray
    shifts: np.ndarray
    keys: int  # directions of a table
    width: float
    radius: float

    @property
    def tables(self) -> int:
        return len(self.shifts) // max(1, self.keys) if self.keys else 1

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Per vector, table and direction: the place, in buckets."""
        at = vectors @ self.directions / self.width + self.shifts
        return at.reshape(len(vectors), self.tables, self.keys)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Per vector and table: the key of its bucket."""
        cells = np.floor(self.places(vectors)).astype(np.int64)
        keys = self._first(len(vectors))
        for i in range(self.keys):
            keys = _next(keys, cells[:, :, i])
        return keys

    def _first(self, rows: int) -> np.ndarray:
        return np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64), (rows, self.tables))

    def probes(self, vectors: np.ndarray, success: float = SUCCESS) -> list[np.ndarray]:
        """Per vector: the keys of the buckets to visit, each table's in the order of estimated success."""
        enough = 1 - (1 - success) ** (1 / self.tables)
        at = self.places(vectors).reshape(len(vectors) * self.tables, self.keys)
        first = self._first(len(vectors)).reshape(-1)
        found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(at)
        rest, most = np.arange(len(at)), 4 * PROBES
        while len(rest):
            left = []
            for own in np.array_split(rest, max(1, len(rest) * most // (1 << 18))):
                keys, chance = self._likeliest(at[own], first[own], most)
                total = np.cumsum(chance, axis=1)
                whole = chance.shape[1] >= len(_OFFSETS) ** self.keys  # there are no more
                count = np.sum(total < enough, axis=1) + 1
                for row, n, k in zip(own.tolist(), count.tolist(), keys):
                    if n <= len(k) or whole:
                        found[row] = k[:n]
                    else:
                        left.append(row)
            rest, most = np.array(left, np.int64), most * 4
        return [np.concatenate(found[i:i + self.tables]) for i in range(0, len(found), self.tables)]

    def _likeliest(self, at: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and probabilities of the likeliest buckets, in order. A bucket
        among the first n has a prefix among the first n, so n are kept on the way."""
        keys, chance = first[:, None], np.ones((len(at), 1))
        cells = np.floor(at).astype(np.int64)[:, :, None] + _OFFSETS
        scale = self.width / self.radius
        below = np.interp((np.concatenate([cells, cells[:, :, -1:] + 1], axis=2) - at[:, :, None]) * scale, _GRID, _BELOW)
        steps = np.diff(below, axis=2)
        for i in range(self.keys):
            chance = (chance[:, :, None] * steps[:, None, i]).reshape(len(at), -1)
            keys = _next(keys[:, :, None], cells[:, None, i]).reshape(len(at), -1)
            if chance.shape[1] > most:
                best = np.argpartition(-chance, most - 1, axis=1)[:, :most]
                chance, keys = np.take_along_axis(chance, best, 1), np.take_along_axis(keys, best, 1)
        order = np.argsort(-chance, axis=1, kind="stable")
        return np.take_along_axis(keys, order, 1), np.take_along_axis(chance, order, 1)


def _next(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return mix(keys * _STEP + cells.astype(np.int64).view(np.uint64))


def fit(sample: np.ndarray, rows: int, k: int = NEIGHBOURS, tables: int = TABLES, seed: int = 12) -> Index:
    """Directions and scales for ``rows`` distinct vectors like the sampled ones."""
    rng, (n, dimensions) = np.random.default_rng(seed), sample.shape
    none = Index(np.zeros((dimensions, 0)), np.zeros(0), 0, 1.0, 1.0)
    if n < 32 or rows <= CELL_ROWS:
        return none  # one bucket
    squares = (sample**2).sum(axis=1)
    nearest = []
    for at in range(0, n, 256):
        apart = squares[at:at + 256, None] + squares - 2 * sample[at:at + 256] @ sample.T
        apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = np.inf
        nearest.append(np.sqrt(np.maximum(np.partition(apart, 16, axis=1)[:, :16], 0)))
    nearest = np.sort(np.concatenate(nearest), axis=1)
    wanted = k * n / rows  # the k-th neighbour among all is this one in the sample
    radius = float(np.quantile(nearest[:, min(15, max(0, math.ceil(wanted) - 1))], SPREAD))
    if wanted < 1:  # beyond what the sample shows: distances grow as a power of the rank
        near, far = np.median(nearest[:, 0]), np.median(nearest[:, 15])
        rate = math.log(far / near) / math.log(16) if 0 < near < far else 0.0
        radius *= wanted**rate
    if not radius > 0:
        return none
    width, most = WIDTH * radius, 64
    directions, shifts = rng.standard_normal((dimensions, tables, most)), rng.random((tables, most))
    cells = np.floor(sample @ directions[:, 0] / width + shifts[0])
    same = np.mean([np.sum((np.unique(c, return_counts=True)[1] / n) ** 2) for c in cells.T])
    keys = most if same >= 1 else min(most, math.ceil(math.log(rows / CELL_ROWS) / -math.log(same)))

    def index(keys: int) -> Index:
        return Index(directions[:, :, :keys].reshape(dimensions, -1), shifts[:, :keys].reshape(-1), keys, width, radius)

    tried = sample[rng.choice(n, min(n, 64), replace=False)]
    low, high = 0, keys  # the most directions whose probes stay within the mean
    while low < high:
        middle = (low + high + 1) // 2
        visits = _visits(index(middle), tried)
        low, high = (middle, high) if visits <= PROBES else (low, middle - 1)
    return index(low) if low else none


def _visits(index: Index, vectors: np.ndarray) -> float:
    """Mean number of buckets of a table that a query visits; infinity when far too many."""
    at = index.places(vectors).reshape(len(vectors) * index.tables, index.keys)
    chance = index._likeliest(at, index._first(len(vectors)).reshape(-1), 8 * PROBES)[1]
    enough = 1 - (1 - SUCCESS) ** (1 / index.tables)
    count = np.sum(np.cumsum(chance, axis=1) < enough, axis=1) + 1
    return float(np.mean(count)) if np.all(count <= 8 * PROBES) else math.inf


def _matrix(vectors: pa.Array) -> np.ndarray:
    """All of one length, without nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _lists(values: list[np.ndarray]) -> pa.Array:
    edges = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.view(np.int64)))


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per shard: entries first, sorted by block, then queries with the blocks they visit."""
    shard, held, entries = None, [], None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        shards, kinds = rows["shard"].to_numpy(), rows["kind"].to_numpy()
        cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(rows)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if shards[a] != shard:
                shard, held, entries = shards[a], [], None
            part = rows.slice(a, b - a)
            if kinds[a] == 0:
                held.append(part)
                continue
            if entries is None and held:
                entries, held = _Entries(pa.concat_tables(held)), []
            if entries is not None:
                for at in range(0, len(part), QUERIES_AT_ONCE):
                    yield from entries.nearest(part.slice(at, QUERIES_AT_ONCE), k)


class _Entries:
    """The vectors of a shard, by block."""

    def __init__(self, rows: pa.Table):
        self.h1, self.h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
        self.vectors = _matrix(rows["embedding"].combine_chunks())
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        cells = rows["cells"].combine_chunks().flatten().to_numpy()
        order = np.argsort(cells, kind="stable")
        if not np.array_equal(order, np.arange(len(order))):
            self.h1, self.h2, self.vectors, self.squares, cells = (x[order] for x in (self.h1, self.h2, self.vectors, self.squares, cells))
        self.cells, first = np.unique(cells, return_index=True)
        self.edges = np.append(first, len(cells))

    def nearest(self, queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
        """The k nearest visited entries of every query, and those as near as the last."""
        vectors = _matrix(queries["embedding"].combine_chunks())
        squares = np.einsum("ij,ij->i", vectors, vectors)
        visits = queries["cells"].combine_chunks()
        flat, query = visits.flatten().to_numpy(), np.repeat(np.arange(len(queries)), visits.value_lengths().to_numpy())
        at = np.minimum(np.searchsorted(self.cells, flat), len(self.cells) - 1)
        there = self.cells[at] == flat
        at, query = at[there], query[there]
        order = np.argsort(at, kind="stable")
        at, query = at[order], query[order]
        limit = np.full(len(queries), np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
            if not len(own):
                continue
            a, b = self.edges[at[own[0]]], self.edges[at[own[0]] + 1]
            q = query[own]
            apart = squares[q, None] + self.squares[a:b] - 2 * (vectors[q] @ self.vectors[a:b].T)
            i, j = np.nonzero(apart <= limit[q, None])
            found.append((q[i], a + j, apart[i, j]))
            held += len(i)
            if held > HELD:
                found = [self._trimmed(found, limit, squares, k)]
                held = len(found[0][0])
        if found:
            q, e, _ = self._trimmed(found, limit, squares, k)
            apart = np.sqrt(((vectors[q] - self.vectors[e]) ** 2).sum(axis=1))
            q1, q2 = queries["h1"].to_numpy()[q], queries["h2"].to_numpy()[q]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (q1, q2, self.h1[e], self.h2[e], apart)], names=["q1", "q2", "h1", "h2", "score"]
            )

    def _trimmed(self, found: list[tuple[np.ndarray, ...]], limit: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Candidates up to each query's k-th distance, with room for rounding; ``limit`` is lowered to it."""
        q, e, apart = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((apart, q))
        q, e, apart = q[order], e[order], apart[order]
        begins = np.searchsorted(q, np.arange(len(limit)))
        last = begins + k - 1
        full = last < np.append(begins[1:], len(q))
        limit[full] = apart[last[full]] + 1e-9 * (squares[full] + np.abs(apart[last[full]]))
        near = apart <= limit[q]
        return q[near], e[near], apart[near]


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, h1, h2) of the rows that take part; h1 and h2 hash the vector."""
    fine = vectors.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    length = fine.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return fine.where(F.size("embedding") == (length.n if length else 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding",
        F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2"),
    )


def _met(entries: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """(q1, q2, h1, h2, score): what every shard has found, one row per query and entry."""
    columns = ["shard", "kind", "h1", "h2", "embedding", "cells"]
    both = entries.withColumn("kind", F.lit(0)).select(*columns).union(queries.withColumn("kind", F.lit(1)).select(*columns))
    return (
        both.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind")
        .mapInArrow(lambda batches: _search(batches, k), "q1 long, q2 long, h1 long, h2 long, score double")
        .groupBy("q1", "q2", "h1", "h2").agg(F.min("score").alias("score"))
    )


def _best(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(h1, h2, nearest) per query: its k nearest (score, vec_id, own), where own
    says that the candidate has the query's very vector."""
    by = Window.partitionBy("q1", "q2")
    return (
        found.withColumn("r", F.rank().over(by.orderBy("score"))).where(F.col("r") <= k)
        .join(members, ["h1", "h2"])
        .withColumn("own", (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
        .select("q1", "q2", "score", "own", F.explode("ids").alias("vec_id"))
        .withColumn("r", F.row_number().over(by.orderBy("score", "vec_id"))).where(F.col("r") <= k)
        .groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2"))
        .agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "own"))).alias("nearest"))
    )


def nearest(vectors: DataFrame, asked: Column, k: int = NEIGHBOURS, tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for
    which ``asked`` (over vec_id) is true, among all other rows."""
    usable = _usable(vectors.select("vec_id", "embedding"))
    known = stored(usable.select("vec_id", "h1", "h2").distinct(), "ids")
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = stored(
        known.withColumn("r", first).where(F.col("r") <= k + 1)
        .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "members",
    )
    # Equal vectors are one row from here on; tasks collapse copies before the shuffle.
    distinct = stored(usable.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")), "distinct")
    rows = distinct.count()
    share = min(1.0, SAMPLE / max(1, rows))
    drawn = distinct if share == 1 else distinct.where((F.col("h1") / 2.0**64 + 0.5) < share)  # about SAMPLE rows
    sample = np.array([r[0] for r in drawn.select("embedding").orderBy("h1", "h2").collect()], np.float64)
    index = fit(sample, rows, k, tables) if len(sample) else Index(np.zeros((0, 0)), np.zeros(0), 0, 1.0, 1.0)

    @F.arrow_udf(ArrayType(LongType()))
    def bucket(embedding: pa.Array) -> pa.Array:
        return _lists(list(index.buckets(_matrix(embedding)))) if len(embedding) else _lists([])

    @F.arrow_udf(ArrayType(LongType()))
    def probe(embedding: pa.Array) -> pa.Array:
        return _lists(index.probes(_matrix(embedding))) if len(embedding) else _lists([])

    entries = stored(distinct.withColumn("keys", bucket(F.col("embedding"))), "index")
    keyed = entries.select("h2", F.explode("keys").alias("key"))
    shards = max(parallelism(vectors.sparkSession), math.ceil(rows * index.tables / SHARD_ROWS), 1)
    block_rows = max(1, min(BLOCK_ROWS, rows * index.tables // shards))  # no block is more than a mean shard
    sizes = stored(keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")), "buckets")

    def cell(block: Column) -> Column:
        return F.xxhash64("key", block)

    def shard(cell: str) -> Column:
        return F.pmod(F.col(cell), F.lit(shards))

    dealt = (
        entries.select("h1", "h2", "embedding", F.explode("keys").alias("key"))
        .join(sizes.where("blocks > 1"), "key", "left")
        .withColumn("cell", cell(F.pmod(F.col("h1"), F.coalesce("blocks", F.lit(1)))))
        .select(shard("cell").alias("shard"), "h1", "h2", "embedding", F.array("cell").alias("cells"))
    )
    queries = known.where(asked)
    asking = stored(distinct.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi"), "asking")
    visited = (
        asking.select("h1", "h2", F.explode(probe(F.col("embedding"))).alias("key"))
        .join(sizes, "key")  # buckets that are empty need no visit
        .withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), cell)))
        .groupBy(shard("cell").alias("shard"), "h1", "h2").agg(F.collect_list("cell").alias("cells"))
    )
    found = _met(dealt, visited.join(asking, ["h1", "h2"]), shards, k + 1)
    best = stored(_best(found, members, k + 1), "best")

    least = min(k + 1, known.count())
    short = asking.join(best.where(F.size("nearest") >= least), ["h1", "h2"], "left_anti")
    if not short.isEmpty():  # outliers: all rows, in blocks
        every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
        block = F.pmod(F.col("h1"), F.lit(shards))
        again = _met(
            distinct.select(block.alias("shard"), "h1", "h2", "embedding", F.array(block).alias("cells")),
            short.select("h1", "h2", "embedding", F.explode(every).alias("shard")).withColumn("cells", F.array("shard")),
            shards, k + 1,
        )
        best = best.where(F.size("nearest") >= least).union(_best(again, members, k + 1))
    others = F.slice(F.filter("nearest", lambda x: ~(x.own & (x.vec_id == F.col("query_id")))), 1, k)
    return (
        queries.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best, ["h1", "h2"])
        .select("query_id", F.posexplode(others).alias("at", "n"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "n.vec_id", "n.score")
    )


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
