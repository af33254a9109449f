"""Mixing sources to target weights by cube-method sampling (operator 6).

A document's size is its number of words. The sources in code-point order (null
last) weigh 3, 1, 2 and so on in turn and share ``GROWTH`` times all words. A
target stops at ``MOST`` times its source's words; what is over goes to the
others by weight until none is above. So every document of a source is taken
``rate`` = target / words times: whole copies for certain, and one more with
the fraction as inclusion probability.

The cube method draws those so that both totals keep their expectation. In the
flight phase three documents at a time move along the null space of the two
constraints (documents, words) until one of them is decided. At most two per
block stay open. The open ones of many blocks form the blocks of the next
round, until each source has one block. There ``HELD`` documents, spread evenly
over the sizes, wait; together with the two that stay open they are the landing
problem: all outcomes are tried and the one closest in words, then in
documents, is taken.

A block has about ``BLOCK`` rows whatever the size of its source, and its random
numbers follow from its name, so reruns agree and lost tasks repeat themselves.
Sizes and decisions travel, texts do not.

Null and empty texts have size 0 and are taken 0 times. A source without words
has target 0. Repeated rows are documents of their own. The totals per source
(one row each) are the only thing that comes to the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.llm.common import WORD_PATTERN, stored, table

WEIGHTS = (3, 1, 2)
GROWTH = 1.5
MOST = 2.0
BLOCK = 4096
HELD = 10


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, growth: float = GROWTH, most: float = MOST) -> list[float]:
    """Words to take of each source, in the order of the sources."""
    share = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    rest, found = growth * sum(sizes), [0.0] * len(sizes)
    open_ones = set(range(len(sizes)))
    while open_ones:
        whole = sum(share[i] for i in open_ones)
        above = {i for i in open_ones if rest * share[i] / whole > most * sizes[i]}
        if not above:
            for i in open_ones:
                found[i] = rest * share[i] / whole
            break
        for i in sorted(above):
            found[i] = most * sizes[i]
            rest -= found[i]
        open_ones -= above
    return found


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities (in the given order) until at most two are open,
    keeping their sum and their sum of sizes."""
    chance = chance.astype(float).tolist()
    size = size.astype(float).tolist()
    draws = rng.random(len(chance) + 1).tolist()
    active: list[int] = []
    for number, draw in zip(range(len(chance) + 1), draws):
        while len(active) == 3:
            a, b, c = active
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - chance[i]) / s if s > 0 else chance[i] / -s for i, s in zip(active, u) if s)
            down = min(chance[i] / s if s > 0 else (1 - chance[i]) / -s for i, s in zip(active, u) if s)
            step = up if draw * (up + down) < down else -down
            moved = []
            for i, s in zip(active, u):
                value = chance[i] + step * s
                value = 0.0 if value < 1e-9 else 1.0 if value > 1 - 1e-9 else value
                chance[i] = value
                if 0.0 < value < 1.0:
                    moved.append(i)
            active = moved
        if number < len(chance) and 0.0 < chance[number] < 1.0:
            active.append(number)
    return np.array(chance)


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last open documents: the outcome nearest in words, then in number."""
    still = np.flatnonzero((chance > 0) & (chance < 1))
    outcomes = (np.arange(1 << len(still))[:, None] >> np.arange(len(still))) & 1
    apart = outcomes - chance[still]
    best = np.lexsort((np.abs(apart.sum(axis=1)), np.abs(apart @ size[still])))[0]
    decided = chance.copy()
    decided[still] = outcomes[best]
    return decided


_ROWS = "doc_id long, size long, source string, chance double, block long, last boolean"


def _fly(level: int):
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        source = rows["source"].iloc[0]
        name = zlib.crc32(("-" if source is None else "=" + source).encode())
        rng = np.random.default_rng([name, int(rows["block"].iloc[0]), level])
        size = rows["size"].to_numpy(np.float64)
        chance = rows["chance"].to_numpy(np.float64).copy()
        moving = np.ones(len(rows), bool)
        if rows["last"].iloc[0]:
            moving[np.linspace(0, np.count_nonzero(size) - 1, HELD).astype(int)] = False
        chance[moving] = flight(chance[moving], size[moving], rng)
        if rows["last"].iloc[0]:
            chance = landing(chance, size)
        return rows.assign(chance=chance)

    return fly


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, growth: float = GROWTH, most: float = MOST, block_rows: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    totals = [tuple(r) for r in sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()]
    totals.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    wanted = targets([r[1] for r in totals], weights, growth, most)
    plan = spark.createDataFrame(
        [(s, words, goal, goal / words if words else 0.0, -(-rows // block_rows)) for (s, words, rows), goal in zip(totals, wanted)],
        "name string, source_size long, target double, rate double, blocks long",
    )
    placed = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name"))).drop("name")  # one row per source
    whole = F.floor("rate")
    rows = placed.select(
        "doc_id", "size", "source", (F.col("rate") - whole).alias("chance"),
        F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("blocks")).alias("block"), (F.col("blocks") == 1).alias("last"),
    )
    decided, level = [], 0
    blocks = max([-(-r[2] // block_rows) for r in totals], default=1)
    while True:
        moved = stored(rows.groupBy("source", "block").applyInPandas(_fly(level), _ROWS), "moved")
        settled = F.col("chance").isin(0.0, 1.0)
        decided.append(moved.where(settled))
        if blocks <= 1:
            break
        # The next round joins the open ones of block_rows / 2 blocks.
        blocks = -(-blocks // (block_rows // 2))
        rows = moved.where(~settled).select(
            "doc_id", "size", "source", "chance", F.floor(F.col("block") / (block_rows // 2)).alias("block"), F.lit(blocks == 1).alias("last")
        )
        level += 1
    drawn = decided[0]
    for part in decided[1:]:
        drawn = drawn.unionByName(part)
    return (
        drawn.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name")))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("size") * (F.floor("rate") + F.col("chance").cast("long"))).alias("taken"),
        )
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see the module for the method."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
