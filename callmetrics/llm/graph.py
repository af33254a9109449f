"""Connected components of a link table, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from callmetrics.llm.common import Keep, scratch, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b", store=stored) -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest
    node of its component.

    Large-star and small-star in turn: every node's neighbours are tied to the
    smallest among them, first the larger ones, then the smaller ones, until
    the links no longer change. Minima are pre-aggregated, so a node with very
    many links costs one partial row per task; they meet the links again under
    a key of their own, so both sides of that join are plain shuffles, in which
    adaptive execution splits the links of such a node over tasks. A round is
    one job, written to the shared folder and removed when the next one is
    there; the number of rounds grows with the logarithm of the nodes. Null ends
    and links from a node to itself are left out. ``store`` writes the result."""
    with scratch(links.sparkSession) as keep:
        edges, mark = _marked(
            links.where(f"{a} <> {b}")
            .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), keep,
        )
        before = None
        while mark != before:
            before = mark
            edges, mark = _marked(_small_star(_large_star(edges)), keep)
            keep.drop(but=edges)
        stars = store(edges, "stars")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _marked(edges: DataFrame, keep: Keep) -> tuple[DataFrame, tuple]:
    """The stored links, and their number and sum of hashes, counted as they are written."""
    seen = Observation()
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    table = keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("h")), "round")
    return table, (seen.get["n"], seen.get["h"])


def _least(links: DataFrame) -> DataFrame:
    """(w, m): each node's least neighbour. The node is the same number written
    otherwise, so that the join deals it anew instead of keeping a node's links together."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not(F.bitwise_not("u")).alias("w"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.union(edges.select("v", "u"))
    return (
        both.where("v > u").join(_least(both), F.col("u") == F.col("w"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = _least(edges)
    return (
        edges.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        .union(least.select("w", "m")).distinct()
    )
