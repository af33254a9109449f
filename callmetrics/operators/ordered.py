"""Ordered computations over groups of any size.

A window without a partition, or one partition holding a third of the rows,
runs in one task. Here the order key is cut into about as many ranges as there
are shuffle partitions. Each (group, range) cell is ordered on its own, and the
cells' totals -- at most one row per group and range -- carry the running
state from one range to the next. The split points are plain numbers on the
driver (fewer than the partitions), so both passes agree on every cell even
when tasks are recomputed.

Nulls are values like any other: a null group column makes a group, and rows
with a null key come first in theirs, in a range of their own. Cells are joined
on the group columns with nulls filled, a bit mask of the nulls, and the range;
the windows are over the same columns, so the join's shuffle serves them too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmetrics.session import materialize, parallelism

CELL = "__cell"
NULLS = "__nulls"
MERGE_TASKS = 64


def _quantile_points(df: DataFrame, key: str, ranges: int) -> tuple[list[float], bool]:
    """Approximate quantiles, repeated for frequent values, and whether any
    row has no key."""
    probabilities = [i / ranges for i in range(1, ranges)] or [0.5]
    accuracy = max(1000, 10 * ranges)
    # Summaries are merged in many tasks before one merges those; the points
    # only place the cuts, no row depends on how exact they are.
    parts = (
        df.select(F.col(key).cast("double").alias("k"), F.pmod(F.spark_partition_id(), F.lit(MERGE_TASKS)).alias("t"))
        .groupBy("t").agg(F.percentile_approx("k", probabilities, accuracy).alias("p"), F.max(F.col("k").isNull()).alias("gaps"))
        .select(F.explode_outer("p").alias("k"), "gaps")
    )
    row = parts.agg(F.percentile_approx("k", probabilities, accuracy), F.max("gaps")).first()
    return (sorted(row[0] or []) if ranges > 1 else []), bool(row[1])


def split_points(df: DataFrame, key: str, ranges: int) -> list[float]:
    """Approximate quantiles of a numeric key; fewer than ``ranges`` numbers."""
    return sorted(set(_quantile_points(df, key, ranges)[0]))


def uniform_points(low: float, high: float, ranges: int) -> list[float]:
    """Even split points for a key known to be spread evenly, such as a hash."""
    return [low + (high - low) * i / ranges for i in range(1, ranges)]


def _range_number(df: DataFrame, key: str, points: Sequence[float], name: str) -> DataFrame:
    inf = float("inf")
    cutter = Bucketizer(
        splits=[-inf, *points, inf] if points else [-inf, 0.0, inf],
        inputCol="__key", outputCol="__range", handleInvalid="keep",
    )
    numeric = df.withColumn("__key", F.col(key).cast("double"))
    return (
        cutter.transform(numeric)
        .withColumn(name, F.when(F.col("__key").isNull(), -1).otherwise(F.col("__range")).cast("bigint"))
        .drop("__key", "__range")
    )


def with_cell(
    df: DataFrame, key: str, points: Sequence[float] | None = None, tie: str | None = None
) -> DataFrame:
    """Add the range number of ``key``. The cast to double keeps the order.

    A key value so frequent that it fills more than one range gets a range of
    its own, which is cut further by the numeric tie column, if there is one,
    and so are the rows without a key. The tie column must then be the second
    order column."""
    ranges = parallelism(df.sparkSession)
    heavy: list[float] = []
    gaps = points is not None  # not known: looked for by the tie's own quantiles
    if points is None:
        found, gaps = _quantile_points(df, key, ranges)
        points = sorted(set(found))
        if tie is not None:
            heavy = [p for p, n in Counter(found).items() if n > 1]
            points = sorted({*points, *[math.nextafter(p, math.inf) for p in heavy]})
    cells = _range_number(df, key, points, CELL)
    if tie is None or not (heavy or gaps):
        return cells
    crowded = F.col(key).isNull()
    if heavy:
        crowded = crowded | F.coalesce(F.col(key).cast("double").isin(heavy), F.lit(False))
    tie_points = split_points(df.where(crowded), tie, ranges)
    stride = len(tie_points) + 3
    return (
        _range_number(cells, tie, tie_points, "__sub")
        .withColumn(CELL, F.col(CELL) * stride + F.when(crowded, F.col("__sub") + 1).otherwise(0))
        .drop("__sub")
    )


def _keyed(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds the columns that name a cell, none of which is ever null."""
    kinds = dict(df.dtypes)
    filled, mask = {}, F.lit(0).cast("bigint")
    for i, group in enumerate(groups):
        column = F.col(group)
        if kinds[group] == "string":
            filled[f"__g{i}"] = F.coalesce(column, F.lit(""))
        elif kinds[group] in ("bigint", "int", "double"):
            filled[f"__g{i}"] = F.coalesce(column, F.lit(0).cast(kinds[group]))
        else:
            filled[f"__g{i}"] = F.coalesce(column.cast("string"), F.lit(""))
        mask = mask + F.when(column.isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return df.withColumns({**filled, NULLS: mask}), [*filled, NULLS, CELL]


def _join_cells(cells: DataFrame, totals: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with the values of their cell, and the columns that name it."""
    left, keys = _keyed(cells, groups)
    right, _ = _keyed(totals, groups)
    return left.join(right.drop(*groups), keys), keys


def _group_window(groups: Sequence[str]):
    # Over cell totals only: at most one row per range and group.
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def prefix_sums(
    df: DataFrame,
    key: str,
    sums: dict[str, str],
    groups: Sequence[str] = (),
    order: Sequence[Column | str] | None = None,
    points: Sequence[float] | None = None,
    totals: dict[str, str] | None = None,
    tie: str | None = None,
    minima: dict[str, str] | None = None,
) -> DataFrame:
    """Add, per output name in ``sums``, the sum of its column over all rows of
    the group that come strictly before the row. ``order`` (default: the key)
    must be total and begin with the key. ``totals`` and ``minima`` add
    whole-group sums and minima, read from the same cell totals."""
    totals, minima = totals or {}, minima or {}
    groups = list(groups)
    cells = with_cell(df, key, points, tie)
    per_cell = cells.groupBy(*groups, CELL).agg(
        *[F.sum(column).alias(f"__t_{name}") for name, column in {**sums, **totals}.items()],
        *[F.min(column).alias(f"__t_{name}") for name, column in minima.items()],
    )
    before = _group_window(groups).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(
        *groups, CELL,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(_group_window(groups)).alias(n) for n in totals],
        *[F.min(f"__t_{n}").over(_group_window(groups)).alias(n) for n in minima],
    )
    joined, keys = _join_cells(cells, offsets, groups)
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*(order or [key]))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for name, column in sums.items():
        joined = joined.withColumn(
            name, F.col(f"__o_{name}") + F.coalesce(F.sum(column).over(inside), F.lit(0))
        )
    return joined.drop(*keys, *[f"__o_{n}" for n in sums])


def ranked(
    df: DataFrame,
    key: str,
    groups: Sequence[str] = (),
    order: Sequence[Column | str] | None = None,
    name: str = "rank",
    points: Sequence[float] | None = None,
    tie: str | None = None,
    size: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, and on request its size."""
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    totals = {size: "__one"} if size else None
    return prefix_sums(one, key, {name: "__one"}, groups, order, points, totals, tie).drop("__one")


def lagged(
    df: DataFrame,
    key: str,
    columns: dict[str, str],
    groups: Sequence[str] = (),
    order: Sequence[Column | str] | None = None,
    points: Sequence[float] | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Add the previous row's values: ``columns`` maps output name to column."""
    groups, order = list(groups), list(order or [key])
    cells = with_cell(df, key, points, tie)
    last = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    # A struct is never null, so rows with a null key count here too.
    ends = cells.groupBy(*groups, CELL).agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), last).alias("__end")
    )
    carried = ends.select(
        *groups, CELL, F.lag("__end").over(_group_window(groups).orderBy(CELL)).alias("__carry")
    )
    joined, keys = _join_cells(cells, carried, groups)
    inside = Window.partitionBy(*keys).orderBy(*order)
    joined = joined.withColumn("__first", F.row_number().over(inside) == 1)
    for name, column in columns.items():
        joined = joined.withColumn(
            name,
            F.when(F.col("__first"), F.col(f"__carry.{name}")).otherwise(
                F.lag(column).over(inside)
            ),
        )
    return joined.drop(*keys, "__carry", "__first")


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value; the reduction every ordered statistic starts from."""
    return df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles, linear between neighbours, without holding a group's
    values in one task: positions are read from running counts."""
    groups = list(groups)
    values = df.select(*groups, F.col(value).cast("double").alias("v"))
    # Stored once: the counts are read for the ranges, their totals and the
    # ranks. Missing values count nothing, but keep a group that has no others:
    # its size is 0 and its quantiles are null.
    counts = materialize(value_counts(values, "v", groups)).withColumn(
        "n", F.when(F.col("v").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n"))
    )
    placed = prefix_sums(counts, "v", {"below": "n"}, groups, totals={"total": "n"})
    picks = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("total") - 1)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col("v"))).alias(f"__{side}_{name}"))
        picks.append(F.max(position - F.floor(position)).alias(f"__f_{name}"))
    found = placed.groupBy(*groups).agg(F.max("total").alias("n"), *picks)
    return found.select(
        *groups, "n",
        *[
            (
                F.col(f"__lo_{p}")
                + (F.col(f"__hi_{p}") - F.col(f"__lo_{p}")) * F.col(f"__f_{p}")
            ).alias(p)
            for p in probabilities
        ],
    )


def first_k(
    df: DataFrame,
    key: str,
    k: Column,
    groups: Sequence[str] = (),
    order: Sequence[Column | str] | None = None,
    points: Sequence[float] | None = None,
    quota: str | None = None,
) -> DataFrame:
    """The k first rows of each group; ``k`` may use the group's ``size`` and,
    given a 0/1 column ``quota``, its sum over the group as ``quota``.
    Ranges that begin at or after k are dropped before anything is shuffled for
    ordering, so the cost follows k and not the group."""
    groups = list(groups)
    cells = with_cell(df, key, points)
    marks = [F.sum(quota).alias("__q")] if quota else []
    sizes = cells.groupBy(*groups, CELL).agg(F.count(F.lit(1)).alias("__n"), *marks)
    before = _group_window(groups).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups, CELL, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"),
        F.sum("__n").over(_group_window(groups)).alias("size"),
        *([F.sum("__q").over(_group_window(groups)).alias("quota")] if quota else []),
    ).where(F.col("__o") < k)
    joined, keys = _join_cells(cells, offsets, groups)
    inside = Window.partitionBy(*keys).orderBy(*(order or [key]))
    placed = joined.withColumn("rank", F.col("__o") + F.row_number().over(inside) - 1)
    return placed.where(F.col("rank") < k).drop(*keys, "__o")
