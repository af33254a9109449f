"""Positions in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.common import fresh, stored
from callmetrics.session import parallelism


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with the column ``name``: 1 for the first in ``order``, and so on.

    Rows are dealt into as many ranges of the order as there are shuffle
    partitions, each range is sorted alone and numbered, and the ranges' sizes,
    one number each on the driver, say where each begins. Rows that are equal in
    ``order`` follow each other in any order; the input partition is the last
    key, so that even a third of all rows that are equal are cut into ranges.
    Give narrow columns only: rows are written twice and shuffled once."""
    part, at, start = (fresh(rows, n) for n in ("input_part", "place_at", "place_start"))
    spark = rows.sparkSession
    base = stored(rows.withColumn(part, F.spark_partition_id()), "unplaced")
    ranged = stored(
        base.repartitionByRange(max(1, parallelism(spark)), *order, F.col(part)).sortWithinPartitions(*order, F.col(part))
        .withColumn(at, F.monotonically_increasing_id()).drop(part),
        "placed",
    )
    which = F.shiftright(at, 33)  # the range, above the row's number within it
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(which.alias("w")).count().collect())
    starts, before = [], 0
    for found, size in sizes:
        starts.append((found, before))
        before += size
    begins = spark.createDataFrame(starts, f"{part} long, {start} long")
    return (
        ranged.withColumn(part, which).join(F.broadcast(begins), part)  # one row per range
        .withColumn(name, F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1) + 1)
        .drop(part, at, start)
    )
