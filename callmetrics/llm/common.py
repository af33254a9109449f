"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.session import work_path

Query = Callable[[SparkSession, str], DataFrame]

# Rows of whole texts that a Python worker holds at once.
BATCH_ROWS = 1024

# Words: runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session that hands whole texts to Python in batches
    of at most ``BATCH_ROWS`` rows (a smaller setting stays), so that a worker's
    memory does not follow Spark's default of 10,000 rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once below the shared folder and read back: lineage ends there, so
    lost executors cost no recomputation and several readers no second pass."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Keep:
    """Writes tables like ``stored`` and remembers their folders until they are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        path = work_path(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = table
        return table

    def all(self, tables: list[DataFrame]) -> DataFrame:
        """Kept tables of one shape as a single scan, however many there are."""
        paths = [path for path, table in self.paths.items() if any(table is t for t in tables)]
        return self.spark.read.schema(tables[0].schema).parquet(*paths)

    def drop(self, but: DataFrame | None = None) -> None:
        """Remove the folders of all tables but one."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [p for p, table in self.paths.items() if table is not but]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            del self.paths[path]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Keep]:
    """Intermediates that are removed at the end: nothing that is still to be
    read, a returned table above all, may read them then."""
    keep = Keep(spark)
    try:
        yield keep
    finally:
        keep.drop()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``buckets``; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def cut_points(df: DataFrame, key: str, ranges: int, groups: int = 64) -> list[int]:
    """Approximate quantiles of a whole-number key, all of them values that
    occur; fewer than ``ranges``. Summaries are merged in ``groups`` tasks
    before the last one, so no task merges one per input partition. They only
    place the cuts; every row keeps its place whatever they are."""
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    first = (
        df.select(F.col(key).alias("k"), F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g"))
        .groupBy("g").agg(F.percentile_approx("k", shares, 2000).alias("p"))
        .select(F.explode("p").alias("k"))
    )
    found = first.agg(F.percentile_approx("k", shares, 2000)).first()[0]
    return sorted(set(found or []))
