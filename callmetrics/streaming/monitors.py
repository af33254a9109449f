"""Structured Streaming jobs: status, alarms, keyed upserts.

Each job takes a streaming DataFrame and a folder below the shared one, runs
until the available input is used up, and leaves its result where a reader
can take it as an ordinary table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callmetrics.operators import status as S
from callmetrics.operators.upsert import last_wins


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(writer, checkpoint: str) -> None:
    """Start, use up what is there, stop."""
    running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()


def status_monitor(calls: DataFrame, limits: dict, path: str) -> DataFrame:
    """Live study status with its stopping reason. The state is one row per
    study; each micro-batch replaces the snapshot it has just recomputed, and
    replaying a batch writes the same snapshot again."""
    live = S.study_status(calls)

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        S.should_stop(batch, limits).write.mode("overwrite").parquet(f"{path}/snapshot/batch={batch_id}")

    run_available(live.writeStream.outputMode("complete").foreachBatch(snapshot), f"{path}/state")
    seen = calls.sparkSession.read.parquet(f"{path}/snapshot")
    newest = seen.agg(F.max("batch")).first()[0]
    return seen.where(F.col("batch") == newest).drop("batch")


def mismatch_alarms(calls: DataFrame, path: str) -> DataFrame:
    """Calls off the pinned route, written as they arrive; the first of each
    study is where admission has to stop."""
    alarms = calls.where(F.col("provider_mismatch") == 1).select("stage", "model_id", "call_id", "provider_endpoint")
    run_available(
        alarms.writeStream.format("parquet").option("path", f"{path}/alarms").outputMode("append"), f"{path}/state"
    )
    return calls.sparkSession.read.schema(alarms.schema).parquet(f"{path}/alarms")


def first_alarms(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("stage", "model_id").agg(
        F.min("call_id").alias("first_call_id"), F.count(F.lit(1)).alias("mismatches")
    )


def _no_rows(rows: DataFrame) -> DataFrame:
    """What a stream without a batch leaves behind."""
    return rows.sparkSession.createDataFrame([], rows.schema)


def upsert_stream(rows: DataFrame, key: list[str], order: list[str], path: str) -> DataFrame:
    """Keyed upserts, merged on read: a micro-batch is reduced to its last row
    per key and written to a folder of its own, so replaying it changes
    nothing and no stored row is rewritten. ``compact`` folds the folders."""

    def store(batch: DataFrame, batch_id: int) -> None:
        last_wins(batch, key, order).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    _no_rows(rows).write.mode("overwrite").parquet(f"{path}/log/batch=-1")
    run_available(rows.writeStream.outputMode("append").foreachBatch(store), f"{path}/state")
    return current_rows(rows.sparkSession, path, rows.schema, key, order)


def upsert_within(rows: DataFrame, key: list[str], order: list[str], event_time: str, delay: str, path: str) -> DataFrame:
    """Keyed upserts with a bound on lateness. Rows older than the watermark (the
    newest event time seen, less the delay) take no part; replays of a row, equal
    in key and order, are dropped while their first copy is in the state, which
    forgets it once the watermark has passed. So the state holds the rows of one
    delay and not of the whole stream."""
    live = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(dict.fromkeys([*key, *order])))
    return upsert_stream(live, key, order, path)


def late_rows(rows: DataFrame, event_time: str, delay: str, path: str) -> DataFrame:
    """The rows that ``upsert_within`` leaves out as late, from the same batches:
    those not newer than the newest event time of earlier batches less the
    delay. A batch's newest time is stored beside it, so a replayed batch is cut
    where it was cut first."""
    spark = rows.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.max(event_time).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        seen = spark.read.parquet(f"{path}/newest").where(F.col("batch") < batch_id)
        mark = seen.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("m")).first().m
        late = batch.where(F.col(event_time) <= F.lit(mark)) if mark is not None else batch.limit(0)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    _no_rows(rows).write.mode("overwrite").parquet(f"{path}/late/batch=-1")
    run_available(rows.writeStream.outputMode("append").foreachBatch(store), f"{path}/state")
    return spark.read.schema(rows.schema).parquet(f"{path}/late")


def current_rows(spark: SparkSession, path: str, schema: StructType, key: list[str], order: list[str]) -> DataFrame:
    log = spark.read.parquet(f"{path}/log").select(*schema.fieldNames(), "batch")
    return last_wins(log, key, [*order, "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, schema: StructType, key: list[str], order: list[str], target: str) -> None:
    """Write the current rows as one table; the old log stays until it is no
    longer read."""
    current_rows(spark, path, schema, key, order).write.mode("errorifexists").parquet(target)
