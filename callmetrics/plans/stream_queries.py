"""Streaming queries; their check SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.operators.upsert import CALL_KEY
from callmetrics.plans.registry import query
from callmetrics.plans.status_queries import LIMITS, STATUS_SQL, STOP_SQL
from callmetrics.plans.store_queries import DESC_SQL, KEY_SQL, VERSION
from callmetrics.plans.trace_queries import MARKERS, R40, WORDS_SQL
from callmetrics.session import work_path
from callmetrics.sources import tables as T
from callmetrics.streaming import monitors as SM
from callmetrics.streaming import trigger as TG


def live(spark, d, name):
    """The table as a stream. A single file is no valid streaming folder, so
    the path is a pattern that matches a file or a folder of that name."""
    root = d.rstrip("/")
    return SM.stream_table(spark, f"{root}/{name}.parque[t]", T.table(spark, root, name).schema)


@query("ss7_status_monitor", ctes=(T.CALLS_SQL,), sql=f"SELECT *, {STOP_SQL} AS stop_reason FROM ({STATUS_SQL})")
def status_monitor(spark, d):
    return SM.status_monitor(T.calls_from(live(spark, d, "orders")), LIMITS, work_path(spark, "status"))


@query("ss8_mismatch_alarm", ctes=(T.CALLS_SQL,), sql="""
SELECT stage, model_id, min(call_id) AS first_call_id, count(*) AS mismatches FROM calls WHERE provider_mismatch = 1 GROUP BY 1, 2""")
def _(spark, d):
    return SM.first_alarms(SM.mismatch_alarms(T.calls_from(live(spark, d, "orders")), work_path(spark, "alarms")))


@query("ss9_live_trigger", ctes=(T.TRACES_SQL, WORDS_SQL, R40), sql="""
SELECT call_id, trigger_chunk, score FROM fire_a JOIN risk_a USING (call_id) WHERE chunk = trigger_chunk""")
def _(spark, d):
    chunks = TG.chunk_stream(T.traces_from(live(spark, d, "documents")), MARKERS)
    fired = TG.live_triggers(chunks)
    path = work_path(spark, "triggers")
    SM.run_available(fired.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/state")
    return spark.read.schema(fired.schema).parquet(f"{path}/out")


@query("ss10_stream_upsert", ctes=(T.UPSERT_SQL,), sql=f"""
SELECT instance_id, sample_idx, l_partkey, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY {DESC_SQL}) AS rn FROM upsert_log) WHERE rn = 1""")
def _(spark, d):
    rows = T.upsert_log_from(live(spark, d, "lineitem"))
    table = SM.upsert_stream(rows, CALL_KEY, VERSION, work_path(spark, "upserts"))
    return table.select("instance_id", "sample_idx", "l_partkey", "outcome")


@query("ss10_watermarked_upsert", ctes=(T.UPSERT_SQL,), sql=f"""
SELECT instance_id, sample_idx, l_partkey, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY {DESC_SQL}) AS rn FROM upsert_log) WHERE rn = 1""")
def _(spark, d):
    """Every row comes twice; the ship date is the event time."""
    rows = T.upsert_log_from(live(spark, d, "lineitem")).withColumn("shipped", F.col("l_shipdate").cast("timestamp"))
    table = SM.upsert_within(rows.union(rows), CALL_KEY, VERSION, "shipped", "30 days", work_path(spark, "within"))
    return table.select("instance_id", "sample_idx", "l_partkey", "outcome")
