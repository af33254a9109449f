"""Export, sink, source and checksum queries. Each writes below the shared
folder and answers from what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions.scoring import FROZEN
from callmetrics.operators import metrics as M
from callmetrics.operators import release as RL
from callmetrics.operators import status as S
from callmetrics.plans.metric_queries import FEATURE_SQL, METRIC_SQL, SCORED_SQL
from callmetrics.operators.pairing import study_events
from callmetrics.plans.registry import query
from callmetrics.plans.report import prediction_rows
from callmetrics.plans.status_queries import CLASS_SQL, IN_STUDY, STATUS_SQL, study
from callmetrics.session import work_path
from callmetrics.sources import files
from callmetrics.sources import tables as T

COMPACT_SQL = f"""compact AS (SELECT call_id, substr(sha256(instance_id), 1, 16) AS instance_hash, level_value AS difficulty, {CLASS_SQL} AS outcome,
  finish_reason, completion_tokens, reasoning_tokens, latency_ms, coalesce(cost_microdollars, 0) AS cost_microdollars, provider_endpoint AS provider
  FROM calls JOIN instances USING (instance_id))"""
TRACE_SQL = """texts AS (SELECT call_id, substr(sha256(instance_id), 1, 16) AS instance_hash, coalesce(response_text, '') AS response_text,
  coalesce(reasoning_text, '') AS reasoning_text FROM calls)"""
BASE = (T.CALLS_SQL, T.INSTANCES_SQL)


@query("sk5_compact_export", ctes=(*BASE, COMPACT_SQL), sql="SELECT * FROM compact")
def compact(spark, d):
    return RL.compact_export(T.calls(spark, d), T.instances(spark, d))


@query("sk6_trace_export", ctes=(T.CALLS_SQL, TRACE_SQL), sql="SELECT * FROM texts")
def _(spark, d):
    return RL.trace_export(T.calls(spark, d))


@query("sk7_event_export", ctes=(T.STREAM_EVENTS_SQL,), sql="SELECT call_id, seq, elapsed_ms, channel, char_count FROM stream_events")
def _(spark, d):
    events = T.stream_events(spark, d).drop("event_type")
    path = work_path(spark, "events")
    RL.write_json_lines(events, path, ["call_id", "seq"])
    return RL.read_release(spark, path, "", events.schema)


@query("sk8_json_lines_writer", ctes=(*BASE, COMPACT_SQL), sql="SELECT * FROM compact")
def export_roundtrip(spark, d):
    rows = compact(spark, d)
    path = work_path(spark, "compact")
    RL.write_json_lines(rows, path, ["call_id"])
    return RL.read_release(spark, path, "", rows.schema)


NUM = "coalesce({0}::VARCHAR, 'null')"
TXT = "coalesce('\"' || {0} || '\"', 'null')"
LINE_SQL = "'{' || " + " || ',' || ".join(
    f"'\"{c}\":' || " + (TXT if c in ("instance_hash", "outcome", "finish_reason", "provider") else NUM).format(c)
    for c in sorted(RL.COMPACT)
) + " || '}'"
TRACE_LINE_SQL = "'{' || " + " || ',' || ".join(
    f"'\"{c}\":' || " + (NUM if c == "call_id" else TXT).format(c) for c in sorted(RL.TRACE)) + " || '}'"
EVENT_LINE_SQL = "'{' || " + " || ',' || ".join(
    f"'\"{c}\":' || " + (TXT if c == "channel" else NUM).format("elapsed_ms::DECIMAL(20,3)" if c == "elapsed_ms" else c)
    for c in ("call_id", "channel", "char_count", "elapsed_ms", "seq")) + " || '}'"
DIGEST_SQL = " || ':' || ".join(f"sum(('0x' || substr(sha256(value), {at}, 15))::BIGINT)::VARCHAR" for at in (1, 16, 31, 46))
MANIFEST_SQL = f"""lines AS (SELECT 'calls' AS artifact, {LINE_SQL} AS value FROM compact UNION ALL SELECT 'traces', {TRACE_LINE_SQL} FROM texts
  UNION ALL SELECT 'stream-events', {EVENT_LINE_SQL} FROM stream_events WHERE call_id IN (SELECT call_id FROM calls)),
manifest AS (SELECT artifact, count(*) AS rows, CAST(sum(length(value)) AS BIGINT) AS chars, CAST(sum(strlen(value)) AS BIGINT) AS bytes,
  {DIGEST_SQL} AS digest FROM lines GROUP BY artifact)"""
MANIFEST = (*BASE, COMPACT_SQL, TRACE_SQL, T.STREAM_EVENTS_SQL, MANIFEST_SQL)


def released_events(spark, d):
    """Times as decimals, which every engine writes alike."""
    events = study_events(T.stream_events(spark, d).drop("event_type"), T.calls(spark, d))
    return events.withColumn("elapsed_ms", F.col("elapsed_ms").cast("decimal(20,3)"))


def release_tables(spark, d):
    return {"calls": compact(spark, d), "traces": RL.trace_export(T.calls(spark, d)), "stream-events": released_events(spark, d)}


@query("sk9_export_manifest", ctes=MANIFEST, sql="SELECT * FROM manifest")
def manifest(spark, d):
    return RL.manifest(release_tables(spark, d))


# The digests are taken from the files as written.
@query("sk5_sk9_release_job", ctes=MANIFEST, sql="SELECT * FROM manifest")
def release_job(spark, d):
    return RL.export_release(T.calls(spark, d), T.instances(spark, d), released_events(spark, d), work_path(spark, "release"))


@query("jn11_checksum_verification", ctes=MANIFEST, sql="""
SELECT artifact, true AS present, artifact <> 'traces' AS matches FROM manifest UNION ALL SELECT 'snapshot', false, false""")
def _(spark, d):
    published = RL.manifest(release_tables(spark, d))
    absent = spark.createDataFrame([("snapshot", 0, 0, 0, "")], published.schema)
    tables = release_tables(spark, d)
    tables["traces"] = tables["traces"].withColumn(
        "response_text", F.when(F.col("call_id") % 1000 == 1, "edited").otherwise(F.col("response_text"))
    )
    return RL.verify_manifest(RL.manifest(tables), published.unionByName(absent))


@query("sk10_report_sink", ctes=(T.CALLS_SQL,), sql=STATUS_SQL)
def _(spark, d):
    status = S.study_status(T.calls(spark, d))
    path = work_path(spark, "report")
    files.write_once(status, path)
    return spark.read.schema(status.schema).json(path)


@query("sk11_predictions_sink", ctes=(*BASE, FEATURE_SQL, SCORED_SQL), sql=f"""
SELECT call_id, substr(sha256(instance_id), 1, 16) AS instance_hash, difficulty, label, round(prediction, 6) AS prediction, round(curve_prior, 6) AS curve_prior
FROM scored WHERE {IN_STUDY}""")
def _(spark, d):
    rows = prediction_rows(study(T.calls(spark, d)), T.instances(spark, d), FROZEN).drop("instance_id")
    rows = rows.withColumns({c: F.round(c, 6) for c in ("prediction", "curve_prior")})
    path = work_path(spark, "predictions")
    files.write_once(rows, path)
    return files.read_json_lines(spark, path, rows.schema)


@query("sc4_predictions_source", ctes=(T.PREDICTIONS_SQL,), sql=f"""
SELECT {METRIC_SQL} FROM predictions""")
def _(spark, d):
    rows = T.predictions(spark, d).select("label", F.col("curve_prior").alias("pred_curve"), F.col("prediction").alias("pred_metadata"))
    path = work_path(spark, "lines")
    # A blank line after every record, as hand-edited files have them.
    RL.json_lines(rows).select(F.concat("value", F.lit("\n"))).write.text(path)
    back = files.read_json_lines(spark, path)
    out = M.score_metrics(back, score="pred_metadata", prior="pred_curve")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("brier", "brier_skill", "log_loss")])


@query("sc5_compressed_snapshot", ctes=BASE, sql="""
SELECT level_value, count(*) AS calls, CAST(sum(cost_microdollars) AS BIGINT) AS cost FROM calls JOIN instances USING (instance_id) GROUP BY 1""")
def _(spark, d):
    path = work_path(spark, "snapshot")
    calls = T.calls(spark, d).select("call_id", "instance_id", "cost_microdollars")
    instances = T.instances(spark, d).select("instance_id", "level_value")
    RL.write_json_lines(calls, f"{path}/calls", ["call_id"])
    RL.write_json_lines(instances, f"{path}/instances", ["instance_id"])
    stored = RL.read_release(spark, path, "calls", calls.schema).groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost_microdollars").alias("c")
    )
    return stored.join(RL.read_release(spark, path, "instances", instances.schema), "instance_id").groupBy("level_value").agg(
        F.sum("n").alias("calls"), F.sum("c").alias("cost")
    )
