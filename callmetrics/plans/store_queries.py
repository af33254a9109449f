"""Upserts, plans, pairings, ledger and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.operators import ledger, pairing
from callmetrics.operators import upsert as U
from callmetrics.operators.ordered import ranked
from callmetrics.plans.registry import query
from callmetrics.plans.status_queries import AFTER, CLASS_SQL, IN_STUDY, MAIN, MODEL, study
from callmetrics.session import work_path
from callmetrics.sources import files
from callmetrics.sources import tables as T

KEY_SQL = "instance_id, model_id, sample_idx, prompt_version, stage"
VERSION = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
DESC_SQL = ", ".join(f"{c} DESC" for c in VERSION)


def write_log(spark, d):
    """The log with call ids in write order, as an autoincrement key gives them."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    log = T.upsert_log(spark, d).withColumn(
        "version", days.cast("bigint") * 10_000_000_000 + F.col("l_partkey")
    )
    placed = ranked(
        log, "version", order=["version", "l_suppkey", "instance_id", "sample_idx", "l_quantity", "l_extendedprice"],
        name="write_no", tie="l_suppkey",
    )
    return placed.withColumn("call_id", F.col("write_no") + 1)


WRITES_SQL = T.UPSERT_SQL + """,
writes AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_partkey, l_suppkey, instance_id, sample_idx, l_quantity, l_extendedprice) AS call_id
  FROM upsert_log)"""


@query("sk1_upsert_calls", ctes=(WRITES_SQL,), sql=f"""
SELECT instance_id, sample_idx, call_id, outcome, cost_microdollars FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY call_id DESC) AS rn FROM writes) WHERE rn = 1""")
def _(spark, d):
    log = write_log(spark, d).select(*U.CALL_KEY, "call_id", "outcome", "cost_microdollars", "l_shipdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old = log.where(F.col("l_shipdate") < cut).drop("l_shipdate")
    new = log.where(F.col("l_shipdate") >= cut).drop("l_shipdate")
    return U.record_calls(old, new).select("instance_id", "sample_idx", "call_id", "outcome", "cost_microdollars")


@query("st3_union_before_dedupe", ctes=(T.UPSERT_SQL,), sql="""
SELECT sample_idx, count(*) AS n, CAST(sum(cost_microdollars) AS BIGINT) AS cost FROM (
  SELECT * FROM upsert_log WHERE l_quantity < 25 UNION ALL SELECT * FROM upsert_log WHERE l_quantity >= 25)
GROUP BY sample_idx""")
def _(spark, d):
    log = T.upsert_log(spark, d)
    both = log.where("l_quantity < 25").unionByName(log.where("l_quantity >= 25"))
    return both.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_microdollars").alias("cost"))


@query("wn1_last_wins", ctes=(T.UPSERT_SQL,), sql=f"""
SELECT instance_id, sample_idx, l_partkey, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY {DESC_SQL}) AS rn FROM upsert_log) WHERE rn = 1""")
def _(spark, d):
    return U.last_wins(T.upsert_log(spark, d), U.CALL_KEY, VERSION).select("instance_id", "sample_idx", "l_partkey", "outcome")


@query("wn2_first_wins", ctes=(T.UPSERT_SQL,), sql=f"""
SELECT instance_id, sample_idx, l_partkey, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY {', '.join(VERSION)}) AS rn FROM upsert_log) WHERE rn = 1""")
def _(spark, d):
    return U.first_wins(T.upsert_log(spark, d), U.CALL_KEY, VERSION).select("instance_id", "sample_idx", "l_partkey", "outcome")


@query("sk2_add_instances", ctes=(T.INSTANCES_SQL, T.CALLS_SQL), sql="""
, known AS (SELECT instance_id, level_idx, seed FROM instances WHERE level_idx < 12),
fresh AS (SELECT instance_id, arg_min(level_idx, (pri, seed)) AS level_idx, arg_min(seed, (pri, seed)) AS seed FROM (
  SELECT instance_id, CAST(completion_tokens % 25 AS BIGINT) AS level_idx, call_id AS seed, completion_tokens AS pri FROM calls)
  WHERE instance_id NOT IN (SELECT instance_id FROM known) GROUP BY instance_id)
SELECT * FROM known UNION ALL SELECT * FROM fresh""")
def _(spark, d):
    known = T.instances(spark, d).where("level_idx < 12").select("instance_id", "level_idx", "seed")
    incoming = T.calls(spark, d).selectExpr(
        "instance_id", "completion_tokens % 25 AS level_idx", "call_id AS seed", "completion_tokens AS pri"
    )
    return U.add_instances(known, incoming, ["pri", "seed"])


@query("sk3_upsert_events", ctes=(T.STREAM_EVENTS_SQL,), sql="""
, again AS (SELECT call_id, seq, elapsed_ms, channel, char_count, 0 AS write_no FROM stream_events
  UNION ALL SELECT call_id, seq - seq % 2, elapsed_ms + 1.0, channel, char_count + 1, seq + 1 FROM stream_events WHERE seq % 3 = 0)
SELECT call_id, seq, elapsed_ms, channel, char_count FROM (
  SELECT *, row_number() OVER (PARTITION BY call_id, seq ORDER BY write_no DESC) AS rn FROM again) WHERE rn = 1""")
def _(spark, d):
    events = T.stream_events(spark, d).drop("event_type")
    again = events.where("seq % 3 = 0").selectExpr(
        "call_id", "seq - seq % 2 AS seq", "elapsed_ms + 1.0D AS elapsed_ms", "channel", "char_count + 1 AS char_count",
        "seq + 1 AS write_no",
    )
    return U.record_events(events.withColumn("write_no", F.lit(0).cast("bigint")), again).drop("write_no")


@query("sk4_update_scores", ctes=(T.CALLS_SQL,), sql="""
SELECT call_id, CASE WHEN call_id % 8 = 3 THEN 'pass' ELSE outcome END AS outcome,
  CASE WHEN call_id % 8 = 3 THEN 'A' ELSE parsed_answer END AS parsed_answer,
  CASE WHEN call_id % 8 = 3 OR outcome = 'pass' THEN 1 ELSE 0 END AS pass FROM calls""")
def _(spark, d):
    calls = T.calls(spark, d).selectExpr("call_id", "outcome", "parsed_answer", "0 AS pass")
    changes = T.calls(spark, d).where("call_id % 8 = 3").selectExpr("call_id", "'pass' AS outcome", "'A' AS parsed_answer")
    return U.update_scores(calls, changes)


NEW_COLUMNS = {n: "string" for n in ("reasoning_text", "error_text", "raw_response_text", "generation_id")}


@query("sc7_additive_columns", ctes=(T.CALLS_SQL,), sql="""
SELECT call_id, outcome, CASE WHEN call_id % 2 = 1 THEN reasoning_text END AS reasoning_text,
  CASE WHEN call_id % 2 = 1 THEN error_text END AS error_text,
  CAST(NULL AS VARCHAR) AS raw_response_text, CAST(NULL AS VARCHAR) AS generation_id FROM calls""")
def _(spark, d):
    calls = T.calls(spark, d)
    old = calls.where("call_id % 2 = 0").select("call_id", "outcome")
    new = calls.where("call_id % 2 = 1").select("call_id", "outcome", "reasoning_text", "error_text")
    return U.with_columns(old.unionByName(new, allowMissingColumns=True), NEW_COLUMNS)


@query("wn5_sample_ordinal", ctes=(T.SAMPLED_SQL,), sql="SELECT call_id, sample_idx FROM sampled")
def _(spark, d):
    return T.sampled_calls(spark, d).select("call_id", "sample_idx")


@query("st1_completed_keys", ctes=(T.SAMPLED_SQL,), sql=f"""
SELECT DISTINCT instance_id, sample_idx FROM sampled WHERE {IN_STUDY}""")
def _(spark, d):
    return U.completed_keys(T.sampled_calls(spark, d, study))


PLAN_SQL = T.INSTANCES_SQL + """,
plan AS (SELECT instance_id, level_idx, level_value, seed, unnest(range(3)) AS sample_idx FROM (
  SELECT instance_id, level_idx, level_value,
    20260712 + level_idx * 100000 + row_number() OVER (PARTITION BY level_idx ORDER BY CAST(instance_id AS BIGINT)) - 1 AS seed
  FROM instances))"""


def plan(spark, d):
    return U.call_plan(T.instances(spark, d), 3, 20260712, F.col("instance_id").cast("bigint"))


@query("jn4_call_plan", ctes=(PLAN_SQL,), sql="SELECT instance_id, level_idx, level_value, seed, sample_idx FROM plan")
def _(spark, d):
    return plan(spark, d)


@query("jn3_remaining_plan", ctes=(PLAN_SQL, T.SAMPLED_SQL), sql=f"""
SELECT instance_id, sample_idx, level_idx FROM plan WHERE NOT EXISTS (SELECT 1 FROM sampled s WHERE {IN_STUDY}
  AND s.instance_id = plan.instance_id AND s.sample_idx = plan.sample_idx)""")
def _(spark, d):
    return U.remaining_plan(plan(spark, d), T.sampled_calls(spark, d, study)).select("instance_id", "sample_idx", "level_idx")


@query("jn5_plan_summary", ctes=(PLAN_SQL,), sql="""
SELECT count(*) AS planned_calls, CAST(89148 AS BIGINT) AS worst_case_microdollars,
  CAST(0.089148 AS DOUBLE) AS per_call_worst_case_usd, '38.0' AS hard_cap_usd FROM plan""")
def _(spark, d):
    return U.plan_summary(T.instances(spark, d), 3, 0.3, 1.2, 65_536, 38.0)


@query("jn2_study_events", ctes=(T.STREAM_EVENTS_SQL, T.CALLS_SQL), sql=f"""
SELECT call_id, seq, elapsed_ms, channel, char_count FROM stream_events
WHERE call_id IN (SELECT call_id FROM calls WHERE model_id = '{MODEL}')""")
def _(spark, d):
    calls = T.calls(spark, d).where(F.col("model_id") == MODEL)
    return pairing.study_events(T.stream_events(spark, d).drop("event_type"), calls)


@query("sc3_study_stream_events", ctes=(T.STREAM_EVENTS_SQL, T.CALLS_SQL), sql=f"""
SELECT s.call_id, s.seq, s.elapsed_ms, s.channel, s.char_count FROM stream_events s JOIN calls c USING (call_id)
WHERE {IN_STUDY} ORDER BY s.call_id, s.seq""")
def _(spark, d):
    events = T.stream_events(spark, d).drop("event_type")
    return pairing.study_events(events, study(T.calls(spark, d))).orderBy("call_id", "seq")


@query("jn7_paired_transitions", ctes=(T.SAMPLED_SQL,), sql=f"""
, k AS (SELECT *, {CLASS_SQL} AS class FROM sampled WHERE model_id = '{MODEL}')
SELECT a.class AS before, b.class AS after, count(*) AS n FROM k a JOIN k b USING (instance_id, sample_idx)
WHERE a.stage = '{MAIN}' AND b.stage = '{AFTER}' GROUP BY 1, 2""")
def _(spark, d):
    calls = T.sampled_calls(spark, d, lambda calls: calls.where(F.col("model_id") == MODEL))
    return pairing.paired_transitions(
        calls.where(F.col("stage") == MAIN), calls.where(F.col("stage") == AFTER)
    )


def counts_sql(label: str) -> str:
    return f"""SELECT '{label}' AS stage, count(*) AS calls, count(*) FILTER (WHERE {label} = 'pass') AS correct,
  count(*) FILTER (WHERE {label} = 'fail_wrong') AS silent_wrong, count(*) FILTER (WHERE {label} NOT IN ('pass', 'fail_wrong')) AS loud,
  count(*) FILTER (WHERE {label} = 'fail_truncated') AS truncations, count(*) FILTER (WHERE {label} = 'error_api') AS api_errors FROM p HAVING count(*) > 0"""


@query("jn7_stage_counts", ctes=(T.SAMPLED_SQL,), sql=f"""
, k AS (SELECT * FROM sampled WHERE model_id = '{MODEL}'),
p AS (SELECT a.outcome AS before, b.outcome AS after FROM k a JOIN k b USING (instance_id, sample_idx) WHERE a.stage = '{MAIN}' AND b.stage = '{AFTER}')
{counts_sql("before")} UNION ALL {counts_sql("after")}""")
def _(spark, d):
    calls = T.sampled_calls(spark, d, lambda calls: calls.where(F.col("model_id") == MODEL))
    return pairing.paired_stage_counts(calls.where(F.col("stage") == MAIN), calls.where(F.col("stage") == AFTER))


def side_sql(prefix, model):
    return f"""{prefix}_side AS (SELECT instance_id, count(*) AS {prefix}_calls,
  CAST(count(*) FILTER (WHERE outcome = 'pass') AS BIGINT) AS {prefix}_solved,
  CAST(sum(cost_microdollars) AS BIGINT) AS {prefix}_cost, CAST(sum(completion_tokens) AS BIGINT) AS {prefix}_tokens
  FROM calls WHERE model_id = '{model}' GROUP BY instance_id)"""


SHARED_SQL = T.CALLS_SQL + ",\n" + side_sql("cheap", "model-0") + ",\n" + side_sql("strong", "model-1") + """,
shared AS (SELECT * FROM cheap_side JOIN strong_side USING (instance_id))"""


@query("jn8_shared_instances", ctes=(SHARED_SQL,), sql="SELECT * FROM shared")
def _(spark, d):
    return pairing.shared_instances(T.calls(spark, d), "model-0", "model-1")


LEDGER_COLUMNS = """count(*) AS calls, round(CAST(sum(cost_microdollars) AS DOUBLE) / 1e6, 2) AS usd,
  CAST(round(CAST(sum(completion_tokens) AS DOUBLE) / count(completion_tokens), 0) AS BIGINT) AS avg_out,
  CAST(count(*) FILTER (WHERE outcome = 'pass') AS BIGINT) AS pass, CAST(count(*) FILTER (WHERE outcome = 'fail_parse') AS BIGINT) AS parse,
  CAST(count(*) FILTER (WHERE outcome = 'fail_truncated') AS BIGINT) AS trunc, CAST(count(*) FILTER (WHERE outcome = 'error_api') AS BIGINT) AS err,
  round(CAST(coalesce(sum(cost_microdollars) FILTER (WHERE NOT starts_with(model_id, 'model-2')), 0) AS DOUBLE) / 1e6, 2) AS capped_usd FROM calls"""


@query("ag8_spend_ledger", ctes=(T.CALLS_SQL,), sql=f"""
SELECT stage, model_id, {LEDGER_COLUMNS} GROUP BY stage, model_id
UNION ALL SELECT 'TOTAL', 'TOTAL', {LEDGER_COLUMNS}""")
def _(spark, d):
    return ledger.spend_ledger(T.calls(spark, d), "model-2")


@query("sk12_progress_rate", ctes=(T.CALLS_SQL,), sql="""
, l AS (SELECT stage AS log, call_id AS line_no, (call_id * 37) % 86400 AS s, call_id // 10 AS done, cost_microdollars % 10000 AS cents
  FROM calls WHERE call_id % 3 <> 2),
p AS (SELECT *, lag(s) OVER w AS ps, lag(done) OVER w AS pd FROM l WINDOW w AS (PARTITION BY log ORDER BY line_no))
SELECT log, line_no, done, CAST(cents AS DOUBLE) / 100.0 AS spent_usd, ((s - ps) % 86400 + 86400) % 86400 AS gap_seconds,
  CASE WHEN ((s - ps) % 86400 + 86400) % 86400 > 0 THEN round(CAST(done - pd AS DOUBLE) * 3600.0 / (((s - ps) % 86400 + 86400) % 86400), 6) END AS calls_per_hour
FROM p""")
def _(spark, d):
    return ledger.progress_rate(ledger.parse_log_lines(log_lines(spark, d)))


LOG_CALLS = 10_000


@query("sk12_log_files", ctes=(T.CALLS_SQL,), sql=f"""
, l AS (SELECT stage || '-' || (call_id // {LOG_CALLS}) AS log, call_id AS line_no, (call_id * 37) % 86400 AS s, call_id // 10 AS done, cost_microdollars % 10000 AS cents
  FROM calls WHERE call_id % 3 <> 2),
p AS (SELECT *, lag(s) OVER w AS ps, lag(done) OVER w AS pd FROM l WINDOW w AS (PARTITION BY log ORDER BY line_no))
SELECT log, done, CAST(cents AS DOUBLE) / 100.0 AS spent_usd, ((s - ps) % 86400 + 86400) % 86400 AS gap_seconds,
  CASE WHEN ((s - ps) % 86400 + 86400) % 86400 > 0 THEN round(CAST(done - pd AS DOUBLE) * 3600.0 / (((s - ps) % 86400 + 86400) % 86400), 6) END AS calls_per_hour
FROM p""")
def _(spark, d):
    """The same from text files, one per stage and stretch of calls, read as they lie in their folder."""
    lines = log_lines(spark, d).withColumn("part", F.concat_ws("-", "log", F.expr(f"line_no DIV {LOG_CALLS}")))
    path = work_path(spark, "logs")
    lines.repartition("part").sortWithinPartitions("part", "line_no").select("part", "value").write.partitionBy("part").text(path)
    read = files.read_logs(spark, f"{path}/*/*").withColumn("log", F.regexp_extract("log", "part=([^/]+)/", 1))
    return ledger.progress_rate(ledger.parse_log_lines(read)).drop("line_no")


def log_lines(spark, d):
    """A progress line for two calls of three, another line for the third."""
    return T.calls(spark, d).selectExpr(
        "stage AS log", "call_id AS line_no", "(call_id * 37) % 86400 AS s", "call_id DIV 10 AS done",
        "cost_microdollars % 10000 AS cents",
    ).selectExpr(
        "log", "line_no",
        "CASE WHEN line_no % 3 = 2 THEN concat('[adaptive] probe level ', line_no) ELSE "
        "concat('[', lpad(s DIV 3600, 2, '0'), ':', lpad(s DIV 60 % 60, 2, '0'), ':', lpad(s % 60, 2, '0'), '] ', done, '/999999 done, $', "
        "cents DIV 100, '.', lpad(cents % 100, 2, '0'), ' spent ($0.00 reserved)') END AS value",
    )
