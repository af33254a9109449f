"""Scans, joins, counts, gates, stopping and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.functions.hashing import fingerprint, id_hash
from callmetrics.operators import status as S
from callmetrics.plans.registry import query
from callmetrics.sources import tables as T

MAIN, BEFORE, AFTER, MODEL = "stage-1996", "stage-1995", "stage-1997", "model-1"
LIMITS = {"correct": 40, "silent_wrong": 40, "max_calls": 500, "max_spend_microdollars": 60_000_000}
IN_STUDY = f"stage = '{MAIN}' AND model_id = '{MODEL}'"

CLASS_SQL = """CASE WHEN outcome = 'pass' THEN 'correct_completed' WHEN outcome = 'fail_wrong'
    THEN 'silently_wrong_completed' ELSE 'loud_failure' END"""
COUNTS_SQL = """CAST(count(*) FILTER (WHERE outcome = 'pass') AS BIGINT) AS correct,
  CAST(count(*) FILTER (WHERE outcome = 'fail_wrong') AS BIGINT) AS silent_wrong,
  CAST(count(*) FILTER (WHERE outcome NOT IN ('pass', 'fail_wrong')) AS BIGINT) AS loud"""
STATUS_SQL = f"""SELECT stage, model_id, count(*) AS calls, {COUNTS_SQL},
  CAST(coalesce(sum(cost_microdollars), 0) AS BIGINT) AS spend_microdollars,
  round(CAST(coalesce(sum(cost_microdollars), 0) AS DOUBLE) / 1000000.0, 6) AS spend_usd
  FROM calls GROUP BY stage, model_id"""
ROUTE_SQL = """SELECT stage, model_id, count(*) AS calls, CAST(coalesce(sum(provider_mismatch), 0) AS BIGINT) AS mismatches,
  CAST(count(*) FILTER (WHERE provider_pinned = 0) AS BIGINT) AS unpinned FROM calls GROUP BY stage, model_id"""


def study(df):
    return df.where((F.col("stage") == MAIN) & (F.col("model_id") == MODEL))


@query("sc1_study_rows", ctes=(T.CALLS_SQL, T.INSTANCES_SQL), sql=f"""
SELECT call_id, instance_id, outcome, completion_tokens, latency_ms, cost_microdollars, level_value, seed
FROM calls JOIN instances USING (instance_id) WHERE {IN_STUDY}""")
def _(spark, d):
    rows = study(T.calls(spark, d)).join(T.instances(spark, d), "instance_id")
    return rows.select(
        "call_id", "instance_id", "outcome", "completion_tokens", "latency_ms", "cost_microdollars",
        "level_value", "seed",
    )


@query("jn1_calls_instances", ctes=(T.CALLS_SQL, T.INSTANCES_SQL), sql="""
SELECT call_id, stage, model_id, level_idx, level_value FROM calls JOIN instances USING (instance_id)""")
def _(spark, d):
    return T.calls(spark, d).select("call_id", "stage", "model_id", "instance_id").join(
        T.instances(spark, d), "instance_id"
    ).select("call_id", "stage", "model_id", "level_idx", "level_value")


@query("sc2_instances_by_level", ctes=(T.INSTANCES_SQL,), sql="""
SELECT instance_id, level_idx, level_value, seed FROM instances WHERE set_name = 'study'
ORDER BY level_idx, instance_id""")
def _(spark, d):
    return (
        T.instances(spark, d).where(F.col("set_name") == "study")
        .select("instance_id", "level_idx", "level_value", "seed")
        .orderBy("level_idx", "instance_id")
    )


@query("tk1_calls_in_order", ctes=(T.CALLS_SQL,), sql="""
SELECT call_id, stage, model_id, outcome FROM calls ORDER BY call_id""")
def _(spark, d):
    return T.calls(spark, d).select("call_id", "stage", "model_id", "outcome").orderBy("call_id")


@query("ag1_study_status", ctes=(T.CALLS_SQL,), sql=STATUS_SQL)
def _(spark, d):
    return S.study_status(T.calls(spark, d))


@query("ag2_route_status", ctes=(T.CALLS_SQL,), sql=ROUTE_SQL)
def _(spark, d):
    return S.route_status(T.calls(spark, d))


CELLS_SQL = f"""SELECT level_value, {COUNTS_SQL}, CAST(sum(cost_microdollars) AS BIGINT) AS spend_microdollars
FROM calls JOIN instances USING (instance_id) GROUP BY level_value"""


@query("ag3_level_outcomes", ctes=(T.CALLS_SQL, T.INSTANCES_SQL), sql=CELLS_SQL)
def level_outcomes(spark, d):
    return S.level_outcomes(T.calls(spark, d), T.instances(spark, d))


@query("ag4_distinct_counts", ctes=(T.CALLS_SQL,), sql="""
SELECT model_id, count(DISTINCT instance_id) AS instances, count(DISTINCT coalesce(provider_endpoint, '')) AS providers
FROM calls GROUP BY model_id""")
def _(spark, d):
    return S.distinct_counts(T.calls(spark, d))


@query("st2_provider_routes", ctes=(T.CALLS_SQL,), sql="""
SELECT DISTINCT model_id, coalesce(provider_endpoint, '') AS provider FROM calls""")
def _(spark, d):
    return S.provider_routes(T.calls(spark, d))


@query("ag6_mixed_levels", ctes=(T.CALLS_SQL, T.INSTANCES_SQL), sql=f"""
SELECT model_id, count(*) AS levels, count(*) FILTER (WHERE correct > 0 AND silent_wrong > 0) AS mixed_levels
FROM (SELECT model_id, level_value, {COUNTS_SQL} FROM calls JOIN instances USING (instance_id)
      GROUP BY model_id, level_value) GROUP BY model_id""")
def _(spark, d):
    return S.mixed_levels(
        S.level_outcomes(T.calls(spark, d), T.instances(spark, d), ["model_id"]), ["model_id"]
    )


@query("ag7_cohort_audit", ctes=(T.CALLS_SQL, T.INSTANCES_SQL), sql=f"""
, cells AS (SELECT model_id, level_value, {COUNTS_SQL} FROM calls JOIN instances USING (instance_id) GROUP BY 1, 2),
mixed AS (SELECT model_id, count(*) FILTER (WHERE correct > 0 AND silent_wrong > 0) AS mixed_levels FROM cells GROUP BY 1),
base AS (SELECT model_id, count(*) AS calls, count(DISTINCT instance_id) AS instances, {COUNTS_SQL},
  count(DISTINCT coalesce(provider_endpoint, '')) AS providers,
  bool_and(coalesce(provider_pinned, 0) = 1) AS pinned
  FROM calls JOIN instances USING (instance_id) GROUP BY model_id)
SELECT model_id, calls, instances, correct, silent_wrong, loud, providers, mixed_levels,
  silent_wrong >= 20 AS at_least_20_silent_wrong, correct + silent_wrong >= 30 AS at_least_30_completed_calls,
  providers = 1 AS single_provider_route, pinned AS all_calls_provider_pinned,
  mixed_levels >= 3 AS at_least_3_mixed_outcome_levels,
  silent_wrong >= 20 AND correct + silent_wrong >= 30 AND providers = 1 AND pinned AND mixed_levels >= 3 AS pass
FROM base JOIN mixed USING (model_id)""")
def _(spark, d):
    return S.cohort_audit(T.calls(spark, d), T.instances(spark, d))


RATE_CODES = {
    "parse": "fail_parse", "trunc": "fail_truncated", "refusal": "fail_refusal", "empty": "fail_empty",
    "mismatch": "provider_mismatch", "api": "error_api",
}
# The given calls have neither kind; some of theirs stand for them, so that every rate counts something.
DETAIL_SQL = """CASE WHEN outcome = 'fail_truncated' AND call_id % 3 = 0 THEN 'fail_empty'
  WHEN outcome = 'fail_parse' AND call_id % 4 = 1 THEN 'fail_refusal' ELSE outcome END"""


@query("ag9_failure_rates", ctes=(T.CALLS_SQL,), sql="SELECT model_id, count(*) AS n, " + ", ".join(
    f"round(avg(CASE WHEN outcome = '{code}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS {name}"
    for name, code in RATE_CODES.items()) + f" FROM (SELECT * REPLACE ({DETAIL_SQL} AS outcome) FROM calls) GROUP BY model_id")
def _(spark, d):
    return S.failure_rates(T.calls(spark, d).withColumn("outcome", F.expr(DETAIL_SQL)), RATE_CODES)


@query("ag10_loud_breakdown", ctes=(T.CALLS_SQL,), sql="""
SELECT stage, model_id, outcome, count(*) AS n FROM calls WHERE outcome NOT IN ('pass', 'fail_wrong')
GROUP BY stage, model_id, outcome""")
def _(spark, d):
    return S.loud_breakdown(T.calls(spark, d))


GATE = {
    "at_least_20_silent_wrong": "silent_wrong >= 20",
    "at_least_30_completed": "correct + silent_wrong >= 30",
    "loud_share_below_0_5": "loud < 0.5D * calls",
}


@query("ag14_study_gate", ctes=(T.CALLS_SQL,), sql=f"""
, s AS ({STATUS_SQL})
SELECT stage, model_id, silent_wrong >= 20 AS at_least_20_silent_wrong, correct + silent_wrong >= 30 AS at_least_30_completed,
  loud < 0.5 * calls AS loud_share_below_0_5,
  silent_wrong >= 20 AND correct + silent_wrong >= 30 AND loud < 0.5 * calls AS pass FROM s""")
def _(spark, d):
    return S.gate(S.study_status(T.calls(spark, d)), GATE, S.STUDY)


READY_SQL = f"""SELECT model_id, main_calls, main_mismatches, main_unpinned, before_calls, before_mismatches, before_unpinned,
  after_calls, after_mismatches, after_unpinned,
  main_mismatches = 0 AND main_unpinned = 0 AND before_calls >= 10 AND after_calls >= 10
    AND before_mismatches = 0 AND after_mismatches = 0 AS ready
FROM (SELECT model_id, """ + ", ".join(
    f"CAST(coalesce(max({name}) FILTER (WHERE stage = '{stage}'), 0) AS BIGINT) AS {label}_{name}"
    for label, stage in (("main", MAIN), ("before", BEFORE), ("after", AFTER))
    for name in ("calls", "mismatches", "unpinned")
) + f" FROM ({ROUTE_SQL}) WHERE stage IN ('{MAIN}', '{BEFORE}', '{AFTER}') GROUP BY model_id)"


@query("ag15_protocol_readiness", ctes=(T.CALLS_SQL,), sql=READY_SQL)
def _(spark, d):
    return S.protocol_readiness(S.route_status(T.calls(spark, d)), MAIN, BEFORE, AFTER, 10)


STOP_SQL = f"""CASE WHEN correct >= {LIMITS['correct']} AND silent_wrong >= {LIMITS['silent_wrong']} THEN 'label target reached'
  WHEN calls >= {LIMITS['max_calls']} THEN 'call cap reached'
  WHEN spend_microdollars >= {LIMITS['max_spend_microdollars']} THEN 'spend cap reached' END"""


@query("ag16_next_action", ctes=(T.CALLS_SQL,), sql=f"""
, s AS ({STATUS_SQL}), r AS ({READY_SQL}),
j AS (SELECT s.model_id, stage, {STOP_SQL} AS stop_reason, ready,
      CASE WHEN calls % 3 = 0 THEN NULL ELSE calls % 3 = 1 END AS gate_pass FROM s JOIN r ON s.model_id = r.model_id)
SELECT model_id, stage, stop_reason, ready, CASE WHEN stop_reason IS NULL THEN '{S.CONTINUE}'
  WHEN NOT ready THEN '{S.SENTINEL}' WHEN gate_pass IS NULL THEN '{S.ANALYZE}'
  WHEN gate_pass THEN '{S.SMOKE}' ELSE '{S.NEGATIVE}' END AS next_action FROM j""")
def _(spark, d):
    calls = T.calls(spark, d)
    ready = S.protocol_readiness(S.route_status(calls), MAIN, BEFORE, AFTER, 10).select("model_id", "ready")
    state = S.should_stop(S.study_status(calls), LIMITS).join(ready, "model_id")
    report = F.expr("CASE WHEN calls % 3 = 0 THEN NULL ELSE calls % 3 = 1 END")
    return state.select(
        "model_id", "stage", "stop_reason", "ready",
        S.next_action(F.col("stop_reason"), F.col("ready"), report).alias("next_action"),
    )


@query("pr1_outcome_class", ctes=(T.CALLS_SQL,), sql=f"""
SELECT outcome, {CLASS_SQL} AS class, count(*) AS n FROM calls GROUP BY 1, 2""")
def _(spark, d):
    calls = T.calls(spark, d)
    return calls.groupBy("outcome", O.outcome_class(F.col("outcome")).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )


MATCH_SQL = """(coalesce(provider_endpoint, '') <> ''
  AND coalesce(string_split(lower(trim(provider_endpoint)), '/')[-1] = 'parasail', false))"""


@query("pr2_classify_raw", ctes=(T.CALLS_SQL,), sql=f"""
, m AS (SELECT *, (coalesce(error_text, '') = '' AND NOT {MATCH_SQL}) AS mismatch FROM calls)
SELECT call_id, CASE WHEN coalesce(error_text, '') <> '' THEN 'error_api' WHEN mismatch THEN 'provider_mismatch'
  WHEN finish_reason NOT IN ('stop', 'completed') THEN 'fail_truncated' WHEN parsed_answer IS NULL THEN 'fail_parse'
  WHEN parsed_answer = 'A' THEN 'pass' ELSE 'fail_wrong' END AS raw_outcome FROM m""")
def _(spark, d):
    calls = T.calls(spark, d)
    mismatch = O.pin_mismatch(F.col("error_text"), F.col("provider_endpoint"), "gateway/Parasail")
    code = O.classify(
        F.col("error_text"), mismatch, F.col("finish_reason"), F.col("parsed_answer"),
        F.col("parsed_answer") == "A",
    )
    return calls.select("call_id", code.alias("raw_outcome"))


@query("pr3_provider_match", ctes=(T.CALLS_SQL,), sql=f"""
SELECT coalesce(provider_endpoint, '(none)') AS provider, {MATCH_SQL} AS matches, count(*) AS n FROM calls GROUP BY 1, 2""")
def _(spark, d):
    observed = F.col("provider_endpoint")
    return T.calls(spark, d).groupBy(
        F.coalesce(observed, F.lit("(none)")).alias("provider"),
        O.provider_matches(observed, "Parasail").alias("matches"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("pr4_cost_imputation", ctes=(T.CALLS_SQL,), sql="""
SELECT call_id, CAST(CASE WHEN coalesce(reported_cost, 0) <> 0 THEN reported_cost
    ELSE round_even((prompt_tokens * 0.3::DOUBLE + completion_tokens * 1.2::DOUBLE) * 1.10::DOUBLE, 0) END AS BIGINT) AS cost_microdollars,
  CASE WHEN coalesce(reported_cost, 0) <> 0 THEN 'provider' ELSE 'price_table' END AS cost_source FROM calls""")
def _(spark, d):
    estimate = O.estimated_microdollars(F.col("prompt_tokens"), F.col("completion_tokens"), 0.3, 1.2)
    cost = F.col("reported_cost")
    return T.calls(spark, d).select(
        "call_id", O.imputed_cost(cost, estimate).alias("cost_microdollars"), O.cost_source(cost).alias("cost_source")
    )


@query("pr9_completed_only", ctes=(T.CALLS_SQL,), sql="""
SELECT call_id, outcome FROM calls WHERE outcome IN ('pass', 'fail_wrong')""")
def _(spark, d):
    return T.calls(spark, d).where(O.is_completed(F.col("outcome"))).select("call_id", "outcome")


@query("pr10_id_hash", ctes=(T.INSTANCES_SQL,), sql="""
SELECT instance_id, substr(sha256(instance_id), 1, 16) AS hash16, substr(sha256(instance_id), 1, 24) AS hash24
FROM instances""")
def _(spark, d):
    key = F.col("instance_id")
    return T.instances(spark, d).select("instance_id", id_hash(key).alias("hash16"), id_hash(key, 24).alias("hash24"))


REQUEST = ["model", "provider_only", "max_completion_tokens", "temperature", "reasoning_effort", "prompt_version", "stream_telemetry"]


@query("pr13_request_fingerprint", ctes=(T.CALLS_SQL,), sql="""
, f AS (SELECT model_id, '{"max_completion_tokens":' || max_tokens || ',"model":"' || model_id || '","prompt_version":1,'
  || '"provider_only":["Parasail"],"reasoning_effort":"' || effort || '","stream_telemetry":' ||
  (CASE WHEN call_id % 5 = 0 THEN 'true' ELSE 'false' END) || ',"temperature":1.0}' AS request FROM calls)
SELECT model_id, request, count(*) AS n, CAST(count(*) OVER (PARTITION BY model_id) AS BIGINT) AS conditions
FROM f GROUP BY model_id, request""")
def _(spark, d):
    shaped = T.calls(spark, d).select(
        "model_id", F.col("model_id").alias("model"), F.array(F.lit("Parasail")).alias("provider_only"),
        F.col("max_tokens").alias("max_completion_tokens"), F.lit(1.0).alias("temperature"),
        F.col("effort").alias("reasoning_effort"), "prompt_version",
        (F.col("call_id") % 5 == 0).alias("stream_telemetry"),
    ).select("model_id", fingerprint(REQUEST).alias("request"))
    kinds = shaped.groupBy("model_id", "request").agg(F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy("model_id").agg(F.count(F.lit(1)).alias("conditions"))
    return kinds.join(mixed, "model_id")


@query("pr14_spend_usd", ctes=(T.CALLS_SQL,), sql="""
SELECT model_id, round(CAST(sum(cost_microdollars) AS DOUBLE) / 1000000.0, 6) AS spend_usd FROM calls GROUP BY model_id""")
def _(spark, d):
    return T.calls(spark, d).groupBy("model_id").agg(O.usd(F.sum("cost_microdollars")).alias("spend_usd"))


@query("wn3_stop_now", ctes=(T.CALLS_SQL,), sql=f"SELECT *, {STOP_SQL} AS stop_reason FROM ({STATUS_SQL})")
def _(spark, d):
    return S.should_stop(S.study_status(T.calls(spark, d)), LIMITS)


@query("wn3_first_stopping_call", ctes=(T.CALLS_SQL,), sql=f"""
, run AS (SELECT stage, model_id, call_id,
  CAST(sum((outcome = 'pass')::INT) OVER w AS BIGINT) AS correct, CAST(sum((outcome = 'fail_wrong')::INT) OVER w AS BIGINT) AS silent_wrong,
  CAST(count(*) OVER w AS BIGINT) AS calls, CAST(sum(cost_microdollars) OVER w AS BIGINT) AS spend_microdollars
  FROM calls WINDOW w AS (PARTITION BY stage, model_id ORDER BY call_id)),
flag AS (SELECT *, {STOP_SQL} AS stop_reason FROM run)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY stage, model_id ORDER BY call_id) AS rn
  FROM flag WHERE stop_reason IS NOT NULL) WHERE rn = 1""")
def _(spark, d):
    return S.first_stop(T.calls(spark, d), LIMITS)


@query("wn3_first_stop_null_stage", ctes=(T.CALLS_SQL,), sql=f"""
, blanked AS (SELECT * REPLACE (CASE WHEN stage = '{MAIN}' THEN NULL ELSE stage END AS stage) FROM calls),
run AS (SELECT stage, model_id, call_id,
  CAST(sum((outcome = 'pass')::INT) OVER w AS BIGINT) AS correct, CAST(sum((outcome = 'fail_wrong')::INT) OVER w AS BIGINT) AS silent_wrong,
  CAST(count(*) OVER w AS BIGINT) AS calls, CAST(sum(cost_microdollars) OVER w AS BIGINT) AS spend_microdollars
  FROM blanked WINDOW w AS (PARTITION BY stage, model_id ORDER BY call_id)),
flag AS (SELECT *, {STOP_SQL} AS stop_reason FROM run)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY stage, model_id ORDER BY call_id) AS rn
  FROM flag WHERE stop_reason IS NOT NULL) WHERE rn = 1""")
def _(spark, d):
    calls = T.calls(spark, d)
    return S.first_stop(calls.withColumn("stage", F.when(F.col("stage") != MAIN, F.col("stage"))), LIMITS)


@query("wn4_budget_replay", ctes=(T.CALLS_SQL,), sql="""
, c AS (SELECT stage, model_id, start_us, greatest(end_us, start_us + 1) AS end_us, cost_microdollars FROM calls),
starts AS (SELECT stage, model_id, start_us, count(*) AS admitted FROM c GROUP BY 1, 2, 3),
s AS (SELECT s.stage, s.model_id, s.start_us, max(s.admitted) AS admitted,
  CAST(coalesce(sum(c.cost_microdollars) FILTER (WHERE c.end_us <= s.start_us), 0) AS BIGINT) AS spent,
  CAST(count(*) FILTER (WHERE c.start_us < s.start_us AND c.end_us > s.start_us) AS BIGINT) AS in_flight
  FROM starts s JOIN c ON c.stage = s.stage AND c.model_id = s.model_id GROUP BY 1, 2, 3)
SELECT *, spent + (in_flight + 1) * 89148 AS needed, spent + (in_flight + 1) * 89148 > 100000000 AS would_breach FROM s""")
def _(spark, d):
    return S.budget_replay(T.calls(spark, d), 89_148, 100_000_000)
