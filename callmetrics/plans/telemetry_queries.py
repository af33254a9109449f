"""Event streams, payloads and rescoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callmetrics.functions import answers as A
from callmetrics.functions import envelope as E
from callmetrics.operators import rescore as RS
from callmetrics.operators import status as S
from callmetrics.operators import telemetry as TM
from callmetrics.plans.registry import query
from callmetrics.session import materialize
from callmetrics.sources import tables as T

EVENTS_SQL = """flagged AS (SELECT *, count(*) FILTER (WHERE line = '') OVER (PARTITION BY stream_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g,
  CASE WHEN line = 'data' THEN '' WHEN starts_with(line, 'data: ') THEN substr(line, 7) WHEN starts_with(line, 'data:') THEN substr(line, 6) END AS value
  FROM captured),
reassembled AS (SELECT stream_id, max(line_no) AS line_no, max(elapsed_ms) AS elapsed_ms,
  string_agg(value, chr(10) ORDER BY line_no) FILTER (WHERE value IS NOT NULL) AS data
  FROM flagged WHERE line = '' OR value IS NOT NULL GROUP BY stream_id, g HAVING count(value) > 0)"""


@query("ss1_event_reassembly", ctes=(T.CAPTURED_SQL, EVENTS_SQL), sql="SELECT stream_id, line_no, elapsed_ms, data FROM reassembled")
def reassembly(spark, d):
    return TM.reassemble(T.captured_lines(spark, d))


PARSED_SQL = """good AS (SELECT *, CASE WHEN json_valid(data) THEN data END AS j FROM chunk_payloads WHERE data <> '[DONE]'),
two_ways AS (SELECT stream_id, line_no, elapsed_ms, 0 AS part, 'reasoning' AS channel,
    length(coalesce(nullif(json_extract_string(j, '$.choices[0].delta.reasoning'), ''), json_extract_string(j, '$.choices[0].delta.reasoning_content'), '')) AS char_count FROM good
  UNION ALL SELECT stream_id, line_no, elapsed_ms, 1, 'answer', length(coalesce(json_extract_string(j, '$.choices[0].delta.content'), '')) FROM good),
chunk AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no, part) - 1 AS seq, elapsed_ms, channel, char_count
  FROM two_ways WHERE char_count > 0)"""
CHUNK_CTES = (T.CHUNK_PAYLOADS_SQL, PARSED_SQL)


def stored_events(spark, d):
    """The numbered chunks as the table a collector would have stored."""
    return materialize(T.stream_events(spark, d))


def decoded(spark, d):
    return TM.decoded(T.chunk_payloads(spark, d))


@query("ss2_chunk_events", ctes=CHUNK_CTES, sql="SELECT stream_id, seq, elapsed_ms, channel, char_count FROM chunk")
def chunk_events(spark, d):
    return TM.chunks(decoded(spark, d))


@query("ss3_first_tokens", ctes=CHUNK_CTES, sql="""
, f AS (SELECT stream_id, arg_min(elapsed_ms, seq) FILTER (WHERE channel = 'reasoning') AS first_reasoning_ms,
  arg_min(elapsed_ms, seq) FILTER (WHERE channel = 'answer') AS first_answer_ms FROM chunk GROUP BY stream_id)
SELECT *, least(first_reasoning_ms, first_answer_ms) AS ttft_ms FROM f""")
def _(spark, d):
    return TM.first_tokens(TM.chunks(decoded(spark, d)))


TERMINAL_SQL = """facts AS (SELECT stream_id, line_no, CASE WHEN j IS NULL THEN 'malformed SSE event'
    WHEN json_extract_string(j, '$.error.code') IS NOT NULL THEN 'stream error ' || json_extract_string(j, '$.error.code') || ': ' || json_extract_string(j, '$.error.message') END AS error,
  json_extract_string(j, '$.provider') AS provider, json_extract_string(j, '$.choices[0].finish_reason') AS finish,
  CASE WHEN json_extract(j, '$.usage') IS NOT NULL THEN line_no END AS has_usage, j FROM good),
ends AS (SELECT stream_id, arg_max(provider, line_no) FILTER (WHERE provider IS NOT NULL) AS provider,
  arg_max(error, line_no) FILTER (WHERE error IS NOT NULL) AS error, arg_max(finish, line_no) FILTER (WHERE finish IS NOT NULL) AS finish,
  arg_max(j, has_usage) AS u, count(*) FILTER (WHERE j IS NULL) AS rejected_events FROM facts GROUP BY stream_id),
terminal AS (SELECT stream_id, coalesce(provider, '') AS provider, rejected_events,
  coalesce(json_extract_string(u, '$.usage.prompt_tokens')::BIGINT, 0) AS prompt_tokens,
  coalesce(json_extract_string(u, '$.usage.completion_tokens')::BIGINT, 0) AS completion_tokens,
  coalesce(json_extract_string(u, '$.usage.completion_tokens_details.reasoning_tokens')::BIGINT, 0) AS reasoning_tokens,
  coalesce(round_even(json_extract_string(u, '$.usage.cost')::DOUBLE * 1000000.0, 0)::BIGINT, 0) AS cost_microdollars,
  coalesce(error, CASE WHEN coalesce(finish, '') NOT IN ('stop', 'completed') THEN 'stream ended with finish_reason=' || coalesce(finish, 'missing') END) AS error_text, finish
  FROM ends)"""


@query("ss4_terminal_state", ctes=(*CHUNK_CTES, TERMINAL_SQL), sql="""
SELECT stream_id, provider, rejected_events, prompt_tokens, completion_tokens, reasoning_tokens, cost_microdollars, error_text,
  CASE WHEN error_text IS NOT NULL THEN 'error' ELSE finish END AS finish_reason FROM terminal""")
def _(spark, d):
    return TM.terminal_state(decoded(spark, d))


@query("ss5_telemetry_report", ctes=(*CHUNK_CTES, TERMINAL_SQL), sql="""
, c AS (SELECT stream_id, count(*) AS stream_events, count(*) FILTER (WHERE channel = 'reasoning') AS reasoning_events,
  count(*) FILTER (WHERE channel = 'answer') AS answer_events,
  CAST(coalesce(sum(char_count) FILTER (WHERE channel = 'reasoning'), 0) AS BIGINT) AS reasoning_characters,
  CAST(coalesce(sum(char_count) FILTER (WHERE channel = 'answer'), 0) AS BIGINT) AS answer_characters, max(elapsed_ms) AS last_event_ms
  FROM chunk GROUP BY stream_id)
SELECT t.stream_id, rejected_events, CASE WHEN error_text IS NOT NULL THEN 'error' ELSE finish END AS finish_reason,
  stream_events, reasoning_events, answer_events, reasoning_characters, answer_characters, last_event_ms
FROM terminal t LEFT JOIN c USING (stream_id)""")
def _(spark, d):
    parsed = decoded(spark, d)
    return TM.telemetry_report(TM.chunks(parsed), TM.terminal_state(parsed))


@query("ss6_capture_completeness", ctes=(T.STREAM_EVENTS_SQL,), sql="""
, c AS (SELECT call_id, count(DISTINCT seq) AS captured, max(seq) + 1 AS expected FROM stream_events
  WHERE NOT ((seq * 7 + call_id) % (10 + call_id % 20) = 3) GROUP BY call_id)
SELECT *, round(captured::DOUBLE / expected, 6) AS completeness, captured::DOUBLE / expected >= 0.95 AS pass FROM c""")
def _(spark, d):
    kept = T.stream_events(spark, d).where("NOT ((seq * 7 + call_id) % (10 + call_id % 20) = 3)")
    return TM.capture_completeness(kept)


GAPS_SQL = """gaps AS (SELECT call_id, seq, channel, elapsed_ms - lag(elapsed_ms) OVER (PARTITION BY call_id ORDER BY seq) AS gap_ms FROM stream_events)"""


@query("wn6_inter_chunk_gaps", ctes=(T.STREAM_EVENTS_SQL, GAPS_SQL), sql="SELECT call_id, seq, channel, gap_ms FROM gaps")
def chunk_gaps(spark, d):
    return TM.inter_chunk_gaps(stored_events(spark, d)).select("call_id", "seq", "channel", "gap_ms")


@query("wn6_gap_quantiles", ctes=(T.STREAM_EVENTS_SQL, GAPS_SQL), sql="""
SELECT channel, count(gap_ms) AS n, round(quantile_cont(gap_ms, 0.5), 6) AS p50, round(quantile_cont(gap_ms, 0.95), 6) AS p95,
  round(quantile_cont(gap_ms, 0.99), 6) AS p99 FROM gaps GROUP BY channel""")
def _(spark, d):
    gaps = materialize(TM.inter_chunk_gaps(stored_events(spark, d)).select("channel", "gap_ms"))
    out = TM.gap_quantiles(gaps, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["channel"])
    return out.select("channel", "n", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("wn6_output_rates", ctes=(T.STREAM_EVENTS_SQL,), sql="""
SELECT call_id, channel, count(*) AS chunks, CAST(sum(char_count) AS BIGINT) AS chars,
  CASE WHEN max(elapsed_ms) > min(elapsed_ms) THEN round(sum(char_count) / ((max(elapsed_ms) - min(elapsed_ms)) / 1000.0), 6) END AS chars_per_second
FROM stream_events GROUP BY 1, 2""")
def _(spark, d):
    return TM.output_rates(T.stream_events(spark, d))


@query("pr11_envelope_flattening", ctes=(T.CALLS_SQL,), sql="""
SELECT call_id, CASE call_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'part one, part two' ELSE '[text] ' || prompt_topic END AS response_text,
  CASE WHEN call_id % 3 = 0 THEN 'r' || call_id WHEN call_id % 3 = 1 THEN 'c' || call_id ELSE '' END AS reasoning_text,
  finish_reason, CASE WHEN call_id % 5 = 4 THEN '' ELSE 'P' || (call_id % 5) END AS provider,
  prompt_tokens, completion_tokens, coalesce(reasoning_tokens, 0) AS reasoning_tokens,
  CASE WHEN call_id % 6 = 0 THEN 0 ELSE cost_microdollars END AS cost_microdollars FROM calls""")
def _(spark, d):
    raw = T.calls(spark, d).select(
        "call_id",
        F.expr(
            """concat('{"choices": [{"message": {',
              CASE call_id % 4 WHEN 0 THEN '"content": null' WHEN 1 THEN '"content": [{"text": "part one"}, ", ", {"kind": "x"}, {"text": "part two"}]'
                ELSE concat('"content": "[text] ', prompt_topic, '"') END,
              CASE call_id % 3 WHEN 0 THEN concat(', "reasoning": "r', call_id, '"') WHEN 1 THEN concat(', "reasoning": "", "reasoning_content": "c', call_id, '"') ELSE '' END,
              '}, "finish_reason": "', finish_reason, '"}]', CASE WHEN call_id % 5 = 4 THEN '' ELSE concat(', "provider": "P', call_id % 5, '"') END,
              ', "usage": {"prompt_tokens": ', prompt_tokens, ', "completion_tokens": ', completion_tokens,
              CASE WHEN reasoning_tokens IS NULL THEN '' ELSE concat(', "completion_tokens_details": {"reasoning_tokens": ', reasoning_tokens, '}') END,
              CASE WHEN call_id % 6 = 0 THEN '' ELSE concat(', "cost": ', cost_microdollars DIV 1000000, '.', lpad(cost_microdollars % 1000000, 6, '0')) END, '}}')"""
        ).alias("body"),
    ).select("call_id", E.parsed(F.col("body")).alias("payload"))
    return raw.select("call_id", *[c.alias(n) for n, c in E.envelope_columns(F.col("payload")).items()])


@query("pr12_stream_errors", ctes=(T.CALLS_SQL,), sql="""
SELECT call_id, CASE call_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'stream error ' || (500 + call_id % 7) || ': ' || prompt_topic
  WHEN 2 THEN 'stream error unknown: ' || prompt_topic WHEN 3 THEN 'stream error: ' || prompt_topic END AS error_text FROM calls""")
def _(spark, d):
    body = F.expr(
        """CASE call_id % 5 WHEN 0 THEN '{"choices": []}'
           WHEN 1 THEN concat('{"error": {"code": ', 500 + call_id % 7, ', "message": "', prompt_topic, '"}}')
           WHEN 2 THEN concat('{"error": {"message": "', prompt_topic, '"}}')
           WHEN 3 THEN concat('{"error": "', prompt_topic, '"}') ELSE '{"error": null}' END"""
    )
    return T.calls(spark, d).select("call_id", E.stream_error(E.parsed(body)).alias("error_text"))


BITS_SQL = """parsed AS (SELECT *, CASE WHEN call_id % 3 <> 2 THEN given END AS bits FROM completions),
checked AS (SELECT *, len([c for c in clauses if len([x for x in c if bits[abs(x)] = (x > 0)]) > 0]) = len(clauses) AS ok FROM parsed),
fresh AS (SELECT *, CASE WHEN bits IS NULL THEN 'fail_parse' WHEN ok THEN 'pass' ELSE 'fail_wrong' END AS new_outcome,
  CASE WHEN bits IS NOT NULL THEN '[' || array_to_string([CASE WHEN b THEN 'true' ELSE 'false' END for b in bits], ', ') || ']' END AS new_parsed,
  provider_mismatch = 0 AND finish_reason IN ('stop', 'completed') AS eligible FROM checked)"""
RS_CTES = (T.COMPLETIONS_SQL, BITS_SQL)


@query("pr7_final_answer", ctes=RS_CTES, sql="SELECT call_id, new_parsed AS parsed_answer FROM fresh")
def _(spark, d):
    bits = A.final_bits(F.col("response_text"), T.VARIABLES)
    return T.completions(spark, d).select("call_id", A.assignment_json(bits).alias("parsed_answer"))


@query("pr8_certificate_check", ctes=RS_CTES, sql="SELECT call_id, ok AS satisfied FROM fresh WHERE bits IS NOT NULL")
def _(spark, d):
    rows = T.completions(spark, d).select(
        "call_id", "clauses", A.final_bits(F.col("response_text"), T.VARIABLES).alias("bits")
    ).where(F.col("bits").isNotNull())
    return rows.select("call_id", A.satisfies(F.col("clauses"), F.col("bits")).alias("satisfied"))


@query("jn6_rescore_changes", ctes=RS_CTES, sql="""
SELECT call_id, outcome AS before, new_outcome AS after FROM fresh WHERE eligible AND
  (new_outcome IS DISTINCT FROM outcome OR new_parsed IS DISTINCT FROM parsed_answer)""")
def _(spark, d):
    return RS.changes(T.completions(spark, d), T.VARIABLES).select("call_id", "before", F.col("outcome").alias("after"))


@query("rs1_rescored_status", ctes=RS_CTES, sql="""
SELECT count(*) AS calls, count(*) FILTER (WHERE o = 'pass') AS correct, count(*) FILTER (WHERE o = 'fail_wrong') AS silent_wrong,
  count(*) FILTER (WHERE o NOT IN ('pass', 'fail_wrong')) AS loud FROM (SELECT CASE WHEN eligible THEN new_outcome ELSE outcome END AS o FROM fresh)""")
def _(spark, d):
    done = RS.apply_rescoring(T.completions(spark, d), T.VARIABLES)
    return done.agg(F.count(F.lit(1)).alias("calls"), *S.outcome_counts())
