"""The given tables seen as call logs.

Each adapter is a projection of one or two tables, so column pruning and
filters reach the parquet scan. ``*_SQL`` beside an adapter is the same mapping
as a common table expression, used by the check queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.operators.ordered import prefix_sums, ranked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    seconds = (
        F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400
        + F.hour(ts) * 3_600 + F.minute(ts) * 60
    )
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return seconds * 1_000_000 + micros


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances_from(table(spark, sf_dir, "customer"))


def instances_from(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "cast(c_custkey AS string) AS instance_id",
        "'study' AS set_name",
        "cast(c_nationkey AS bigint) AS level_idx",
        "(20 + 2 * c_nationkey) / 10.0D AS level_value",
        "c_custkey AS seed",
    )


INSTANCES_SQL = """instances AS (
  SELECT CAST(c_custkey AS VARCHAR) AS instance_id, 'study' AS set_name,
         CAST(c_nationkey AS BIGINT) AS level_idx,
         CAST(20 + 2 * c_nationkey AS DOUBLE) / 10.0 AS level_value, c_custkey AS seed
  FROM customer)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from(table(spark, sf_dir, "orders"))


def calls_from(orders: DataFrame) -> DataFrame:
    first = orders.select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_custkey").cast("string").alias("instance_id"),
        F.expr("concat('model-', o_orderkey % 3)").alias("model_id"),
        F.expr("concat('stage-', year(o_orderdate))").alias("stage"),
        F.expr(
            """CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail_wrong'
               ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'error_api'
                    WHEN '2' THEN 'provider_mismatch' WHEN '3' THEN 'fail_parse'
                    ELSE 'fail_truncated' END END"""
        ).alias("outcome"),
        F.expr("cast(floor(o_totalprice / 10) AS bigint)").alias("completion_tokens"),
        F.expr("cast(floor(o_totalprice) AS bigint)").alias("cost_microdollars"),
        (epoch_us(F.col("o_orderdate")) + (F.col("o_orderkey") % 600) * 1_000_000).alias("start_us"),
        F.col("o_orderpriority").alias("prompt_topic"),
    )
    return first.selectExpr(
        "*",
        "1L AS prompt_version",
        "500 + call_id % 1500 AS prompt_tokens",
        "CASE WHEN outcome = 'error_api' THEN 'error' WHEN outcome = 'fail_truncated' THEN 'length' "
        "WHEN call_id % 2 = 0 THEN 'completed' ELSE 'stop' END AS finish_reason",
        "CASE WHEN outcome = 'pass' THEN 'A' WHEN outcome = 'fail_wrong' THEN concat('W', call_id % 3) END AS parsed_answer",
        "CASE WHEN call_id % 7 <> 0 THEN cast(floor(0.8D * completion_tokens) AS bigint) END AS reasoning_tokens",
        "CASE WHEN call_id % 11 = 0 THEN NULL WHEN call_id % 13 = 0 THEN 0.0D "
        "ELSE cast(10 * completion_tokens + call_id % 1000 AS double) END AS latency_ms",
        "CASE call_id % 5 WHEN 0 THEN 'gateway/Parasail' WHEN 1 THEN ' parasail ' "
        "WHEN 2 THEN 'Other' WHEN 3 THEN '' END AS provider_endpoint",
        "CASE WHEN call_id % 17 = 0 THEN 0 WHEN call_id % 19 = 0 THEN NULL ELSE 1 END AS provider_pinned",
        "CASE WHEN outcome = 'provider_mismatch' THEN 1 ELSE 0 END AS provider_mismatch",
        "CASE WHEN call_id % 23 = 0 THEN NULL WHEN call_id % 29 = 0 THEN 0L ELSE 1 + call_id % 3 END AS attempt",
        "CASE WHEN call_id % 6 <> 0 THEN cost_microdollars END AS reported_cost",
        "CASE WHEN outcome = 'error_api' THEN 'connection reset' END AS error_text",
        "CASE WHEN call_id % 9 <> 0 THEN concat('FINAL: ', call_id) END AS response_text",
        "CASE WHEN call_id % 10 <> 0 THEN concat('about ', prompt_topic) END AS reasoning_text",
        "CASE WHEN call_id % 4 = 0 THEN 32768L ELSE 65536L END AS max_tokens",
        "CASE WHEN call_id % 2 = 0 THEN 'high' ELSE 'medium' END AS effort",
        "start_us + CASE WHEN call_id % 11 = 0 OR call_id % 13 = 0 THEN 0L "
        "ELSE (10 * completion_tokens + call_id % 1000) * 1000 END AS end_us",
    )


CALLS_SQL = """calls0 AS (
  SELECT o_orderkey AS call_id, CAST(o_custkey AS VARCHAR) AS instance_id,
    'model-' || (o_orderkey % 3) AS model_id, 'stage-' || year(o_orderdate) AS stage,
    CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail_wrong'
      ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'error_api' WHEN '2' THEN 'provider_mismatch'
           WHEN '3' THEN 'fail_parse' ELSE 'fail_truncated' END END AS outcome,
    CAST(floor(o_totalprice / 10) AS BIGINT) AS completion_tokens,
    CAST(floor(o_totalprice) AS BIGINT) AS cost_microdollars,
    epoch_us(o_orderdate) + (o_orderkey % 600) * 1000000 AS start_us, o_orderpriority AS prompt_topic
  FROM orders),
calls AS (
  SELECT *, CAST(1 AS BIGINT) AS prompt_version, 500 + call_id % 1500 AS prompt_tokens,
    CASE WHEN outcome = 'error_api' THEN 'error' WHEN outcome = 'fail_truncated' THEN 'length'
         WHEN call_id % 2 = 0 THEN 'completed' ELSE 'stop' END AS finish_reason,
    CASE WHEN outcome = 'pass' THEN 'A' WHEN outcome = 'fail_wrong' THEN 'W' || (call_id % 3) END AS parsed_answer,
    CASE WHEN call_id % 7 <> 0 THEN CAST(floor(CAST(0.8 AS DOUBLE) * completion_tokens) AS BIGINT) END AS reasoning_tokens,
    CASE WHEN call_id % 11 = 0 THEN NULL WHEN call_id % 13 = 0 THEN CAST(0 AS DOUBLE)
         ELSE CAST(10 * completion_tokens + call_id % 1000 AS DOUBLE) END AS latency_ms,
    CASE call_id % 5 WHEN 0 THEN 'gateway/Parasail' WHEN 1 THEN ' parasail '
         WHEN 2 THEN 'Other' WHEN 3 THEN '' END AS provider_endpoint,
    CASE WHEN call_id % 17 = 0 THEN 0 WHEN call_id % 19 = 0 THEN NULL ELSE 1 END AS provider_pinned,
    CASE WHEN outcome = 'provider_mismatch' THEN 1 ELSE 0 END AS provider_mismatch,
    CASE WHEN call_id % 23 = 0 THEN NULL WHEN call_id % 29 = 0 THEN 0 ELSE 1 + call_id % 3 END AS attempt,
    CASE WHEN call_id % 6 <> 0 THEN cost_microdollars END AS reported_cost,
    CASE WHEN outcome = 'error_api' THEN 'connection reset' END AS error_text,
    CASE WHEN call_id % 9 <> 0 THEN 'FINAL: ' || call_id END AS response_text,
    CASE WHEN call_id % 10 <> 0 THEN 'about ' || prompt_topic END AS reasoning_text,
    CAST(CASE WHEN call_id % 4 = 0 THEN 32768 ELSE 65536 END AS BIGINT) AS max_tokens,
    CASE WHEN call_id % 2 = 0 THEN 'high' ELSE 'medium' END AS effort,
    start_us + CASE WHEN call_id % 11 = 0 OR call_id % 13 = 0 THEN 0
                    ELSE (10 * completion_tokens + call_id % 1000) * 1000 END AS end_us
  FROM calls0)"""


def sampled_calls(spark: SparkSession, sf_dir: str, only: Callable[[DataFrame], DataFrame] = lambda calls: calls) -> DataFrame:
    """Calls with the sample ordinal inside (instance, model, stage). ``only``
    picks whole groups of these before they are ranked."""
    return ranked(
        only(calls(spark, sf_dir)), "call_id", ["instance_id", "model_id", "stage"], name="sample_idx"
    )


SAMPLED_SQL = (
    CALLS_SQL
    + """,
sampled AS (
  SELECT *, row_number() OVER (PARTITION BY instance_id, model_id, stage ORDER BY call_id) - 1 AS sample_idx
  FROM calls)"""
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "doc_id AS call_id", "source AS instance_id", "cast(quality AS bigint) AS label",
        "(1 + (n_chars * 7919 + doc_id * 104729) % 98) / 100.0D AS prediction",
        "CASE lang WHEN 'en' THEN 0.9D WHEN 'fr' THEN 0.8D WHEN 'de' THEN 0.7D ELSE 0.6D END AS curve_prior",
        "lang", "cast(toxic AS bigint) AS toxic", "n_chars",
    )


PREDICTIONS_SQL = """predictions AS (
  SELECT d.doc_id AS call_id, source AS instance_id, CAST(quality AS BIGINT) AS label,
    CAST(1 + (n_chars * 7919 + d.doc_id * 104729) % 98 AS DOUBLE) / 100.0 AS prediction,
    CAST(CASE lang WHEN 'en' THEN 0.9 WHEN 'fr' THEN 0.8 WHEN 'de' THEN 0.7 ELSE 0.6 END AS DOUBLE) AS curve_prior,
    lang, CAST(toxic AS BIGINT) AS toxic, n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def raw_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed chunks before numbering: microseconds stand in for the sequence."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"),
        "event_id",
        epoch_us(F.col("ts")).alias("at_us"),
        F.when(F.col("event_type").isin("click", "view"), "reasoning").otherwise("answer").alias("channel"),
        F.floor("value").cast("bigint").alias("char_count"),
        "event_type",
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_stream_events(spark, sf_dir)
    numbered = prefix_sums(
        raw.withColumn("one", F.lit(1).cast("bigint")), "at_us", {"seq": "one"}, ["call_id"],
        order=["at_us", "event_id"], tie="event_id", minima={"start_us": "at_us"},
    )
    return numbered.select(
        "call_id", "seq", ((F.col("at_us") - F.col("start_us")) / F.lit(1000.0)).alias("elapsed_ms"),
        "channel", "char_count", "event_type",
    )


STREAM_EVENTS_SQL = """stream_events AS (
  SELECT user_id AS call_id, row_number() OVER w - 1 AS seq,
    CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 1000.0 AS elapsed_ms,
    CASE WHEN event_type IN ('click', 'view') THEN 'reasoning' ELSE 'answer' END AS channel,
    CAST(floor(value) AS BIGINT) AS char_count, event_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


VARIABLES = 20
CLAUSES = 8


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers with the formula each must satisfy."""
    e = table(spark, sf_dir, "embeddings")
    return e.selectExpr(
        "vec_id AS call_id",
        f"transform(sequence(1, {VARIABLES}), i -> element_at(embedding, i) > 0) AS bits",
        f"transform(sequence(1, {CLAUSES}), j -> transform(sequence(1, 3), m -> "
        f"cast((1 + (7 * vec_id + 3 * j + 5 * m) % {VARIABLES}) * "
        "(CASE WHEN (vec_id + j + m) % 2 = 0 THEN 1 ELSE -1 END) AS int))) AS clauses",
        "label",
    ).selectExpr(
        "call_id", "clauses", "label",
        "transform(bits, b -> CASE WHEN b THEN '1' ELSE '0' END) AS digits",
    ).selectExpr(
        "call_id", "clauses",
        "concat('work\\n', 'FINAL: ', CASE call_id % 3 WHEN 0 THEN array_join(digits, ' ') "
        f"WHEN 1 THEN array_join(digits, '') ELSE array_join(slice(digits, 1, {VARIABLES - 1}), ' ') END) AS response_text",
        "CASE WHEN call_id % 10 = 9 THEN 'length' WHEN call_id % 2 = 0 THEN 'completed' ELSE 'stop' END AS finish_reason",
        "CASE WHEN call_id % 20 = 4 THEN 1 ELSE 0 END AS provider_mismatch",
        "CASE label % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail_wrong' ELSE 'fail_parse' END AS outcome",
        "CASE WHEN label % 3 = 0 THEN concat('[', array_join(transform(digits, d -> CASE WHEN d = '1' THEN 'true' ELSE 'false' END), ', '), ']') END AS parsed_answer",
    )


COMPLETIONS_SQL = f"""completions0 AS (
  SELECT vec_id AS call_id, label, vec_id,
    [CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END for i in range(1, {VARIABLES + 1})] AS digits
  FROM embeddings),
completions AS (
  SELECT call_id, vec_id,
    'work' || chr(10) || 'FINAL: ' || CASE call_id % 3 WHEN 0 THEN array_to_string(digits, ' ')
       WHEN 1 THEN array_to_string(digits, '') ELSE array_to_string(digits[1:{VARIABLES - 1}], ' ') END AS response_text,
    CASE WHEN call_id % 10 = 9 THEN 'length' WHEN call_id % 2 = 0 THEN 'completed' ELSE 'stop' END AS finish_reason,
    CASE WHEN call_id % 20 = 4 THEN 1 ELSE 0 END AS provider_mismatch,
    CASE label % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail_wrong' ELSE 'fail_parse' END AS outcome,
    CASE WHEN label % 3 = 0 THEN '[' || array_to_string([CASE WHEN d = '1' THEN 'true' ELSE 'false' END for d in digits], ', ') || ']' END AS parsed_answer,
    [CASE WHEN d = '1' THEN true ELSE false END for d in digits] AS given,
    [[(1 + (7 * vec_id + 3 * j + 5 * m) % {VARIABLES}) * (CASE WHEN (vec_id + j + m) % 2 = 0 THEN 1 ELSE -1 END)
      for m in range(1, 4)] for j in range(1, {CLAUSES + 1})] AS clauses
  FROM completions0)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning texts with the facts of their call; the text itself goes last
    so that narrow plans prune it."""
    return traces_from(table(spark, sf_dir, "documents"))


def traces_from(documents: DataFrame) -> DataFrame:
    """Long texts and high levels are wrong more often, so that there is
    something to learn; every level and route has both outcomes."""
    return documents.selectExpr(
        "doc_id AS call_id", "concat(source, '-', doc_id % 10) AS instance_id", "concat('model-', doc_id % 3) AS model_id",
        "concat('route-', doc_id % 2) AS route", "lang",
        "CASE WHEN doc_id div 10 % 7 < CASE WHEN n_chars > 2500 THEN 3 ELSE 1 END + CASE WHEN doc_id % 5 >= 3 THEN 1 ELSE 0 END "
        "THEN 'fail_wrong' WHEN doc_id div 10 % 7 = 6 THEN 'fail_truncated' ELSE 'pass' END AS outcome",
        "cast(100 + n_chars % 977 AS double) * 100.0D AS latency_ms",
        "cast(floor(n_chars / 3.0D) + doc_id % 50 + 1 AS bigint) AS completion_tokens",
        "CASE WHEN doc_id % 7 <> 0 THEN cast(floor(n_chars / 4.0D) AS bigint) END AS reasoning_tokens",
        "1 + doc_id % 3 AS attempt", "CASE WHEN doc_id % 11 = 0 THEN 'length' ELSE 'stop' END AS finish_reason",
        "(20 + 2 * (doc_id % 5)) / 10.0D AS level_value",
        "concat(lang, ' the answer is ', source) AS response_text",
        "n_chars", "text AS reasoning_text",
    )


TRACES_SQL = """traces AS (
  SELECT doc_id AS call_id, source || '-' || (doc_id % 10) AS instance_id, 'model-' || (doc_id % 3) AS model_id,
    'route-' || (doc_id % 2) AS route, lang,
    CASE WHEN doc_id // 10 % 7 < CASE WHEN n_chars > 2500 THEN 3 ELSE 1 END + CASE WHEN doc_id % 5 >= 3 THEN 1 ELSE 0 END
      THEN 'fail_wrong' WHEN doc_id // 10 % 7 = 6 THEN 'fail_truncated' ELSE 'pass' END AS outcome,
    CAST(100 + n_chars % 977 AS DOUBLE) * 100.0 AS latency_ms,
    CAST(floor(CAST(n_chars AS DOUBLE) / 3.0) AS BIGINT) + doc_id % 50 + 1 AS completion_tokens,
    CAST(20 + 2 * (doc_id % 5) AS DOUBLE) / 10.0 AS level_value,
    lang || ' the answer is ' || source AS response_text, n_chars, text AS reasoning_text
  FROM documents)"""


def captured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured event-stream lines: one row per line, numbered in its stream."""
    split = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("stream_id"), "turn",
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"),
    )
    return split.select(
        "stream_id",
        (F.col("turn") * 1_000_000 + F.col("pos")).alias("line_no"),
        (F.col("turn") * 1000.0 + F.col("pos")).alias("elapsed_ms"),
        F.expr(
            "CASE WHEN pos % 4 = 3 THEN '' WHEN pos % 4 = 1 THEN ': comment' "
            "WHEN pos % 8 = 6 THEN 'data' WHEN pos % 8 = 4 THEN concat('data:', raw) "
            "ELSE concat('data: ', raw) END"
        ).alias("line"),
    )


CAPTURED_SQL = """split_lines AS (
  SELECT conv_id AS stream_id, turn, string_split(text, chr(10)) AS parts FROM conversations),
numbered AS (
  SELECT stream_id, turn, unnest(range(len(parts))) AS pos, unnest(parts) AS raw FROM split_lines),
captured AS (
  SELECT stream_id, turn * 1000000 + pos AS line_no, CAST(turn * 1000 + pos AS DOUBLE) AS elapsed_ms,
    CASE WHEN pos % 4 = 3 THEN '' WHEN pos % 4 = 1 THEN ': comment' WHEN pos % 8 = 6 THEN 'data'
      WHEN pos % 8 = 4 THEN 'data:' || raw ELSE 'data: ' || raw END AS line
  FROM numbered)"""


def chunk_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decoded event payload per row of events, as the provider would send
    it: JSON deltas on two channels, a few malformed, an error, a finish."""
    return raw_stream_events(spark, sf_dir).select(
        F.col("call_id").alias("stream_id"), F.col("event_id").alias("line_no"),
        (F.col("at_us") / F.lit(1000.0)).alias("elapsed_ms"),
        F.expr(
            """CASE WHEN event_id % 50 = 49 THEN '[DONE]'
               WHEN event_id % 40 = 39 THEN concat('{"choices": [', event_id)
               WHEN event_id % 30 = 29 THEN concat('{"error": {"code": ', event_id % 7 + 500, ', "message": "busy ', event_type, '"}}')
               WHEN event_id % 25 = 24 THEN concat('{"provider": "P', event_id % 3, '", "choices": [{"delta": {}, "finish_reason": "', CASE WHEN event_id % 2 = 0 THEN 'stop' ELSE 'length' END, '"}], "usage": {"prompt_tokens": ', event_id % 100, ', "completion_tokens": ', char_count, ', "cost": 0.0', event_id % 9 + 1, ', "completion_tokens_details": {"reasoning_tokens": ', char_count DIV 2, '}}}')
               WHEN channel = 'reasoning' AND event_id % 3 = 0 THEN concat('{"choices": [{"delta": {"reasoning": "', event_type, '", "content": "', repeat('x', cast(char_count % 9 AS int)), '"}}]}')
               WHEN channel = 'reasoning' THEN concat('{"choices": [{"delta": {"reasoning_content": "', repeat('r', cast(char_count % 5 AS int)), '"}}]}')
               ELSE concat('{"choices": [{"delta": {"content": "', repeat('a', cast(char_count % 7 AS int)), '"}}]}') END"""
        ).alias("data"),
    )


CHUNK_PAYLOADS_SQL = """raw_events AS (
  SELECT user_id AS call_id, event_id, epoch_us(ts) AS at_us,
    CASE WHEN event_type IN ('click', 'view') THEN 'reasoning' ELSE 'answer' END AS channel,
    CAST(floor(value) AS BIGINT) AS char_count, event_type FROM events),
chunk_payloads AS (
  SELECT call_id AS stream_id, event_id AS line_no, CAST(at_us AS DOUBLE) / 1000.0 AS elapsed_ms,
    CASE WHEN event_id % 50 = 49 THEN '[DONE]'
      WHEN event_id % 40 = 39 THEN '{"choices": [' || event_id
      WHEN event_id % 30 = 29 THEN '{"error": {"code": ' || (event_id % 7 + 500) || ', "message": "busy ' || event_type || '"}}'
      WHEN event_id % 25 = 24 THEN '{"provider": "P' || (event_id % 3) || '", "choices": [{"delta": {}, "finish_reason": "' || (CASE WHEN event_id % 2 = 0 THEN 'stop' ELSE 'length' END) || '"}], "usage": {"prompt_tokens": ' || (event_id % 100) || ', "completion_tokens": ' || char_count || ', "cost": 0.0' || (event_id % 9 + 1) || ', "completion_tokens_details": {"reasoning_tokens": ' || (char_count // 2) || '}}}'
      WHEN channel = 'reasoning' AND event_id % 3 = 0 THEN '{"choices": [{"delta": {"reasoning": "' || event_type || '", "content": "' || repeat('x', CAST(char_count % 9 AS INTEGER)) || '"}}]}'
      WHEN channel = 'reasoning' THEN '{"choices": [{"delta": {"reasoning_content": "' || repeat('r', CAST(char_count % 5 AS INTEGER)) || '"}}]}'
      ELSE '{"choices": [{"delta": {"content": "' || repeat('a', CAST(char_count % 7 AS INTEGER)) || '"}}]}' END AS data
  FROM raw_events)"""


def upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated writes of the same key, as a log of versions."""
    return upsert_log_from(table(spark, sf_dir, "lineitem"))


def upsert_log_from(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "cast(l_orderkey AS string) AS instance_id", "'model-0' AS model_id",
        "cast(l_linenumber AS bigint) AS sample_idx", "1L AS prompt_version", "'study' AS stage",
        "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "cast(floor(l_extendedprice) AS bigint) AS cost_microdollars",
        "CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'fail_wrong' ELSE 'error_api' END AS outcome",
    )


UPSERT_SQL = """upsert_log AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS instance_id, 'model-0' AS model_id,
    CAST(l_linenumber AS BIGINT) AS sample_idx, CAST(1 AS BIGINT) AS prompt_version, 'study' AS stage,
    l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    CAST(floor(l_extendedprice) AS BIGINT) AS cost_microdollars,
    CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'fail_wrong' ELSE 'error_api' END AS outcome
  FROM lineitem)"""
