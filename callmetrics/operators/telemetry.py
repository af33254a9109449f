"""Captured event streams: reassembly, chunks, first tokens, terminal state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import envelope as E
from callmetrics.functions import outcomes as O
from callmetrics.operators.ordered import lagged, prefix_sums, quantiles, ranked
from callmetrics.session import materialize


def field_value(line: Column) -> Column:
    """Text of a data field, one leading space removed; NULL for other lines."""
    rest = F.substring(line, 6, 2_147_483_647)
    return F.when(line == "data", "").when(
        line.startswith("data:"), F.when(rest.startswith(" "), F.substring(rest, 2, 2_147_483_647)).otherwise(rest)
    )


def reassemble(lines: DataFrame) -> DataFrame:
    """``lines(stream_id, line_no, elapsed_ms, line)`` to one row per event. A
    blank line ends an event, the end of the stream ends the last one, and an
    event without data fields does not exist. An event arrives with the line
    that ends it."""
    useful = lines.select(
        "stream_id", "line_no", "elapsed_ms", field_value(F.col("line")).alias("value"),
        F.when(F.col("line") == "", 1).otherwise(0).cast("bigint").alias("blank"),
    ).where((F.col("blank") == 1) | F.col("value").isNotNull())
    numbered = prefix_sums(useful, "line_no", {"event_group": "blank"}, ["stream_id"])
    # One event's lines become one string anyway, so a group is one payload.
    grouped = numbered.groupBy("stream_id", "event_group").agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("line_no", "value")))).alias("parts"),
        F.max("elapsed_ms").alias("elapsed_ms"), F.max("line_no").alias("line_no"),
    ).where(F.size("parts") > 0)
    return grouped.select(
        "stream_id", "line_no", "elapsed_ms",
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("data"),
    )


def decoded(payloads: DataFrame) -> DataFrame:
    """``payloads(stream_id, line_no, elapsed_ms, data)`` with the parsed
    variant; the end marker is dropped, malformed data keep a NULL variant."""
    return payloads.where(F.col("data") != "[DONE]").withColumn("payload", E.parsed(F.col("data")))


def chunks(decoded_payloads: DataFrame) -> DataFrame:
    """Numbered chunks; within a payload reasoning comes before the answer and
    an empty delta gives nothing."""
    delta, p = "$.choices[0].delta", F.col("payload")
    reasoning = F.char_length(E.first_text(p, f"{delta}.reasoning", f"{delta}.reasoning_content"))
    answer = F.char_length(E.content_text(E.at(p, f"{delta}.content")))
    entry = lambda i, channel, size: F.struct(
        F.lit(i).alias("part"), F.lit(channel).alias("channel"), size.cast("bigint").alias("char_count")
    )
    both = F.array(entry(0, "reasoning", reasoning), entry(1, "answer", answer))
    # A malformed payload has two empty deltas and so no chunk.
    events = decoded_payloads.select("stream_id", "line_no", "elapsed_ms", F.inline(both)).where(
        F.col("char_count") > 0
    ).withColumn("position", F.col("line_no") * 2 + F.col("part"))
    # Narrow rows, stored so that numbering them does not parse again.
    return ranked(materialize(events), "position", ["stream_id"], name="seq").select(
        "stream_id", "seq", "elapsed_ms", "channel", "char_count"
    )


def first_tokens(events: DataFrame, key: str = "stream_id") -> DataFrame:
    at = lambda channel: F.min_by(
        "elapsed_ms", F.when(F.col("channel") == channel, F.col("seq"))
    )
    out = events.groupBy(key).agg(at("reasoning").alias("first_reasoning_ms"), at("answer").alias("first_answer_ms"))
    return out.withColumn("ttft_ms", F.least("first_reasoning_ms", "first_answer_ms"))


def terminal_state(decoded_payloads: DataFrame) -> DataFrame:
    """Last provider, usage, error and finish of each stream, and what they
    amount to: any error, or a finish other than stop or completed, is final."""
    p = F.col("payload")
    error = F.when(p.isNull(), "malformed SSE event").otherwise(E.stream_error(p))
    usage = E.usage_columns(p)
    has_usage = F.coalesce(F.to_json(E.at(p, "$.usage")) != "{}", F.lit(False))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))
    facts = decoded_payloads.select(
        "stream_id", "line_no", error.alias("error"),
        F.nullif(E.text_at(p, "$.provider"), F.lit("")).alias("provider"),
        F.nullif(E.text_at(p, "$.choices[0].finish_reason"), F.lit("")).alias("finish"),
        F.when(has_usage, F.struct(*[c.alias(n) for n, c in usage.items()])).alias("usage"),
        F.when(p.isNull(), 1).otherwise(0).alias("rejected"),
    )
    ends = facts.groupBy("stream_id").agg(
        *[last(F.col(c)).alias(c) for c in ("provider", "usage", "error", "finish")],
        F.sum("rejected").cast("bigint").alias("rejected_events"),
    )
    final_error = F.coalesce(
        F.col("error"),
        F.when(~O.finished(F.col("finish")), F.concat(F.lit("stream ended with finish_reason="), F.coalesce("finish", F.lit("missing")))),
    )
    zero = F.lit(0).cast("bigint")
    return ends.select(
        "stream_id", F.coalesce("provider", F.lit("")).alias("provider"), "rejected_events",
        *[F.coalesce(F.col(f"usage.{n}"), zero).alias(n) for n in usage],
        final_error.alias("error_text"),
        F.when(final_error.isNotNull(), "error").otherwise(F.col("finish")).alias("finish_reason"),
    )


def telemetry_report(events: DataFrame, terminal: DataFrame) -> DataFrame:
    """Chunk counts and characters per channel, rejected events, last time."""
    of = lambda channel: F.col("channel") == channel
    counted = events.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("stream_events"), F.count_if(of("reasoning")).alias("reasoning_events"),
        F.count_if(of("answer")).alias("answer_events"),
        F.sum(F.when(of("reasoning"), F.col("char_count")).otherwise(0)).alias("reasoning_characters"),
        F.sum(F.when(of("answer"), F.col("char_count")).otherwise(0)).alias("answer_characters"),
        F.max("elapsed_ms").alias("last_event_ms"),
    )
    return terminal.select("stream_id", "rejected_events", "finish_reason").join(counted, "stream_id", "left")


def capture_completeness(events: DataFrame, key: str = "call_id", minimum: float = 0.95) -> DataFrame:
    """Share of the sequence numbers seen, counted from the highest one."""
    share = F.col("captured") / F.col("expected")
    return (
        events.groupBy(key)
        .agg(F.count_distinct("seq").alias("captured"), (F.max("seq") + 1).alias("expected"))
        .select(key, "captured", "expected", F.round(share, 6).alias("completeness"), (share >= minimum).alias("pass"))
    )


def inter_chunk_gaps(events: DataFrame, key: str = "call_id") -> DataFrame:
    steps = lagged(events, "seq", {"previous_ms": "elapsed_ms"}, [key])
    return steps.withColumn("gap_ms", F.col("elapsed_ms") - F.col("previous_ms")).drop("previous_ms")


def gap_quantiles(gaps: DataFrame, probabilities: dict[str, float], keys: Sequence[str]) -> DataFrame:
    return quantiles(gaps, "gap_ms", probabilities, keys)


def output_rates(events: DataFrame, key: str = "call_id") -> DataFrame:
    """Characters per second between the first and the last chunk, per channel."""
    span = (F.max("elapsed_ms") - F.min("elapsed_ms")) / F.lit(1000.0)
    return events.groupBy(key, "channel").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("char_count").alias("chars"),
        F.when(span > 0, F.round(F.sum("char_count") / span, 6)).alias("chars_per_second"),
    )
