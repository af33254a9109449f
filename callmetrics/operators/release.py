"""Public exports: compact rows, traces, chunks, and their checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.functions.hashing import content_digest, id_hash

# Columns of the two call exports; they share only the ids.
COMPACT = [
    "call_id", "instance_hash", "difficulty", "outcome", "finish_reason", "completion_tokens", "reasoning_tokens",
    "latency_ms", "cost_microdollars", "provider",
]
TRACE = ["call_id", "instance_hash", "response_text", "reasoning_text"]


def compact_export(calls: DataFrame, instances: DataFrame) -> DataFrame:
    """Metadata only; identifiers hashed, outcomes in three classes."""
    slim = calls.select(
        "call_id", "instance_id", "outcome", "finish_reason", "completion_tokens", "reasoning_tokens", "latency_ms",
        "cost_microdollars", "provider_endpoint",
    )
    return slim.join(instances.select("instance_id", "level_value"), "instance_id").select(
        "call_id", id_hash(F.col("instance_id")).alias("instance_hash"), F.col("level_value").alias("difficulty"),
        O.outcome_class(F.col("outcome")).alias("outcome"), "finish_reason", "completion_tokens", "reasoning_tokens",
        "latency_ms", F.coalesce("cost_microdollars", F.lit(0)).alias("cost_microdollars"),
        F.col("provider_endpoint").alias("provider"),
    )


def trace_export(calls: DataFrame) -> DataFrame:
    """Texts only, empty where absent."""
    empty = F.lit("")
    return calls.select(
        "call_id", id_hash(F.col("instance_id")).alias("instance_hash"),
        F.coalesce("response_text", empty).alias("response_text"), F.coalesce("reasoning_text", empty).alias("reasoning_text"),
    )


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row: keys in order, no spaces, NULLs kept."""
    record = F.struct(*[F.col(c) for c in sorted(df.columns)])
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ordered, compressed JSON lines: a range of the order key per file and
    ordered inside it, so the files together are in order and none is written
    by a single task for the whole table. A path is written once."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    json_lines(placed).write.mode("errorifexists").option("compression", "gzip").text(path)


def digest(df: DataFrame, name: str) -> DataFrame:
    """Rows, characters, bytes, and a content digest that does not depend on
    how rows are spread over files."""
    return digest_lines(json_lines(df), name)


def digest_lines(lines: DataFrame, name: str) -> DataFrame:
    size = lambda measure: F.coalesce(F.sum(measure("value")), F.lit(0)).cast("bigint")
    return lines.agg(
        F.count(F.lit(1)).alias("rows"), size(F.char_length).alias("chars"), size(F.octet_length).alias("bytes"),
        content_digest(F.col("value")).alias("digest"),
    ).select(F.lit(name).alias("artifact"), "rows", "chars", "bytes", "digest")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in sorted(tables):
        one = digest(tables[name], name)
        out = one if out is None else out.unionByName(one)
    return out


def verify_manifest(recomputed: DataFrame, published: DataFrame) -> DataFrame:
    """Each published artifact against what is there now; absent ones fail."""
    now = recomputed.select("artifact", F.col("rows").alias("rows_now"), F.col("digest").alias("digest_now"))
    joined = published.join(now, "artifact", "left")
    return joined.select(
        "artifact", F.col("digest_now").isNotNull().alias("present"),
        F.coalesce((F.col("digest") == F.col("digest_now")) & (F.col("rows") == F.col("rows_now")), F.lit(False)).alias("matches"),
    )


def export_release(calls: DataFrame, instances: DataFrame, events: DataFrame, path: str) -> DataFrame:
    """Write the three exports and return their manifest."""
    tables = {
        "calls": compact_export(calls, instances), "traces": trace_export(calls), "stream-events": events,
    }
    out = None
    for name, df in tables.items():
        write_json_lines(df, f"{path}/{name}", ["call_id", "seq"] if name == "stream-events" else ["call_id"])
        # The checksum is taken from what was written, which is computed once.
        one = digest_lines(calls.sparkSession.read.text(f"{path}/{name}"), name)
        out = one if out is None else out.unionByName(one)
    return out


def read_release(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")
