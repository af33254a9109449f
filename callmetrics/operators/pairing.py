"""Joins of a log with itself: stages side by side, cheap and strong models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O


def study_events(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Chunks whose call is in the study; only chunk columns remain."""
    return events.join(calls.select("call_id"), "call_id", "left_semi")


def paired_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outcome classes of the same (instance, sample) in two stages."""
    left = before.select("instance_id", "sample_idx", O.outcome_class(F.col("outcome")).alias("before"))
    right = after.select("instance_id", "sample_idx", O.outcome_class(F.col("outcome")).alias("after"))
    return left.join(right, ["instance_id", "sample_idx"]).groupBy("before", "after").agg(
        F.count(F.lit(1)).alias("n")
    )


def paired_stage_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Outcome counts of each stage over the calls that both have: one pass over
    the pairs, in which every pair counts once for either stage."""
    key = ["instance_id", "sample_idx"]
    pairs = before.select(*key, F.col("outcome").alias("b")).join(after.select(*key, F.col("outcome").alias("a")), key)
    outcome = F.col("side.outcome")
    counts = {
        "correct": outcome == O.PASS, "silent_wrong": outcome == O.WRONG, "loud": O.is_loud(outcome),
        "truncations": outcome == "fail_truncated", "api_errors": outcome == "error_api",
    }
    sides = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(c).alias("outcome")) for n, c in (("before", "b"), ("after", "a"))])
    return pairs.select(F.explode(sides).alias("side")).groupBy("side.stage").agg(
        F.count(F.lit(1)).alias("calls"), *[F.count_if(c).alias(n) for n, c in counts.items()]
    )


def per_instance(calls: DataFrame, prefix: str) -> DataFrame:
    """Solve count, calls and spend of one model on each instance."""
    return calls.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias(f"{prefix}_calls"),
        F.count_if(F.col("outcome") == O.PASS).alias(f"{prefix}_solved"),
        F.sum("cost_microdollars").alias(f"{prefix}_cost"),
        F.sum("completion_tokens").alias(f"{prefix}_tokens"),
    )


def shared_instances(calls: DataFrame, cheap: str, strong: str) -> DataFrame:
    """Both sides are reduced to one row per instance before they meet."""
    return per_instance(calls.where(F.col("model_id") == cheap), "cheap").join(
        per_instance(calls.where(F.col("model_id") == strong), "strong"), "instance_id"
    )
