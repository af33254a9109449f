"""Keyed writes as set operations: last-wins, first-wins, score updates, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.operators.ordered import ranked

# The unique key of a call and of a chunk.
CALL_KEY = ["model_id", "instance_id", "sample_idx", "prompt_version", "stage"]
EVENT_KEY = ["call_id", "seq"]


def _kept(df: DataFrame, key: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    # An aggregate, not a window: copies of one key are reduced before the
    # shuffle, so a key with very many writes does not fill one task.
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return kept.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _kept(df, key, order, F.max_by)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _kept(df, key, order, F.min_by)


def record_calls(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace: ids of incoming rows are higher, and the survivor of
    a key carries the id of its latest write."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    return last_wins(both, CALL_KEY, ["call_id"])


def add_instances(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """Insert or ignore: known ids stay as they are, the first new row is taken."""
    first = first_wins(incoming, ["instance_id"], order)
    fresh = first.join(existing.select("instance_id"), "instance_id", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def record_events(existing: DataFrame, incoming: DataFrame, order: Sequence[str] = ("write_no",)) -> DataFrame:
    return last_wins(
        existing.unionByName(incoming, allowMissingColumns=True), EVENT_KEY, list(order)
    )


def update_scores(calls: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply at most one change per call id: outcome and parsed answer."""
    new = changes.select(
        "call_id", F.col("outcome").alias("__outcome"), F.col("parsed_answer").alias("__parsed"),
        F.lit(True).alias("__hit"),
    )
    joined = calls.join(new, "call_id", "left")
    outcome = F.when(F.col("__hit"), F.col("__outcome")).otherwise(F.col("outcome"))
    return joined.select(
        *[
            {
                "outcome": outcome.alias("outcome"),
                "parsed_answer": F.when(F.col("__hit"), F.col("__parsed"))
                .otherwise(F.col("parsed_answer")).alias("parsed_answer"),
                "pass": F.when(outcome == O.PASS, 1).otherwise(0).alias("pass"),
            }.get(c, F.col(c))
            for c in calls.columns
        ]
    )


def with_columns(df: DataFrame, nullable: dict[str, str]) -> DataFrame:
    """Additive schema change: columns an older table lacks are added as NULL."""
    missing = {n: t for n, t in nullable.items() if n not in df.columns}
    return df.withColumns({n: F.lit(None).cast(t) for n, t in missing.items()})


def completed_keys(calls: DataFrame) -> DataFrame:
    return calls.select("instance_id", "sample_idx").distinct()


def call_plan(instances: DataFrame, samples: int, base_seed: int, order_key: Column) -> DataFrame:
    """Every instance of a level times its samples; the puzzle seed depends on
    the level and the instance's position in it."""
    keyed = instances.withColumn("__order", order_key)
    placed = ranked(keyed, "__order", ["level_idx"], name="ordinal")
    return placed.select(
        "instance_id", "level_idx", "level_value",
        (F.lit(base_seed) + F.col("level_idx") * 100_000 + F.col("ordinal")).alias("seed"),
        F.explode(F.expr(f"sequence(0L, {samples - 1}L)")).alias("sample_idx"),
    )


def remaining_plan(plan: DataFrame, calls: DataFrame) -> DataFrame:
    return plan.join(completed_keys(calls), ["instance_id", "sample_idx"], "left_anti")


# Fixed value: prompt tokens assumed for the worst case of one call.
WORST_PROMPT_TOKENS = 8_000


def plan_summary(instances: DataFrame, samples: int, price_in: float, price_out: float, max_tokens: int, cap_usd: float | None) -> DataFrame:
    worst = O.estimated_microdollars(F.lit(WORST_PROMPT_TOKENS), F.lit(max_tokens), price_in, price_out)
    # The plan has every instance so often; it need not be laid out to be counted.
    return instances.agg((F.count(F.lit(1)) * samples).alias("planned_calls")).select(
        "planned_calls", worst.alias("worst_case_microdollars"), O.usd(worst).alias("per_call_worst_case_usd"),
        F.lit("unlimited" if cap_usd is None else str(cap_usd)).alias("hard_cap_usd"),
    )
