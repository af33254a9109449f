"""Counts, rates, gates and stopping decisions over a call log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions import outcomes as O
from callmetrics.operators.ordered import prefix_sums
from callmetrics.session import materialize

STUDY = ["stage", "model_id"]


def zero_sum(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def outcome_counts() -> list[Column]:
    outcome = F.col("outcome")
    return [
        F.count_if(outcome == O.PASS).alias("correct"),
        F.count_if(outcome == O.WRONG).alias("silent_wrong"),
        F.count_if(O.is_loud(outcome)).alias("loud"),
    ]


def study_status(calls: DataFrame, keys: Sequence[str] = STUDY) -> DataFrame:
    """Calls, outcomes and spend per study; an empty key list gives one row,
    zeros when there are no calls."""
    out = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        *outcome_counts(),
        zero_sum(F.col("cost_microdollars")).alias("spend_microdollars"),
    )
    return out.withColumn("spend_usd", O.usd(F.col("spend_microdollars")))


def route_status(calls: DataFrame, keys: Sequence[str] = STUDY) -> DataFrame:
    """Unknown pinning is not counted as unpinned here; the cohort audit does."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        zero_sum(F.col("provider_mismatch")).alias("mismatches"),
        F.count_if(F.col("provider_pinned") == 0).alias("unpinned"),
    )


def level_outcomes(calls: DataFrame, instances: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Outcome cells per level. Calls are reduced per instance before the join,
    so a crowded instance crosses the shuffle as one row."""
    reduced = calls.groupBy(*keys, "instance_id").agg(
        *outcome_counts(), zero_sum(F.col("cost_microdollars")).alias("spend_microdollars")
    )
    return (
        reduced.join(instances.select("instance_id", "level_value"), "instance_id")
        .groupBy(*keys, "level_value")
        .agg(*[F.sum(c).alias(c) for c in ("correct", "silent_wrong", "loud", "spend_microdollars")])
    )


def mixed_levels(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("levels"),
        F.count_if((F.col("correct") > 0) & (F.col("silent_wrong") > 0)).alias("mixed_levels"),
    )


def provider_routes(calls: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    return calls.select(
        *keys, F.coalesce("provider_endpoint", F.lit("")).alias("provider")
    ).distinct()


def distinct_counts(calls: DataFrame, keys: Sequence[str] = ("model_id",), approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return calls.groupBy(*keys).agg(
        count(F.col("instance_id")).alias("instances"),
        count(F.coalesce("provider_endpoint", F.lit(""))).alias("providers"),
    )


# Cohort eligibility thresholds.
MIN_SILENT, MIN_COMPLETED, MIN_MIXED_LEVELS = 20, 30, 3


def cohort_audit(calls: DataFrame, instances: DataFrame) -> DataFrame:
    """One row per model: counts and the five eligibility conditions. Calls are
    reduced once per instance and provider; levels, providers, instances and
    totals are grouping sets of what is left."""
    pinned = F.coalesce(F.col("provider_pinned"), F.lit(0))
    reduced = calls.groupBy("model_id", "instance_id", F.coalesce("provider_endpoint", F.lit("")).alias("provider")).agg(
        F.count(F.lit(1)).alias("calls"), *outcome_counts(), F.min(pinned).alias("least_pinned"), F.max(pinned).alias("most_pinned")
    )
    sums = ("calls", "correct", "silent_wrong", "loud")
    by_level, by_provider, by_instance, whole = 0b0011, 0b0101, 0b0110, 0b0111
    sets = reduced.join(instances.select("instance_id", "level_value"), "instance_id").groupingSets(
        [["model_id", "level_value"], ["model_id", "provider"], ["model_id", "instance_id"], ["model_id"]],
        "model_id", "level_value", "provider", "instance_id",
    ).agg(
        F.grouping_id().alias("grouped"), *[F.sum(c).alias(c) for c in sums],
        F.min("least_pinned").alias("least_pinned"), F.max("most_pinned").alias("most_pinned"),
    )
    of = lambda kind: F.col("grouped") == kind
    row = sets.groupBy("model_id").agg(
        *[F.max(F.when(of(whole), F.col(c))).alias(c) for c in (*sums, "least_pinned", "most_pinned")],
        F.count_if(of(by_instance)).alias("instances"), F.count_if(of(by_provider)).alias("providers"),
        F.count_if(of(by_level) & (F.col("correct") > 0) & (F.col("silent_wrong") > 0)).alias("mixed_levels"),
    )
    conditions = {
        "at_least_20_silent_wrong": F.col("silent_wrong") >= MIN_SILENT,
        "at_least_30_completed_calls": F.col("correct") + F.col("silent_wrong") >= MIN_COMPLETED,
        "single_provider_route": F.col("providers") == 1,
        "all_calls_provider_pinned": (F.col("least_pinned") == 1) & (F.col("most_pinned") == 1),
        "at_least_3_mixed_outcome_levels": F.col("mixed_levels") >= MIN_MIXED_LEVELS,
    }
    passed = F.lit(True)
    for condition in conditions.values():
        passed = passed & condition
    return row.select(
        "model_id", "calls", "instances", "correct", "silent_wrong", "loud", "providers", "mixed_levels",
        *[c.alias(n) for n, c in conditions.items()], passed.alias("pass"),
    )


def require_model(audit: DataFrame, model_id: str) -> DataFrame:
    """The audit row of one model; having no calls is an error, not a result."""
    one = audit.where(F.col("model_id") == model_id)
    if one.isEmpty():
        raise ValueError(f"no calls found for {model_id}")
    return one


def failure_rates(calls: DataFrame, codes: dict[str, str], keys: Sequence[str] = ("model_id",)) -> DataFrame:
    rate = lambda code: F.round(F.avg(F.when(F.col("outcome") == code, 1.0).otherwise(0.0)), 6)
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[rate(code).alias(name) for name, code in codes.items()]
    )


def loud_breakdown(calls: DataFrame, keys: Sequence[str] = STUDY) -> DataFrame:
    return calls.where(O.is_loud(F.col("outcome"))).groupBy(*keys, "outcome").agg(
        F.count(F.lit(1)).alias("n")
    )


def gate(metrics: DataFrame, conditions: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Named boolean conditions over a metric row, and their conjunction.
    A metric that is missing or not a number fails."""
    columns = {n: F.coalesce(F.expr(c), F.lit(False)) for n, c in conditions.items()}
    passed = F.lit(True)
    for column in columns.values():
        passed = passed & column
    return metrics.select(*keys, *[c.alias(n) for n, c in columns.items()], passed.alias("pass"))


def protocol_readiness(routes: DataFrame, main: str, before: str, after: str, calls_each: int) -> DataFrame:
    """``routes`` is the route status by (stage, model); the three stages are
    laid side by side, absent ones as zeros."""
    pick = lambda stage, name: F.coalesce(
        F.max(F.when(F.col("stage") == stage, F.col(name))), F.lit(0)
    ).cast("bigint")
    wide = routes.where(F.col("stage").isin(main, before, after)).groupBy("model_id").agg(
        *[
            pick(stage, name).alias(f"{label}_{name}")
            for label, stage in (("main", main), ("before", before), ("after", after))
            for name in ("calls", "mismatches", "unpinned")
        ]
    )
    ready = (
        (F.col("main_mismatches") == 0) & (F.col("main_unpinned") == 0)
        & (F.col("before_calls") >= calls_each) & (F.col("after_calls") >= calls_each)
        & (F.col("before_mismatches") == 0) & (F.col("after_mismatches") == 0)
    )
    return wide.withColumn("ready", ready)


def stop_reason(correct: Column, silent: Column, calls: Column, spend: Column, limits: dict) -> Column:
    """Labels, then calls, then spend; an absent spend cap never stops."""
    reason = F.when(
        (correct >= limits["correct"]) & (silent >= limits["silent_wrong"]), "label target reached"
    ).when(calls >= limits["max_calls"], "call cap reached")
    cap = limits.get("max_spend_microdollars")
    return reason if cap is None else reason.when(spend >= cap, "spend cap reached")


def should_stop(status: DataFrame, limits: dict) -> DataFrame:
    return status.withColumn(
        "stop_reason",
        stop_reason(*[F.col(c) for c in ("correct", "silent_wrong", "calls", "spend_microdollars")], limits),
    )


def first_stop(calls: DataFrame, limits: dict, keys: Sequence[str] = STUDY) -> DataFrame:
    """The first call at which collection should have ended, by running counts."""
    flagged = calls.select(
        *keys, "call_id", "cost_microdollars",
        F.when(F.col("outcome") == O.PASS, 1).otherwise(0).cast("bigint").alias("is_correct"),
        F.when(F.col("outcome") == O.WRONG, 1).otherwise(0).cast("bigint").alias("is_silent"),
        F.lit(1).cast("bigint").alias("is_call"),
    )
    running = prefix_sums(
        flagged, "call_id",
        {"b_correct": "is_correct", "b_silent": "is_silent", "b_calls": "is_call", "b_spend": "cost_microdollars"},
        keys,
    )
    upto = {
        "correct": F.col("b_correct") + F.col("is_correct"),
        "silent_wrong": F.col("b_silent") + F.col("is_silent"),
        "calls": F.col("b_calls") + 1,
        "spend_microdollars": F.col("b_spend") + F.col("cost_microdollars"),
    }
    reached = running.select(*keys, "call_id", *[c.alias(n) for n, c in upto.items()])
    reached = should_stop(reached, limits).where(F.col("stop_reason").isNotNull())
    best = reached.groupBy(*keys).agg(
        F.min_by(F.struct("call_id", *upto, "stop_reason"), "call_id").alias("first")
    )
    return best.select(*keys, "first.*")


def budget_replay(calls: DataFrame, reserve: int, cap: int | None, keys: Sequence[str] = STUDY) -> DataFrame:
    """Replay of admission: money spent by calls already ended when a call
    starts, plus one reserve per call in flight, plus its own reserve.

    Starts and ends are summed per instant first, so many calls at one instant
    are one row of the timeline. Calls ending at the instant are settled;
    calls starting at the same instant do not see each other. A call of no
    length ends one microsecond after its start."""
    keys = list(keys)
    calls = calls.withColumn("end_us", F.greatest("end_us", F.col("start_us") + 1))
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    moment = lambda at, begun, ended, settled: F.struct(
        F.col(at).alias("at"), begun.alias("begun"), ended.alias("ended"), settled.alias("settled")
    )
    moments = calls.select(
        *keys,
        F.inline(F.array(moment("start_us", one, none, none), moment("end_us", none, one, F.col("cost_microdollars")))),
    ).groupBy(*keys, "at").agg(*[F.sum(c).alias(c) for c in ("begun", "ended", "settled")])
    moments = materialize(moments)
    line = prefix_sums(
        moments, "at", {"begun_before": "begun", "ended_before": "ended", "settled_before": "settled"}, keys
    )
    state = line.where(F.col("begun") > 0).select(
        *keys, F.col("at").alias("start_us"), F.col("begun").alias("admitted"),
        (F.col("settled_before") + F.col("settled")).alias("spent"),
        (F.col("begun_before") - F.col("ended_before") - F.col("ended")).alias("in_flight"),
    )
    needed = F.col("spent") + (F.col("in_flight") + 1) * F.lit(reserve)
    breach = F.lit(False) if cap is None else needed > F.lit(cap)
    return state.withColumn("needed", needed).withColumn("would_breach", breach)


# Next-action texts, in decision order.
CONTINUE = "Continue the frozen collection. Do not inspect efficacy metrics."
SENTINEL = "Run the frozen post-sentinel with the original collector, then snapshot the database."
ANALYZE = "Freeze the database checksum, run the analysis once, then publish the result."
SMOKE = "Register and run the USD 10 streaming feasibility smoke."
NEGATIVE = "Report the negative result and stop; streaming remains unauthorized."


def next_action(stop: Column, ready: Column, gate_pass: Column) -> Column:
    """``gate_pass`` is NULL while no report exists."""
    return (
        F.when(stop.isNull(), CONTINUE)
        .when(~ready, SENTINEL)
        .when(gate_pass.isNull(), ANALYZE)
        .when(gate_pass, SMOKE)
        .otherwise(NEGATIVE)
    )
