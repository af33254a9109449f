"""Outcome taxonomy, raw classification, route matching and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes a call log stores and the three public classes.
PASS, WRONG = "pass", "fail_wrong"
CORRECT = "correct_completed"
SILENT = "silently_wrong_completed"
LOUD = "loud_failure"
FINISHED = ("stop", "completed")


def outcome_class(outcome: Column) -> Column:
    """Three exclusive classes; everything unknown, NULL included, is loud."""
    return F.when(outcome == PASS, CORRECT).when(outcome == WRONG, SILENT).otherwise(LOUD)


def is_completed(outcome: Column) -> Column:
    return F.coalesce(outcome.isin(PASS, WRONG), F.lit(False))


def is_loud(outcome: Column) -> Column:
    return ~is_completed(outcome)


def finished(finish_reason: Column) -> Column:
    return F.coalesce(finish_reason.isin(*FINISHED), F.lit(False))


def route_tail(route: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(route)), "/"), -1)


def provider_matches(observed: Column, required: Column | str) -> Column:
    wanted = F.lit(required) if isinstance(required, str) else required
    present = F.coalesce(observed, F.lit("")) != ""
    return present & F.coalesce(route_tail(observed) == route_tail(wanted), F.lit(False))


def pin_mismatch(error: Column, observed: Column, required: Column | str) -> Column:
    """A failed call is never a route mismatch."""
    failed = F.coalesce(error, F.lit("")) != ""
    return ~failed & ~provider_matches(observed, required)


def classify(error: Column, mismatch: Column, finish: Column, parsed: Column, verified: Column) -> Column:
    """Raw outcome code; the first rule that applies decides."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "error_api")
        .when(mismatch, "provider_mismatch")
        .when(~finished(finish), "fail_truncated")
        .when(parsed.isNull(), "fail_parse")
        .when(verified, PASS)
        .otherwise(WRONG)
    )


def estimated_microdollars(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    """Price-table cost with the fixed ten percent margin, rounded half to even."""
    raw = prompt * F.lit(float(price_in)) + completion * F.lit(float(price_out))
    return F.bround(raw * F.lit(1.10)).cast("bigint")


def has_reported_cost(cost: Column) -> Column:
    return F.coalesce(cost, F.lit(0)) != 0


def imputed_cost(cost: Column, estimate: Column) -> Column:
    return F.when(has_reported_cost(cost), cost).otherwise(estimate)


def cost_source(cost: Column) -> Column:
    return F.when(has_reported_cost(cost), "provider").otherwise("price_table")


def usd(microdollars: Column) -> Column:
    return F.round(microdollars / F.lit(1_000_000.0), 6)
