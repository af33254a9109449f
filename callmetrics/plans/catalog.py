"""Imports every query module so that the registry is complete."""

from callmetrics.plans import (
    curve_queries, metric_queries, release_queries, routing_queries, status_queries,
    store_queries, stream_queries, telemetry_queries, trace_queries, training_queries,
)  # noqa: F401
from callmetrics.plans.registry import CHECKS, QUERIES  # noqa: F401
