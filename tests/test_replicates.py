"""Intervals draw as many replicates as the reference does by default."""

import pytest

from callmetrics.plans import curve_queries, trace_queries


@pytest.mark.parametrize("plans", [curve_queries, trace_queries])
def test_intervals_draw_two_thousand_replicates(plans):
    assert plans.REPLICATES == 2000
